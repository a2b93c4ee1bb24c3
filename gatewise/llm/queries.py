"""Every query of this subpackage."""

from gatewise.llm import (  # noqa: F401
    collocations,
    embedding_dedup,
    mixing,
    ngram_join,
    packing,
    quality,
    sharding,
    spelling,
    substring,
    tokens,
    topk,
    toxicity,
    url_filter,
)
from gatewise.llm.common import ORACLES, QUERIES  # noqa: F401

"""Token counts, and the token ids that packing cuts.

A text is split where the tokenizer's own pre-tokenizer always splits: before a single space or newline
with something other than white space on both sides. Each piece then has the ids it has inside the whole
text, so a task encodes every distinct piece once, in batches balanced by bytes, and long texts cost no
more memory than short ones. Punctuation that ends a piece is a token of its own, so pieces share their words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewise.llm.common import give_back, query, table

#: Bytes of new pieces that one call of the tokenizer gets.
BATCH_BYTES = 1 << 18
#: Characters of text whose pieces are looked up together, and pieces a task remembers.
GROUP_CHARS = 1 << 19
MEMORY_PIECES = 400_000

_RUN = re.compile(r"\s(?:\s|\Z)")
_SAFE = re.compile(r"(?<=\S)(?=[ \n]\S)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: What may end a piece after a letter or digit and is then a token of its own; no apostrophe (contractions).
TAIL = '!"#$%&()*+,-./:;=?@[]^_{}~'
_LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalnum())


#: What byte-level pre-tokenizers leave whole: letters of Latin blocks or digits, with a space before them or not.
_SINGLE = re.compile(r" ?(?:[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+|[0-9]+)").fullmatch
#: Such words that the model gets as one text.
TOGETHER = 200


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary has for each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _load(path: str):
    """Once a worker: the tokenizer; its model alone, without pre-tokenizer, where it is a plain byte-level one; and whether it
    parts a ``TAIL`` from the Latin letter or digit before it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    found = Tokenizer.from_file(path)
    before = found.pre_tokenizer
    plain = isinstance(before, ByteLevel) and before.use_regex and not before.add_prefix_space and found.normalizer is None
    added = [t.content for t in found.get_added_tokens_decoder().values()]
    plain = plain and set(ByteLevel.alphabet()) == set(_byte_letters().values())
    model = Tokenizer(found.model) if plain and all("<" in t for t in added) else None  # no word can hold an added token
    return found, model, plain and not set(TAIL).intersection("".join(added))


class PieceEncoder:
    """Ids of texts by way of their pieces. ``newline`` is what the tokenizer gives for one line break.

    ``memory`` has the ids of plain pieces, made from those of ``words``: pieces that differ by what ends them share a word.
    """

    def __init__(self, path: str):
        self.tokenizer, self.model, self.parts_tails = _load(path)
        self.letters = _byte_letters()
        self.memory: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        self.newline = self._direct(["\n"])[0]

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _parted(self, encodings: list, words: list[str]) -> bool:
        """Remember the words' ids, each word's ended by a line break; no if the breaks do not part them."""
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encodings])
        ends = np.flatnonzero(ids == np.frombuffer(self.newline, np.uint32)[0])
        if len(ends) != len(words):  # a tokenizer that joins breaks to their neighbours
            return False
        raw, places = ids.tobytes(), (4 * ends).tolist()
        self.words.update(zip(words, [raw[lo:hi] for lo, hi in zip([0] + [x + 4 for x in places], places)]))
        return True

    def _learn_words(self, words: list[str]) -> None:
        """Words are ended by line breaks: a break behind a word is a token of its own. Words that no pre-tokenizer would part go
        straight to the model, which merges bytes the same way with a break between them."""
        alone = len(self.newline) == 4
        single = list(filter(_SINGLE, words)) if alone and self.model else []
        for batch in _by_bytes(single, BATCH_BYTES):
            texts = ["\n".join([*batch[at : at + TOGETHER], ""]) for at in range(0, len(batch), TOGETHER)]
            texts = [t.encode().decode("latin-1").translate(self.letters) for t in texts]
            self._parted(self.model.encode_batch_fast(texts, add_special_tokens=False), batch)
        for batch in _by_bytes([w for w in words if w not in self.words], BATCH_BYTES):
            joined = "\n".join([*batch, ""])
            if not alone or not self._parted(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False), batch):
                self.words.update(zip(batch, self._direct(batch)))

    def _learn(self, plain: set[str]) -> None:
        if len(self.words) > MEMORY_PIECES:
            self.words.clear()
        first = [p for p in plain if p[0] == "\n"]
        plain = [*first, *plain.difference(first)]
        words = bodies = [p[1:] for p in first] + [" " + p for p in plain[len(first) :]]
        tails = None
        if self.parts_tails:
            bodies = [w.rstrip(TAIL) for w in words]
            bodies = [b if b[-1:] in _LETTERS else w for b, w in zip(bodies, words)]
            tails = [w[len(b) :] for b, w in zip(bodies, words)]
        self._learn_words(list(set(bodies).union(tails or ()).difference(self.words, [""])))
        found = list(map(self.words.__getitem__, bodies))
        if tails:
            self.words[""] = b""
            found = list(map(bytes.__add__, found, map(self.words.__getitem__, tails)))
        found[: len(first)] = [self.newline + ids for ids in found[: len(first)]]
        self.memory.update(zip(plain, found))

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The text's pieces, and whether they are plain: the words after a space, without it, and the words that start a line with
        the line break before them, the first one's too."""
        if text[0].isspace() or _RUN.search(text):
            return _SAFE.split(text), False
        return ("\n" + text).replace("\n", " \n")[1:].split(" "), True

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        lo, added = 0, len(self.newline)
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= GROUP_CHARS):
                chars += len(texts[hi])
                hi += 1
            cut = [self.pieces(t) if t else ([], False) for t in texts[lo:hi]]
            for memory in (self.memory, self.odd):
                if len(memory) > MEMORY_PIECES:
                    memory.clear()
            plain = set().union(*[x for x, even in cut if even]).difference(self.memory)
            odd = set().union(*[x for x, even in cut if not even]).difference(self.odd)
            if plain:
                self._learn(plain)
            for batch in _by_bytes(list(odd), BATCH_BYTES):
                self.odd.update(zip(batch, self._direct(batch)))
            for one, even in cut:
                if even:
                    yield b"".join(map(self.memory.__getitem__, one))[added:]
                else:
                    yield b"".join(map(self.odd.__getitem__, one))
            lo = hi


def _by_bytes(pieces: list[str], limit: int) -> Iterator[list[str]]:
    """The pieces in runs of about ``limit`` characters."""
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
    lo = 0
    while lo < len(pieces):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield pieces[lo:hi]
        lo = hi


def token_counts(docs: DataFrame, limit: int = 512, text: str = "text", id: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row, over its whole text.

    A null text counts as empty: no bytes, no tokens. A null id, repeated rows and empty tables pass
    through; columns that are not named are ignored. Strings of special tokens inside a text are
    special tokens, as the library has it by default.
    """
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths = [len(ids) // 4 for ids in encoder.encode([t or "" for t in texts])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lengths, pa.int64())], ["id", "n_bytes", "n_tokens"])
        del encoder
        give_back()

    read = docs.select(docs[id].alias("id"), docs[text].alias("text"), F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema[id].dataType.simpleString()
    found = read.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@query("op2_token_counts")
def op2(spark, sf_dir):
    """Tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))

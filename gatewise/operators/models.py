"""Hook for detectors and readers over an image table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Load = Callable[[], Callable[[pd.DataFrame], pd.DataFrame] | None]


def apply_model(images: DataFrame, load: Load, schema) -> DataFrame:
    """Run a caller's model over Arrow batches of ``images``.

    ``load`` is called once per task and returns the batch function, or None (or raises) where the
    model is unavailable: the table then has no rows instead of failing. Filter and prune ``images``
    first; only rows worth the model's time should reach it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            model = load()
        except (ImportError, OSError):
            model = None
        if model is None:
            return
        for batch in batches:
            yield model(batch)

    return images.mapInPandas(run, schema)

"""X-01, X-02: scorers that need Python, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scorer(load: Callable[[], Callable[[np.ndarray], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function of an array column: load() makes the model once for each worker's
    stream of batches, and the model scores a matrix of rows at once.

    Null or ragged arrays have a null score; all rows of a batch that are scored have the
    length of the first one."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            sizes = np.array([-1 if v is None else len(v) for v in batch])
            good = (sizes == sizes[sizes > 0][0]) if (sizes > 0).any() else np.zeros(len(batch), bool)
            out = np.full(len(batch), np.nan)
            if good.any():
                out[good] = model(np.stack(batch[good].to_list()).astype(float))
            yield pd.Series(out).where(~np.isnan(out), None)

    return score


def linear(weights: list[float], bias: float = 0.0) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """The default: the sigmoid of a weighted sum."""
    return lambda: lambda rows: 1.0 / (1.0 + np.exp(-np.clip(rows @ np.array(weights) + bias, -60, 60)))

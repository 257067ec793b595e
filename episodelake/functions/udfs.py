"""The same vector norm in Python: per batch, per row, and with captured statistics. For functions that Spark lacks; norm() in
functions.arrays is the one to use, and bench.py shows the difference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from episodelake.functions.batches import ragged


def batch_norm():
    """Per Arrow batch."""

    @F.pandas_udf("float")
    def norm(values: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([None if v is None else np.float32(np.sqrt(np.square(np.asarray(v, dtype=np.float64)).sum())) for v in values], dtype="float32")

    return norm


def row_norm():
    """Per row: the slow one."""
    return F.udf(lambda v: None if v is None else float(sum(x * x for x in v) ** 0.5), "float")


def map_batches(df: DataFrame, f: Callable, schema: str, rows: int = 256) -> DataFrame:
    """f over record batches of at most `rows` rows; f may keep state made once per task if it is a class instance."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for i in range(0, b.num_rows, rows):
                yield f(b.slice(i, rows))

    return df.mapInArrow(run, schema)


def outlier_flag(mean: float, std: float, k: float = 3.0) -> Callable:
    """A column function with captured statistics."""
    return lambda c: c > F.lit(mean + k * std)


class Collate:
    """State and action of a batch as two matrices; rows of another width are NaN."""

    def __init__(self, width: int = 14):
        self.width = width

    def __call__(self, batch) -> dict:
        return {name: ragged(batch.column(name), self.width) for name in batch.schema.names}

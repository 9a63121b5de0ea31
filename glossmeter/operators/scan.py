"""Running values over keys that are dealt to tasks by ranges, and over rows that stream by."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def carry(per: DataFrame, key: str, order: str, values: dict[str, Callable[[str], Column]], down: bool = False) -> DataFrame:
    """per with <name>_carried for each of values: what the key's ranges before (down: behind) this one give together; null for the first.

    per has one row a range, so a key's ranges, not its rows, come together in one task.  A value within a range combined with the carried one is a
    running value over the whole key.
    """
    w = W.partitionBy(key).orderBy(F.desc(order) if down else F.asc(order)).rowsBetween(W.unboundedPreceding, -1)
    return per.withColumns({f"{name}_carried": f(name).over(w) for name, f in values.items()})


def span() -> Column:
    """start and end as one number: what Spark hands to Python costs by columns."""
    return F.shiftleft(F.col("start").cast("long"), 32).bitwiseOR(F.col("end").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpacked(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    both = spans.to_numpy(zero_copy_only=False)
    return both >> 32, both.astype("i4").astype("i8")


def begins(sent: pa.Array | None, column: pa.Array) -> np.ndarray:
    """Whether a row is of another sentence than the row before it; sent: that of the row before the first, if there is one."""
    codes = (column if sent is None else pa.concat_arrays([sent, column])).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[sent is None], codes[1:] != codes[:-1]])[-len(column) :]

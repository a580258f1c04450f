"""A bit filter of fixed size over ids: says "surely not wanted" or "maybe wanted".

It only thins what travels; whoever uses it joins exactly afterwards. When it fills up it lets everything pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # 1 MB


def slot(column: str | Column, bits: int = BITS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(bits))


def bit_filter(ids: DataFrame, column: str, bits: int = BITS, at: Column | None = None) -> np.ndarray:
    """Packed bits of the ids' slots; at most bits / 64 rows reach the driver, however many ids there are."""
    at = slot(column, bits) if at is None else at
    words = ids.select(at.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("s") % 64).cast("int"))).alias("b"))
    got = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def maybe(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 6] >> (slots & 63)) & 1 == 1

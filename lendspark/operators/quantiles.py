"""Exact order statistics without a global sort or a one-group window.

``kth_smallest`` works on an order-preserving 64-bit integer image of the value
(the IEEE 754 bits, with the magnitude bits of negative numbers flipped), so any
double, infinite or subnormal, is treated alike.  The image is settled 16 bits at a
time: a pass counts the rows of each open prefix by their next 16 bits (a
partial, map-side combined aggregation, so a group holding a third of all rows
costs no more than any other), and the digit that holds the rank extends the
prefix.  Four passes end the search for every input.

The search state has a row per group and rank and is checkpointed after each pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage

DIGIT_BITS = 16
_LOW = np.int64(0x7FFFFFFFFFFFFFFF)


def _image(bits: np.ndarray) -> np.ndarray:
    """Flips the magnitude bits of negative numbers; its own inverse."""
    return bits ^ ((bits >> np.int64(63)) & _LOW)


@F.pandas_udf(T.LongType())
def ordered_bits(v: pd.Series) -> pd.Series:
    """Integer image of a double; -0.0 counts as 0.0."""
    return pd.Series(_image((v.to_numpy(dtype=np.float64) + 0.0).view(np.int64)))


@F.pandas_udf(T.DoubleType())
def from_ordered_bits(k: pd.Series) -> pd.Series:
    return pd.Series(_image(k.to_numpy(dtype=np.int64)).view(np.float64))


def kth_smallest(vals: DataFrame, group_cols: list[str], value_col: str, ranks: DataFrame) -> DataFrame:
    """k-th smallest non-null, non-NaN ``value_col`` per group and rank.

    ``ranks`` holds ``group_cols + [rank_id, k]`` with 1 <= k <= count.
    Returns ``group_cols + [rank_id, value]``.
    """
    x = F.col(value_col).cast("double")
    keyed = vals.select(*group_cols, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    keys = kth_smallest_long(keyed.select(*group_cols, ordered_bits("_x").alias("_key")), group_cols, "_key", ranks)
    return keys.select(*group_cols, "rank_id", from_ordered_bits("value").alias("value"))


def kth_smallest_long(vals: DataFrame, group_cols: list[str], key_col: str, ranks: DataFrame,
                      bits: int = 64) -> DataFrame:
    """The same for non-null integers; ``bits``: keys fit in so many (non-negative if under 64)."""
    g = list(group_cols) or ["_g"]
    if not group_cols:
        vals, ranks = vals.withColumn("_g", F.lit(0)), ranks.withColumn("_g", F.lit(0))
    # every pass reads the values again: kept in memory or on disk for the duration; a lost block is recomputed
    v = vals.select(*g, F.col(key_col).cast("long").alias("_v")).filter(F.col("_v").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    state = ranks.select(*g, "rank_id", F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("prefix"))
    passes = -(-bits // DIGIT_BITS)
    for p in range(passes):
        shift = (passes - 1 - p) * DIGIT_BITS
        digit = F.shiftright("_v", shift)
        if p == 0:
            # the topmost digit carries the sign
            rows = v.select(*g, F.lit(0).cast("long").alias("prefix"), digit.alias("d"))
        else:
            open_ = state.select(*g, "prefix").distinct()
            rows = (v.select(*g, F.shiftright("_v", shift + DIGIT_BITS).alias("prefix"),
                             digit.bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)).alias("d")).join(open_, [*g, "prefix"], "left_semi"))
        hist = rows.groupBy(*g, "prefix", "d").agg(F.count(F.lit(1)).alias("n"))
        # a row per digit and open prefix: a bounded window
        up_to = Window.partitionBy(*g, "prefix").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("upto", F.sum("n").over(up_to))
        inside = (F.col("upto") - F.col("n") < F.col("k")) & (F.col("k") <= F.col("upto"))
        state = cut_lineage(state.join(hist, [*g, "prefix"]).filter(inside).select(
            *g, "rank_id", (F.col("k") - F.col("upto") + F.col("n")).alias("k"),
            (F.shiftleft("prefix", DIGIT_BITS) + F.col("d")).alias("prefix")))
    v.unpersist()
    return state.select(*group_cols, "rank_id", F.col("prefix").alias("value"))

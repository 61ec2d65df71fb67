"""Deterministic splitting and sampling.

Membership is a pure function of the row key (an md5 bucket), so a split is
a filter: no shuffle, no global sort, identical on every retry and on every
re-read of the data (which is what makes it safe under executor loss).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import (ATTRIBUTION_GROUP_SAMPLE, COMPARISON_TRAIN_CAP, ID_COL, RANDOM_STATE, TARGET_COL,
                         TEST_SIZE)
from ..session import cut_lineage
from .quantiles import kth_smallest_long

BUCKETS = 10000


def key_hash32(key: Column, salt: str) -> Column:
    """First 32 bits of md5(key || salt) as a non-negative BIGINT."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def split_bucket(key: Column, seed: int = RANDOM_STATE) -> Column:
    return key_hash32(key, f"#{seed}") % BUCKETS


def stratified_split(df: DataFrame, key_col: str = ID_COL, test_size: float = TEST_SIZE,
                     seed: int = RANDOM_STATE, out_col: str = "is_test") -> DataFrame:
    """Flag the test share (default 20 %) by hash bucket of the key.

    Every class is cut at the same bucket, so each class keeps its share in
    expectation; the flag never depends on other rows.
    """
    cut = int(round(test_size * BUCKETS))
    # a row without a key is a training row, so none is lost
    return df.withColumn(out_col, F.coalesce(split_bucket(F.col(key_col), seed) < cut, F.lit(False)))


def class_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per class: ``ceil(test_size * n)`` shared in proportion."""
    return share_rows(counts, math.ceil(test_size * sum(counts.values())))


def share_rows(counts: dict, n_rows: int) -> dict:
    """``n_rows`` shared among the classes in proportion, remainders to the
    largest fractional parts (ties by class order).  Integers throughout."""
    n = sum(counts.values())
    quota = {c: n_rows * k // n for c, k in counts.items()}
    left = n_rows - sum(quota.values())
    for c in sorted(counts, key=lambda c: (-(n_rows * counts[c] % n), str(c)))[:left]:
        quota[c] += 1
    return quota


def flag_quota(df: DataFrame, key_col: str, label_col: str, quota: dict, salt: str, out_col: str) -> DataFrame:
    """Flag exactly ``quota[class]`` rows of each class: those with the smallest key hashes.

    The cut of a class is an exact order statistic of the 32-bit hash, found
    without a sort; rows at the cut itself share a hash and are few, and among
    them the smallest keys are taken, in key order of any type.
    """
    spark = df.sparkSession
    label = df.schema[label_col].dataType.simpleString()
    h = key_hash32(F.col(key_col), salt)
    ranks = spark.createDataFrame([(c, 0, q) for c, q in quota.items() if q > 0], f"_c {label}, rank_id int, k long")
    keyed = df.select(F.col(label_col).alias("_c"), F.col(key_col).alias("_key"), h.alias("_h")).filter(F.col("_key").isNotNull())
    cut = kth_smallest_long(keyed, ["_c"], "_h", ranks, bits=32).select("_c", F.col("value").alias("_cut_h"))
    # rows below the cut and the keys at it, in one pass; equal 32-bit hashes of different keys are rare
    at = (keyed.join(cut, "_c").filter(F.col("_h") <= F.col("_cut_h")).groupBy("_c")
          .agg(F.count_if(F.col("_h") < F.col("_cut_h")).alias("_below"),
               F.array_sort(F.collect_set(F.when(F.col("_h") == F.col("_cut_h"), F.col("_key")))).alias("_ties"),
               F.first("_cut_h").alias("_cut_h")))
    cuts = cut_lineage(at.join(ranks, "_c").select(F.col("_c").alias(label_col), "_cut_h",
                                                   F.slice("_ties", F.lit(1), (F.col("k") - F.col("_below")).cast("int")).alias("_taken")))
    flagged = df.join(cuts, label_col, "left")
    test = (h < F.col("_cut_h")) | ((h == F.col("_cut_h")) & F.array_contains("_taken", F.col(key_col)))
    return flagged.withColumn(out_col, F.coalesce(test, F.lit(False))).select(*df.columns, out_col)


def class_counts(df: DataFrame, label_col: str) -> dict:
    """Rows per class; a model of the classes holds as many entries."""
    return {r[label_col]: int(r["n"]) for r in df.filter(F.col(label_col).isNotNull()).groupBy(label_col)
            .agg(F.count(F.lit(1)).alias("n")).collect()}


def stratified_split_exact(df: DataFrame, key_col: str = ID_COL, label_col: str = TARGET_COL,
                           test_size: float = TEST_SIZE, seed: int = RANDOM_STATE,
                           out_col: str = "is_test") -> DataFrame:
    """R1, exact mode: each class contributes exactly its quota of test rows.

    Keys may be of any type that has an order; rows without a key or label are
    never test rows.
    """
    counts = class_counts(df.filter(F.col(key_col).isNotNull()), label_col)
    if not counts:
        return df.withColumn(out_col, F.lit(False))
    return flag_quota(df, key_col, label_col, class_quotas(counts, test_size), f"#{seed}", out_col)


def train_test(df: DataFrame, key_col: str = ID_COL, test_size: float = TEST_SIZE,
               seed: int = RANDOM_STATE) -> tuple[DataFrame, DataFrame]:
    flagged = stratified_split(df, key_col, test_size, seed, "_is_test")
    return flagged.filter(~F.col("_is_test")).drop("_is_test"), flagged.filter("_is_test").drop("_is_test")


def class_balance(df: DataFrame, label_col: str = TARGET_COL, by: list[str] | None = None) -> DataFrame:
    """R2: rows per label (optionally per extra grouping), sorted."""
    keys = (by or []) + [label_col]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys)


def stratified_sample(df: DataFrame, cap: int = COMPARISON_TRAIN_CAP, key_col: str = ID_COL,
                      seed: int = RANDOM_STATE, label_col: str = TARGET_COL) -> DataFrame:
    """Exactly ``cap`` rows, each class in proportion; all rows when there are no more.

    ``cap`` is the documented bound on the rows the comparison models learn from.
    """
    counts = class_counts(df.filter(F.col(key_col).isNotNull()), label_col)
    if sum(counts.values()) <= cap:
        return df
    return flag_quota(df, key_col, label_col, share_rows(counts, cap), f"#sample{seed}", "_in").filter("_in").drop("_in")


def group_sample(df: DataFrame, group_col: str, groups: list[str], k: int = ATTRIBUTION_GROUP_SAMPLE,
                 key_col: str = ID_COL, seed: int = RANDOM_STATE) -> DataFrame:
    """``min(k, n)`` rows per named group, chosen by key hash.

    One scan; the rank filter is pushed below the shuffle (window group limit),
    so each task sends at most k rows of a group.
    """
    order = Window.partitionBy(group_col).orderBy("_h", key_col)
    return (df.filter(F.col(group_col).isin(*groups)).withColumn("_h", key_hash32(F.col(key_col), f"#group{seed}"))
            .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_h", "_r"))

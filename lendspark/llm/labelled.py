"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCALE = 1 << 30


def crc_fold(column: str, modulus: int) -> Column:
    """crc32 of the id's text modulo ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null"))) % modulus


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, drawn by a hash of their key; all rows when there are no more.

    The hash threshold leaves about 10 % more than asked for and the ordered
    limit, which each task applies to its own rows first, cuts that to the bound.
    """
    n = rows.count()
    order = F.xxhash64(F.col(key), F.lit(17))
    if n > most:
        rows = rows.where(F.pmod(order, F.lit(_SCALE)) < F.lit(int(_SCALE * min(1.0, 1.1 * most / n + 1e-6))))
    return rows.orderBy(order, F.col(key)).limit(most)


def label_table(labels: DataFrame, label: str) -> DataFrame:
    """One row per document: doc_id, y (0 or 1).

    Labels other than 0 and 1, null labels and null ids are left out; documents
    labelled both ways equally often as well; otherwise the majority counts.
    """
    return (labels.select("doc_id", F.col(label).cast("int").alias("y"))
            .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
            .groupBy("doc_id").agg(F.avg("y").alias("m"))
            .where("m <> 0.5").select("doc_id", (F.col("m") > 0.5).cast("int").alias("y")))

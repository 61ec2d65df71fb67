"""Application files read line by line, with what does not parse kept apart.

Every line of every file gets its file and line number.  Lines are then parsed as CSV records; a line
that does not have as many fields as the file has columns goes to the malformed table with its raw text, place and
reason.  Lines are headers, blank, records or malformed, and the four add up to the lines of the files.

Line numbers need no sort: a block of a file is read in order, so a line's place in its block is
its row number less the block's first, and the lines of the blocks before it are counted once a block.  A record is
one line; a quoted line break is not part of this format.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MALFORMED_SCHEMA = "file string, line long, raw string, reason string, n_fields int"


@dataclass(frozen=True)
class CsvLines:
    records: DataFrame          # the columns as text, _file, _line
    malformed: DataFrame        # MALFORMED_SCHEMA
    counts: DataFrame           # file, n_lines, n_header, n_blank, n_records, n_malformed


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw) of every line, line numbers from 1."""
    rows = spark.read.text(path).select(F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    # a row per block of a file
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("file", "block", "first", "before")
    return rows.join(blocks, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "raw")


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The columns that the first line of the files names; files that differ are refused."""
    return spark.read.option("header", "true").option("enforceSchema", "false").csv(path).columns


def read_lines(spark: SparkSession, path: str, columns: list[str] | None = None) -> CsvLines:
    """The lines of CSV files; ``columns``: their names where the files have no header."""
    has_header = columns is None
    if columns is None:
        columns = header_of(spark, path)
    fields = ", ".join(f"f{i} string" for i in range(len(columns)))
    record = F.from_csv("raw", f"{fields}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": "\""})
    plain = F.regexp_replace("raw", '"(?:[^"]|"")*"', "")         # without quoted parts
    n_fields = (F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1).cast("int")
    header = (F.col("line") == 1) if has_header else F.lit(False)
    lines = numbered_lines(spark, path).withColumns({"_record": record, "n_fields": n_fields})
    kind = (F.when(header, "header").when(F.trim("raw") == "", "blank")
            .when(plain.contains('"'), "unclosed quote").when(F.col("n_fields") < len(columns), "short").when(F.col("n_fields") > len(columns), "long")
            .when(F.col("_record._bad").isNotNull(), "not a record").otherwise("record"))
    lines = lines.withColumn("kind", kind)
    records = lines.where("kind = 'record'").select(*[F.col(f"_record.f{i}").alias(c) for i, c in enumerate(columns)],
                                                    F.col("file").alias("_file"), F.col("line").alias("_line"))
    malformed = (lines.where("kind NOT IN ('header', 'blank', 'record')")
                 .select("file", "line", "raw", F.col("kind").alias("reason"), "n_fields"))
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), *[F.count_if(F.col("kind") == k).alias(n) for k, n in (
        ("header", "n_header"), ("blank", "n_blank"), ("record", "n_records"))]).withColumn(
            "n_malformed", F.col("n_lines") - F.col("n_header") - F.col("n_blank") - F.col("n_records"))
    return CsvLines(records, malformed, counts)

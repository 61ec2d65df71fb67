import os

import pytest

from lendspark.sources.applications import require_target
from lendspark.sources.sinks import markdown_lines, read_snapshot, write_metrics


def test_require_target(spark):
    df = spark.createDataFrame([(1, "1")], "LoanID long, Default string")
    assert dict(require_target(df).dtypes)["Default"] == "int"
    with pytest.raises(ValueError):
        require_target(df.drop("Default"))


def test_metric_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("0", 0.5, 10), ("1", 0.25, 4)], "label string, precision double, support long")
    write_metrics(df, str(tmp_path / "json"))
    write_metrics(df, str(tmp_path / "csv"), "csv")
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert sorted(back.columns) == ["label", "precision", "support"]


def test_markdown_table(spark):
    df = spark.createDataFrame([("a", 0.5)], "name string, value double")
    lines = [r[0] for r in markdown_lines(df).collect()]
    assert lines[0] == "| name | value |" and lines[1] == "| --- | --- |" and lines[2] == "| a | 0.5000 |"


def test_missing_snapshot_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, os.path.join(str(tmp_path), "nothing-here"))

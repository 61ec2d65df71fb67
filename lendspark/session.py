"""Spark session helpers: sane defaults, a shared checkpoint folder, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "lendspark",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with AQE and skew handling switched on.

    On a cluster, leave ``master`` unset so spark-submit decides; the
    shuffle partition count should then be sized to the data (about
    128-256 MB of shuffle data per partition) and AQE coalesces the rest.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # Fall back to split per-operator code rather than emit a whole-stage
        # method the JIT refuses to compile (> 8000 bytes runs interpreted).
        "spark.sql.codegen.hugeMethodLimit": "8000",
    }
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def tune_session(spark: SparkSession) -> None:
    """Session settings the library relies on, applied only where still at Spark's default.

    Wide rule/validation projections can generate whole-stage methods above
    the JIT's 8000-byte limit; capping ``hugeMethodLimit`` makes Spark split
    them instead of running them interpreted.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", "65535") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; invent one only where all is one machine.

    A cluster names a shared, fault-tolerant folder there.  Only a local master
    (tests, the bench) falls back to a fresh temporary folder, which goes with the process.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
        configured = tempfile.mkdtemp(prefix="lendspark-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def table_version(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> tuple[int, ...]:
    """When each table was last written (its folder or file), so that what was learned from an older one is not used."""
    found = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append(int(status.getModificationTime()))
    return tuple(found)

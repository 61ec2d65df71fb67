"""W1 and N6 (stream): Structured Streaming versions of the decision job.

Scoring is stateless -- each micro-batch goes through exactly the batch plan
(validation, features, rules, decision) -- so no watermark or state store is
involved.  ``foreachBatch`` splits every batch into the scored sink and the
quarantine sink; each epoch writes into its own ``epoch=<id>`` folder with
overwrite, so a replayed epoch after a failure rewrites the same files
(idempotent, effectively exactly-once).

With a model and its spec the batch is scored by the model first, like the
decision job from saved artifacts; without, it brings ``model_probability``.

The periodic monitor needs no watermark and no state store either: every epoch
writes the counts and sums of its own rows per window into ``epoch=<id>``
(overwrite, so a replay is idempotent), and the reader adds them up.  So no row
is late, in whatever order and in however many files the rows arrive.  Epochs are compacted
into a base from time to time, so a long-running monitor keeps one base and a short tail.
"""

from __future__ import annotations

import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import published
from ..constants import ID_COL, TARGET_COL
from ..operators import artifacts
from ..operators.encode import FeatureSpec
from ..operators.monitor import decision_metrics_rates, decision_metrics_sums
from ..operators.validate import validate_applications
from ..plans.scoring import decide, model_adjusted, rule_adjusted
from ..session import table_path
from ..sources.applications import applications_from_orders


def order_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 8) -> DataFrame:
    """Orders arriving as Parquet files: ``path`` is a table folder, or one file of a table."""
    schema = spark.read.parquet(path).schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .option("recursiveFileLookup", "true").parquet(path))


def application_stream(spark: SparkSession, source_dir: str, customer: DataFrame, table: str = "orders",
                       max_files_per_trigger: int = 8) -> DataFrame:
    """Stream of applications; the customer key set is a static side (stream-static semi join)."""
    return applications_from_orders(order_stream(spark, table_path(source_dir, table), max_files_per_trigger), customer)


def score_batch(batch: DataFrame, threshold: float, keep: list[str] | None = None, model=None,
                spec: FeatureSpec | None = None) -> tuple[DataFrame, DataFrame]:
    checked = validate_applications(batch)
    valid = checked.filter("is_valid").drop("violations", "is_valid")
    ruled = rule_adjusted(valid) if model is None else model_adjusted(valid, model, spec)
    scored = decide(ruled, threshold, keep)
    rejected = checked.filter("NOT is_valid").select(ID_COL, "violations")
    return scored, rejected


def pinned_version(spark: SparkSession, out_dir: str, artifacts_dir: str, epoch_id: int) -> str:
    """The model version of an epoch: the one recorded for it, else the current one, which is recorded first.

    A replayed epoch is scored by the version it had, whatever was published since.
    """
    root = os.path.join(out_dir, "versions", f"epoch={epoch_id}")
    pin = published.current(spark, root)
    if pin is None:
        now = published.current(spark, artifacts_dir)
        if now is None:
            raise FileNotFoundError(f"no published version in {artifacts_dir}")
        pin = {"version": now["name"]}
        published.publish(spark, root, published.new_name(spark, root), pin)
    return pin["version"]


def start_score_stream(apps: DataFrame, threshold: float | None, out_dir: str, checkpoint_dir: str,
                       keep: list[str] | None = None, available_now: bool = True, model=None,
                       spec: FeatureSpec | None = None, artifacts_dir: str | None = None):
    """Score every arriving application; returns the running query.

    With ``artifacts_dir`` model, spec and threshold are those of the version that is current when an epoch
    begins; the version is recorded with the epoch and in the column ``model_version`` of its rows.
    """
    scored_dir, quarantine_dir = os.path.join(out_dir, "scored"), os.path.join(out_dir, "quarantine")
    loaded: dict[str, artifacts.Artifacts] = {}

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)   # two outputs, one read of the batch
        if artifacts_dir is None:
            scored, rejected = score_batch(batch, threshold, keep, model, spec)
        else:
            spark = batch.sparkSession
            version = pinned_version(spark, out_dir, artifacts_dir, epoch_id)
            if version not in loaded:
                loaded.clear()
                loaded[version] = artifacts.load(spark, artifacts_dir, version)
            found = loaded[version]
            scored, rejected = score_batch(batch, found.threshold, keep, found.model, found.spec)
            scored = scored.withColumn("model_version", F.lit(version))
        scored.write.mode("overwrite").parquet(os.path.join(scored_dir, f"epoch={epoch_id}"))
        rejected.write.mode("overwrite").parquet(os.path.join(quarantine_dir, f"epoch={epoch_id}"))
        batch.unpersist()

    writer = apps.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


COMPACT_EVERY = 100         # epochs between two compactions of a running monitor


def start_periodic_stream(apps: DataFrame, threshold: float, out_dir: str, checkpoint_dir: str,
                          window: str = "90 days", available_now: bool = True, compact_every: int = COMPACT_EVERY):
    """N6 (stream): decision metrics per tumbling window of application time."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        scored, _ = score_batch(batch, threshold, [TARGET_COL, "application_ts"])
        part = (scored.withColumn("event_time", F.col("application_ts").cast("timestamp"))
                .groupBy(F.window("event_time", window).alias("w")).agg(*decision_metrics_sums(TARGET_COL)))
        write_epoch(part, out_dir, epoch_id)
        if (epoch_id + 1) % compact_every == 0:
            compact_periodic(batch.sparkSession, out_dir)

    writer = apps.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def write_epoch(part: DataFrame, out_dir: str, epoch_id: int) -> None:
    """An epoch's sums per window; an epoch that the base holds already is not written again."""
    base = published.current(part.sparkSession, out_dir)
    if base is None or epoch_id > base["upto"]:
        part.coalesce(1).write.mode("overwrite").parquet(os.path.join(out_dir, "epochs", f"epoch={epoch_id}"))


def _epochs(spark: SparkSession, out_dir: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in published.names(spark, os.path.join(out_dir, "epochs")) if n.startswith("epoch="))


def _sums(spark: SparkSession, out_dir: str) -> tuple[DataFrame | None, list[int], int]:
    """Sums per window of the base and the epochs after it, these epochs, and the base's last epoch (-1: no base)."""
    base = published.current(spark, out_dir)
    upto = -1 if base is None else base["upto"]
    tail = [e for e in _epochs(spark, out_dir) if e > upto and published.complete(spark, os.path.join(out_dir, "epochs", f"epoch={e}"))]
    paths = [os.path.join(out_dir, "epochs", f"epoch={e}") for e in tail] + ([] if base is None else [os.path.join(out_dir, "base", base["name"])])
    if not paths:
        return None, [], upto
    parts = spark.read.parquet(*paths)
    return parts.groupBy("w").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "w"]), tail, upto


def compact_periodic(spark: SparkSession, out_dir: str) -> int:
    """Adds the complete epochs to the base and returns the last one it then holds.

    The new base is written aside and becomes current with its manifest, which states the last epoch it holds; readers
    pass over epochs up to that one, so one that is replayed, or left by a killed compaction, counts
    once.  Epochs are removed a compaction later, when no reader of the base before needs them.
    """
    total, tail, upto = _sums(spark, out_dir)
    # up to the first gap: an epoch that is still to come must stay above the base
    whole = []
    for e in tail:
        if e != upto + 1 + len(whole):
            break
        whole.append(e)
    if not whole:
        return upto
    if len(whole) < len(tail):
        paths = [os.path.join(out_dir, "epochs", f"epoch={e}") for e in whole]
        base = published.current(spark, out_dir)
        parts = spark.read.parquet(*paths, *([] if base is None else [os.path.join(out_dir, "base", base["name"])]))
        total = parts.groupBy("w").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "w"])
    name = published.new_name(spark, out_dir)
    total.coalesce(1).write.parquet(os.path.join(out_dir, "base", name))
    published.publish(spark, out_dir, name, {"upto": whole[-1]})
    for e in _epochs(spark, out_dir):
        if e <= upto:
            published.remove(spark, os.path.join(out_dir, "epochs", f"epoch={e}"))
    return whole[-1]


def read_periodic(spark: SparkSession, out_dir: str) -> DataFrame:
    """Totals of every window: the base and the epochs after it (one small aggregate over the window keys)."""
    total, _, _ = _sums(spark, out_dir)
    if total is None:
        raise FileNotFoundError(f"no epoch in {out_dir}")
    values = [c for c in total.columns if c != "w"]
    total = total.select(F.date_format("w.start", "yyyy-MM-dd").alias("window_start"),
                         F.date_format("w.end", "yyyy-MM-dd").alias("window_end"),
                         *[c for c in values if c != "sum_p"], (F.col("sum_p") / F.col("n")).alias("_mean_p"))
    return decision_metrics_rates(total)

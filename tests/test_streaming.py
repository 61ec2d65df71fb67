import os

import pytest

from lendspark.operators.metrics import pick_threshold
from lendspark.plans.catalog import scored_table
from lendspark.session import ensure_checkpoint_dir, read_table
from lendspark.sources.applications import load_applications
from lendspark.streaming import score_stream

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    t = pick_threshold(load_applications(spark, SF))
    apps = score_stream.application_stream(spark, SF, read_table(spark, SF, "customer"))
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    score_stream.start_score_stream(apps, t, out, ckpt).awaitTermination()
    stream = spark.read.parquet(os.path.join(out, "scored")).drop("rule_audit", "epoch")
    batch = scored_table(spark, SF).drop("rule_audit")
    cols = sorted(batch.columns)
    assert sorted(stream.columns) == cols
    assert stream.select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert batch.select(*cols).exceptAll(stream.select(*cols)).count() == 0
    quarantine = spark.read.parquet(os.path.join(out, "quarantine"))
    assert quarantine.count() + stream.count() == load_applications(spark, SF).count()
    assert ensure_checkpoint_dir(spark)


def test_periodic_stream_restart_is_idempotent(spark, tmp_path):
    # a restart on the same checkpoint replays nothing new: the windows read back are unchanged
    t = pick_threshold(load_applications(spark, SF))
    customer = read_table(spark, SF, "customer")
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    score_stream.start_periodic_stream(score_stream.application_stream(spark, SF, customer), t, out, ckpt) \
        .awaitTermination()
    first = sorted(map(tuple, score_stream.read_periodic(spark, out).collect()))
    score_stream.start_periodic_stream(score_stream.application_stream(spark, SF, customer), t, out, ckpt) \
        .awaitTermination()
    second = sorted(map(tuple, score_stream.read_periodic(spark, out).collect()))
    assert first and first == second
    assert sum(r[2] for r in first) == scored_table(spark, SF).count()      # column 2 is n


@pytest.mark.parametrize("files,seed", [(4, 1), (10, 2)])
def test_many_files_in_any_order_give_the_batch_totals(spark, tmp_path, files, seed):
    import shutil

    from lendspark.plans.extra import batch_windows
    src = tmp_path / "sf"
    src.mkdir()
    orders = read_table(spark, SF, "orders")
    orders.repartitionByRange(files, "o_orderkey").write.parquet(str(src / "orders.parquet"))
    shutil.copy(os.path.join(SF, "customer.parquet"), src / "customer.parquet")
    t = pick_threshold(load_applications(spark, SF))
    stream = score_stream.application_stream(spark, str(src), read_table(spark, SF, "customer"), max_files_per_trigger=seed)
    out, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    score_stream.start_periodic_stream(stream, t, out, ckpt).awaitTermination()
    got = sorted(map(tuple, score_stream.read_periodic(spark, out).collect()))
    want = sorted(map(tuple, batch_windows(spark, SF, t).collect()))
    assert [r[:9] for r in got] == [r[:9] for r in want] and len(got) == 28
    scored, ckpt = str(tmp_path / "scored"), str(tmp_path / "ckpt2")
    score_stream.start_score_stream(stream, t, scored, ckpt).awaitTermination()
    assert spark.read.parquet(os.path.join(scored, "scored")).count() == scored_table(spark, SF).count()

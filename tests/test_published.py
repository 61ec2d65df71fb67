import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendspark import published
from lendspark.operators import artifacts, boosting, encode
from lendspark.session import read_table
from lendspark.sources.applications import load_applications
from lendspark.streaming import score_stream

SF = "/root/testdata/sf0.001"


def small_model(spark, apps, rounds):
    from lendspark.plans.training import prepare_training
    data = prepare_training(apps)
    return boosting.fit(data.train, "x", "Default", "LoanID", rounds=rounds, max_bins=16), data.spec


@pytest.fixture(scope="module")
def versions(spark):
    apps = load_applications(spark, SF)
    return [small_model(spark, apps, r) for r in (1, 2)]


def test_a_version_is_seen_whole_or_not(spark, tmp_path, versions, monkeypatch):
    root = str(tmp_path / "a")
    with pytest.raises(FileNotFoundError):
        artifacts.load(spark, root)
    first = artifacts.publish(spark, root, *versions[0], 0.3)

    class Killed(Exception):
        pass

    def killed(*args, **kw):
        raise Killed
    for place in ("save_spec", "write_parts"):          # half of the parts; then all parts and no manifest
        with monkeypatch.context() as m:
            if place == "save_spec":
                m.setattr(artifacts, "save_spec", killed)
            else:
                m.setattr(published, "publish", killed)
            with pytest.raises(Killed):
                artifacts.publish(spark, root, *versions[1], 0.4)
        found = artifacts.load(spark, root)
        assert (found.version, found.model.getNumTrees, found.threshold) == (first, 1, 0.3)
    os.makedirs(os.path.join(root, "manifest", "999999999999-x"))        # a manifest whose write was killed
    assert artifacts.load(spark, root).version == first
    second = artifacts.publish(spark, root, *versions[1], 0.4)
    assert second > first and artifacts.load(spark, root).model.getNumTrees == 2
    assert artifacts.load(spark, root, first).threshold == 0.3
    # parts of another version under a version's name are refused
    encode.save_spec(spark, versions[0][1], os.path.join(root, "versions", second, "spec"), 0.9)
    with pytest.raises(ValueError):
        artifacts.load(spark, root)


def test_a_stream_changes_versions_between_epochs(spark, tmp_path, versions):
    """Each epoch is scored by one version and says which; a replay uses the version that the epoch had."""
    root, out = str(tmp_path / "a"), str(tmp_path / "out")
    src = tmp_path / "sf" / "orders.parquet"
    orders = read_table(spark, SF, "orders")
    cut = orders.approxQuantile("o_orderkey", [0.5], 0.0)[0]
    customer = read_table(spark, SF, "customer")

    def run(ckpt="ckpt"):
        stream = score_stream.application_stream(spark, str(tmp_path / "sf"), customer)
        score_stream.start_score_stream(stream, None, out, str(tmp_path / ckpt), artifacts_dir=root).awaitTermination()

    orders.where(F.col("o_orderkey") <= cut).coalesce(1).write.parquet(str(src))
    one = artifacts.publish(spark, root, *versions[0], 0.3)
    run()
    orders.where(F.col("o_orderkey") > cut).coalesce(1).write.mode("append").parquet(str(src))
    two = artifacts.publish(spark, root, *versions[1], 0.4)
    run()

    def rows():
        return sorted(map(tuple, spark.read.parquet(os.path.join(out, "scored")).select("LoanID", "model_probability", "threshold", "model_version").collect()))
    before = rows()
    assert {(r[2], r[3]) for r in before} == {(0.3, one), (0.4, two)}
    p = {r[0]: (r[1], r[3]) for r in before}
    from lendspark.plans.scoring import score_with_model
    for (model, spec), name, t in ((versions[0], one, 0.3), (versions[1], two, 0.4)):
        for r in score_with_model(load_applications(spark, SF), model, spec, t).collect():
            assert p[r.LoanID][1] != name or p[r.LoanID][0] == r.model_probability
    # the first epoch again, as after a failure before its commit
    assert score_stream.pinned_version(spark, out, root, 0) == one and score_stream.pinned_version(spark, out, root, 1) == two
    assert score_stream.pinned_version(spark, out, root, 2) == two


def epoch_part(spark, e):
    rows = [(f"2020-0{1 + (e + k) % 3}-01 00:00:00", 1 + e % 5, e % 2, float(e)) for k in range(2)]
    df = spark.createDataFrame(rows, "t string, n long, tp long, sum_p double")
    return df.select(F.window(F.col("t").cast("timestamp"), "31 days").alias("w"), "n", "tp", "sum_p").groupBy("w").agg(
        F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("sum_p").alias("sum_p"))


def test_epochs_become_one_base_and_a_tail(spark, tmp_path):
    """1,000 epochs, replays and a killed compaction: the sums are those of all epochs, once each."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    out = str(tmp_path / "m")
    want = {}
    template = epoch_part(spark, 0).toArrow()
    windows = [epoch_part(spark, e).select("w").collect() for e in range(3)]

    def put(e):
        folder = os.path.join(out, "epochs", f"epoch={e}")
        os.makedirs(folder, exist_ok=True)
        rows = [{"w": {"start": r.w.start, "end": r.w.end}, "n": 1 + e % 5, "tp": e % 2, "sum_p": float(e)} for r in windows[e % 3]]
        pq.write_table(pa.Table.from_pylist(rows, template.schema), os.path.join(folder, "part-0.parquet"))
        open(os.path.join(folder, "_SUCCESS"), "w").close()
        return rows

    def sums():
        total, tail, upto = score_stream._sums(spark, out)
        return {r.w.start: (r.n, r.tp, r.sum_p) for r in total.collect()}, tail, upto

    for e in range(1000):
        for r in put(e):
            a = want.get(r["w"]["start"], (0, 0, 0.0))
            want[r["w"]["start"]] = (a[0] + r["n"], a[1] + r["tp"], a[2] + r["sum_p"])
        if e in (399, 998):
            assert score_stream.compact_periodic(spark, out) == e
    got, tail, upto = sums()
    assert got == want and tail == [999] and upto == 998
    assert score_stream._epochs(spark, out) == list(range(400, 1000))       # those of the base before are gone
    put(5)                                              # replays of epochs that the base holds
    score_stream.write_epoch(epoch_part(spark, 7), out, 7)
    assert sums()[0] == want and 7 not in score_stream._epochs(spark, out)
    os.makedirs(os.path.join(out, "manifest", "999999999999-x"))            # a compaction killed before its manifest was whole
    assert sums()[0] == want
    put(1001)                                           # 1000 is still to come
    assert score_stream.compact_periodic(spark, out) == 999 and sums()[1:] == ([1001], 999)
    assert score_stream.compact_periodic(spark, out) == 999
    assert np.isclose(sum(v[2] for v in sums()[0].values()), sum(v[2] for v in want.values()) + 2 * 1001)

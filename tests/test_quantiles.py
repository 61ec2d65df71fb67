import numpy as np

from lendspark.operators.checks import latency_summary
from lendspark.operators.quantiles import kth_smallest, kth_smallest_long


def test_kth_smallest_matches_sort_with_skew(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(4):
        n = 500 + 300 * g
        vals = rng.normal(size=n) * 10 ** g
        vals[: n // 3] = 7.25            # a third of the group is one value
        vals[n // 3: n // 3 + 5] = [1e-300, -1e300, 1e300, 0.0, -0.0]
        rows += [(g, float(v)) for v in vals]
    df = spark.createDataFrame(rows, "g int, v double")
    ranks, expected = [], {}
    for g in range(4):
        vals = np.sort(np.array([v for gg, v in rows if gg == g]))
        for rid, k in enumerate([1, 2, len(vals) // 3, len(vals) // 2, len(vals) - 1, len(vals)]):
            ranks.append((g, rid, k))
            expected[(g, rid)] = vals[k - 1]
    rdf = spark.createDataFrame(ranks, "g int, rank_id int, k long")
    got = {(r["g"], r["rank_id"]): r["value"] for r in kth_smallest(df, ["g"], "v", rdf).collect()}
    assert got == {k: float(v) for k, v in expected.items()}


def test_latency_summary_p95(spark):
    rng = np.random.default_rng(5)
    lat = rng.gamma(2.0, 15.0, size=101).round(2)
    df = spark.createDataFrame([(float(v), i % 10 == 0) for i, v in enumerate(lat)], "ms double, err boolean")
    r = latency_summary(df, "ms", "err").first()
    s = sorted(lat)
    assert r["p95_ms"] == round(s[int(101 * 0.95) - 1], 2)
    assert r["n_errors"] == 11 and r["n_calls"] == 101 and r["max_ms"] == round(max(lat), 2)
    one = latency_summary(spark.createDataFrame([(12.5, False)], "ms double, err boolean"), "ms", "err").first()
    assert one["p95_ms"] == 12.5


def test_feature_drift_psi(spark):
    import math
    from pyspark.sql import functions as F
    from lendspark.operators.monitor import feature_drift, psi_value
    rows = [(float(i % 100), i >= 1000) for i in range(2000)]          # same distribution in both periods
    rows += [(float(200 + i), True) for i in range(100)]               # 100 new, larger values
    df = spark.createDataFrame(rows, "a double, cur boolean")
    r = feature_drift(df, ["a"], F.col("cur")).first()
    assert r["n_baseline"] == 1000 and r["n_current"] == 1100
    # deciles of 0..99 (x10): each bin 10 %; current: 1000 spread alike + 100 in the top bin
    base = [0.1] * 10
    cur = [100 / 1100] * 9 + [200 / 1100]
    exp = sum(psi_value(b, c) for b, c in zip(base, cur))
    assert math.isclose(r["psi"], round(exp, 6), abs_tol=1e-6) and r["level"] == "stable"


def test_kth_smallest_many_groups(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g in range(30) for v in rng.integers(0, 50, size=40)]
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = spark.createDataFrame([(g, 0, 20) for g in range(30)], "g int, rank_id int, k long")
    got = {r["g"]: r["value"] for r in kth_smallest(df, ["g"], "v", ranks).collect()}
    for g in range(30):
        assert got[g] == sorted(v for gg, v in rows if gg == g)[19]


def test_kth_smallest_ignores_null_and_nan(spark):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(11)
    rows = [(g, float(v)) for g in range(3) for v in rng.exponential(5.0, size=400 + 100 * g).round(3)]
    rows += [(1, float("nan")), (1, None), (2, 7.0), (2, 7.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    clean = df.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    stats = clean.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranks = stats.select("g", F.explode(F.array(F.lit(1), F.lit(2))).alias("rank_id"), "n") \
        .select("g", "rank_id", (F.col("n") * F.col("rank_id") / 3).cast("long").alias("k"))
    got = {(r["g"], r["rank_id"]): r["value"] for r in kth_smallest(df, ["g"], "v", ranks).collect()}
    expected = {}
    for g in range(3):
        vals = np.sort([v for gg, v in rows if gg == g and v is not None and v == v])
        for rid in (1, 2):
            expected[(g, rid)] = float(vals[int(len(vals) * rid / 3) - 1])
    assert got == expected


def test_kth_smallest_extreme_values(spark):
    inf = float("inf")
    vals = [-inf, -inf, -1.7976931348623157e308, -2.5, -5e-324, 0.0, -0.0, 5e-324, 1e-310, 1.0, 1.7976931348623157e308, inf]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    ranks = spark.createDataFrame([(i, i + 1) for i in range(len(vals))], "rank_id int, k long")
    got = {r["rank_id"]: r["value"] for r in kth_smallest(df, [], "v", ranks).collect()}
    assert [got[i] for i in range(len(vals))] == sorted(vals)


def test_kth_smallest_long(spark):
    vals = [-(1 << 63), -5, 0, 7, 7, (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    ranks = spark.createDataFrame([(i, i + 1) for i in range(len(vals))], "rank_id int, k long")
    got = {r["rank_id"]: r["value"] for r in kth_smallest_long(df, [], "v", ranks).collect()}
    assert [got[i] for i in range(len(vals))] == vals


def test_kth_smallest_geometric_spread_(spark):
    vals = [float(2.0 ** e) for e in range(-300, 301, 10)] + [0.0, -5.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    srt = sorted(vals)
    ks = [1, 2, 3, 4, len(vals) // 2, len(vals)]
    ranks = spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "rank_id int, k long")
    got = {r["rank_id"]: r["value"] for r in kth_smallest(df, [], "v", ranks).collect()}
    assert got == {i: srt[k - 1] for i, k in enumerate(ks)}

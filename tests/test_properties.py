"""Property tests (hypothesis) for the distributed algorithms against plain Python."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lendspark.operators.metrics import grid_step, threshold_counts
from lendspark.operators.quantiles import kth_smallest

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

probs = st.lists(st.one_of(st.floats(min_value=0, max_value=1), st.sampled_from([0.0, 0.1, 0.549, 0.9, 1.0])),
                 min_size=1, max_size=60)


@SETTINGS
@given(probs, st.randoms())
def test_threshold_counts_equal_brute_force(spark, ps, rnd):
    labels = [rnd.randint(0, 1) for _ in ps]
    df = spark.createDataFrame(list(zip(ps, labels)), "p double, y int")
    got = {r["step"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in threshold_counts(df, "y", "p").collect()}
    p, y = np.array(ps), np.array(labels)
    for step in (0, 1, 100, 231, 549, 900, 999, 1000):
        pred = p >= step / 1000
        exp = (int(((y == 1) & pred).sum()), int(((y == 0) & pred).sum()),
               int(((y == 1) & ~pred).sum()), int(((y == 0) & ~pred).sum()))
        assert got[step] == exp


@SETTINGS
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=80), st.data())
def test_kth_smallest_any_values(spark, vals, data):
    ks = data.draw(st.lists(st.integers(min_value=1, max_value=len(vals)), min_size=1, max_size=4, unique=True))
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    ranks = spark.createDataFrame([(i, k) for i, k in enumerate(ks)], "rank_id int, k long")
    got = {r["rank_id"]: r["value"] for r in kth_smallest(df, [], "v", ranks).collect()}
    s = sorted(float(v) for v in vals)
    assert got == {i: s[k - 1] for i, k in enumerate(ks)}


def test_grid_step_monotone(spark):
    df = spark.range(0, 20001).select((F.col("id") / 20000.0).alias("p"))
    steps = [r[0] for r in df.select(grid_step(F.col("p"))).collect()]
    assert steps == sorted(steps) and steps[0] == 0 and steps[-1] == 1000

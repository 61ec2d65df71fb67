import numpy as np
from pyspark.sql import functions as F

from lendspark.constants import PUBLISHED_CONFUSION, PUBLISHED_METRICS
from lendspark.operators.metrics import (binary_metrics, classification_report, confusion_matrix, grid_step,
                                         pick_threshold, pick_threshold_frame, threshold_curve)


def test_published_confusion_matrix(spark):
    c = PUBLISHED_CONFUSION
    df = spark.createDataFrame([(0, 0, c["tn"]), (0, 1, c["fp"]), (1, 1, c["tp"]), (1, 0, c["fn"])],
                               "actual int, predicted int, n long")
    m = binary_metrics(df, "actual", "predicted", None, weight_col="n").first()
    for k, v in PUBLISHED_METRICS.items():
        assert round(m[k], 4) == v, k
    cm = {r["actual"]: (r["predicted_0"], r["predicted_1"])
          for r in confusion_matrix(df, "actual", "predicted", "n").collect()}
    assert cm == {0: (c["tn"], c["fp"]), 1: (c["fn"], c["tp"])}
    rep = {r["label"]: r for r in classification_report(df, "actual", "predicted", "n").collect()}
    assert rep["1"]["support"] == c["tp"] + c["fn"] and rep["accuracy"]["precision"] == round(m["accuracy"], 6)


def test_grid_step_boundaries(spark):
    vals = [0.549, float(np.nextafter(0.549, 0)), 0.0, 1.0, -0.5, 3.0, None, float("nan"), 0.1]
    for j in range(1001):
        vals.append(j / 1000)
        vals.append(float(np.nextafter(j / 1000, 0)))
    df = spark.createDataFrame([(v,) for v in vals], "p double")
    got = [r[0] for r in df.select(grid_step(F.col("p"))).collect()]
    for v, k in zip(vals, got):
        if v is None or v != v:
            assert k == -1
            continue
        exp = max([j for j in range(1001) if j / 1000 <= v], default=-1)
        assert k == exp, (v, k, exp)


def test_threshold_sweep_equals_brute_force(tiny_apps):
    pdf = tiny_apps.select("model_probability", "Default").toPandas()
    p, y = pdf["model_probability"].to_numpy(), pdf["Default"].to_numpy()
    curve = {r["step"]: r for r in threshold_curve(tiny_apps).collect()}
    best, best_t = None, 0.5
    for step in range(100, 901):
        t = step / 1000
        pred = p >= t
        tp, fp = int(((y == 1) & pred).sum()), int(((y == 0) & pred).sum())
        fn = int(((y == 1) & ~pred).sum())
        assert (curve[step]["tp"], curve[step]["fp"], curve[step]["fn"]) == (tp, fp, fn)
        rec = tp / (tp + fn) if tp + fn else 0.0
        prec = tp / (tp + fp) if tp + fp else 0.0
        score = (abs(rec - 0.69), -prec)
        if best is None or score < best:
            best, best_t = score, t
    assert pick_threshold(tiny_apps) == best_t


def test_fixture_threshold_sf001(spark):
    from lendspark.sources.applications import load_applications
    apps = load_applications(spark, "/root/testdata/sf0.01")
    r = pick_threshold_frame(threshold_curve(apps)).first()
    assert (r["step"], r["tp"], r["fp"]) == (549, 1289, 5478)

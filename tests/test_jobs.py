import os

from lendspark.constants import GBT_PARAMS
from lendspark.plans import jobs
from lendspark.sources.applications import load_applications

SF = "/root/testdata/sf0.001"


def test_reference_flows_write_their_outputs(spark, tmp_path):
    out = str(tmp_path / "run")
    apps = load_applications(spark, SF)
    tm = jobs.run_training(spark, apps, out, max_iter=3)
    counts = jobs.run_error_analysis(spark, apps, tm, out)
    snap = jobs.run_snapshot(spark, apps, tm, out, forest_trees=5, logistic_iter=20).first()
    payload = spark.read.json(os.path.join(out, "training", "training_metrics")).first()
    assert payload["feature_count"] == 25 and payload["decision_threshold"] == tm.threshold
    cm = spark.read.option("header", "true").csv(os.path.join(out, "training", "confusion_matrix")).collect()
    assert len(cm) == 2
    n_test = sum(r["count"] for r in counts.collect())
    assert n_test == tm.test_scored.count()
    means = spark.read.option("header", "true").csv(os.path.join(out, "analysis", "error_analysis_feature_means"))
    assert "Income" in means.columns and "DefaultProbability" in means.columns
    assert len(snap["demo_scenarios"]) == 4
    md = spark.read.text(os.path.join(out, "reports", "scenarios_md")).collect()
    assert md[0][0].startswith("| title |") and len(md) == 6
    from lendspark.plans.training import load_artifacts
    model, spec, t = load_artifacts(spark, os.path.join(out, "artifacts"))
    assert spec.names == tm.spec.names and t == tm.threshold
    scored = jobs.run_scoring(spark, apps, os.path.join(out, "artifacts"), str(tmp_path / "scored"))
    from lendspark.plans.scoring import score_with_model
    direct = score_with_model(apps, tm.model, tm.spec, tm.threshold)
    assert scored.count() == direct.count() and scored.exceptAll(direct.select(*scored.columns)).isEmpty()
    rejected = spark.read.parquet(str(tmp_path / "scored" / "quarantine")).count()
    assert rejected + scored.count() == apps.count()
    run = spark.read.json(os.path.join(out, "analysis", "error_analysis_summary")).first()
    assert run["decision_threshold"] == tm.threshold and sum(r["Count"] for r in run["error_counts"]) == n_test
    import json
    params = json.loads(payload["optimized_params"])
    assert params == {**GBT_PARAMS, "n_estimators": 3} and tm.model.params["gamma"] == params["gamma"]


def test_threshold_is_not_picked_on_test_rows(spark):
    from lendspark.operators import sampling
    from lendspark.plans import training
    apps = load_applications(spark, SF)
    data = training.prepare_training(apps, calibrate_on="calibration")
    keys = {n: {r[0] for r in getattr(data, n).select("LoanID").collect()} for n in ("train", "calibration", "test")}
    assert sum(map(len, keys.values())) == apps.count() == len(set.union(*keys.values()))
    assert 0.05 < len(keys["calibration"]) / (len(keys["train"]) + len(keys["calibration"])) < 0.15
    assert keys["test"] == {r[0] for r in sampling.stratified_split(apps).filter("is_test").select("LoanID").collect()}


def test_error_analysis_refuses_other_splits(spark):
    """The test rows must be those that training left out: changed rows, labels, seed or share are refused; their order is not."""
    import pytest
    from pyspark.sql import functions as F

    from lendspark.plans import training
    apps = load_applications(spark, SF)
    kept = training.fingerprint(apps, 42, 0.1)
    training.require_fingerprint(apps.repartition(5).orderBy("LoanID"), kept)
    one = apps.agg(F.max("LoanID")).first()[0]
    for changed in (apps.where(F.col("LoanID") != one), apps.union(apps.where(F.col("LoanID") == one)),
                    apps.withColumn("Default", F.when(F.col("LoanID") == one, 1 - F.col("Default")).otherwise(F.col("Default")))):
        with pytest.raises(ValueError):
            training.require_fingerprint(changed, kept)
    for other in ({"seed": 43}, {"share": 0.0}):
        with pytest.raises(ValueError):
            training.require_fingerprint(apps, kept, **other)

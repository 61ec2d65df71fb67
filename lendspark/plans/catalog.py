"""Registry of the operator queries over the driver's tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame computed from
the whole ``orders``/``customer``/``events`` tables.  Column names match the
DuckDB oracles in ``oracles.py`` one to one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CATEGORICAL_COLUMNS, COSIGNER_WORDS, ID_COL, MONTHS_SUFFIX, PROFILE_KEYS, TARGET_COL
from ..functions.features import engineer_features, loan_profile
from ..functions.text import format_currency, format_money, format_percent, scenario_profile
from ..operators import checks, encode, metrics, monitor, rule_table, rules, sampling
from ..operators.validate import validate_applications
from ..session import ensure_checkpoint_dir, read_table, table_version
from ..sources import sinks
from ..sources.applications import APPLICATION_SCHEMA, load_applications, load_raw_applications, read_checked, require_target
from . import scoring, training

DRIFT_FEATURES = ["Income", "LoanAmount", "CreditScore", "InterestRate", "DTIRatio", "model_probability"]
DRIFT_CUTOFF = "1998-01-01"
FAIRNESS_ATTRIBUTES = ["Education", "EmploymentType", "MaritalStatus", "LoanPurpose"]


# --- shared building blocks ----------------------------------------------------------

# Fitted state (thresholds, feature spec) is computed once per application and version
# of the tables, like the artifacts a training run saves; the queries reuse it.
_STATE: dict = {}


def fitted(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, table_version(spark, sf_dir, ("orders", "customer")), name)
    if key not in _STATE:
        _STATE[key] = make()
    return _STATE[key]


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application table of a data folder (a lazy plan, built once per session)."""
    return fitted(spark, sf_dir, "apps", lambda: load_applications(spark, sf_dir))


def calibrated_threshold(spark: SparkSession, sf_dir: str) -> float:
    """T2 over all applications (model score vs label)."""
    return fitted(spark, sf_dir, "threshold", lambda: metrics.pick_threshold(applications(spark, sf_dir)))


def valid_ruled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    """Valid applications with features and rule steps, and the calibrated threshold."""
    def build():
        valid = validate_applications(applications(spark, sf_dir)).filter("is_valid").drop("violations", "is_valid")
        return scoring.rule_adjusted(valid)
    return fitted(spark, sf_dir, "ruled", build), calibrated_threshold(spark, sf_dir)


def scored_table(spark: SparkSession, sf_dir: str, keep: list[str] | None = None) -> DataFrame:
    def build():
        ruled, t = valid_ruled(spark, sf_dir)
        return scoring.decide(ruled, t, keep)
    return fitted(spark, sf_dir, ("scored", tuple(keep or ())), build)


def learned_spec(spark: SparkSession, sf_dir: str) -> encode.FeatureSpec:
    """C1 categories learned on the whole table."""
    return fitted(spark, sf_dir, "spec",
                  lambda: encode.learn_spec(engineer_features(applications(spark, sf_dir))))


def test_analysis(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, encode.FeatureSpec, float]:
    """Test split, encoded (unscaled), with model predictions at the threshold
    calibrated on the test split (the reference's error-analysis frame)."""
    eng = engineer_features(applications(spark, sf_dir))
    spec = learned_spec(spark, sf_dir)
    test = sampling.stratified_split(eng).filter("is_test")
    t = fitted(spark, sf_dir, "test_threshold", lambda: metrics.pick_threshold(test))
    enc = encode.onehot(test, spec, keep=[ID_COL, TARGET_COL, "model_probability"])
    pred = metrics.classify(F.col("model_probability"), t)
    out = enc.select(ID_COL, *[F.col(f"`{n}`") for n in spec.names],
                     F.col(TARGET_COL).alias("TrueLabel"), pred.alias("PredictedLabel"),
                     F.col("model_probability").alias("DefaultProbability"))
    out = out.withColumn("ErrorType", metrics.error_type(F.col("TrueLabel"), F.col("PredictedLabel")))
    return out, spec, t


# --- sources, features, validation ---------------------------------------------------

def q_applications(spark, sf_dir):
    # dates/times leave as ISO text so both engines hand over the same value type
    return applications(spark, sf_dir).withColumn("application_ts", F.col("application_ts").cast("string"))


def q_engineer_features(spark, sf_dir):
    eng = engineer_features(applications(spark, sf_dir))
    return eng.select(ID_COL, "Age", "Income", "LoanAmount", "DTIRatio", "Age_Income_Interaction")


def q_loan_profile(spark, sf_dir):
    prof = loan_profile(applications(spark, sf_dir))
    return prof.select(ID_COL, F.round("monthly_payment", 6).alias("monthly_payment"), "credit_band",
                       "loan_income_ratio", "loan_income_pct")


def q_application_display(spark, sf_dir):
    apps = applications(spark, sf_dir)
    return apps.select(
        ID_COL,
        format_money(F.col("Income")).alias("income_text"),
        format_money(F.col("LoanAmount")).alias("loan_text"),
        format_percent(F.col("model_probability") * 100.0).alias("model_score_text"),
        F.concat(F.col("MonthsEmployed").cast("string"), F.lit(MONTHS_SUFFIX)).alias("months_text"),
        F.when(F.col("HasCoSigner") == "Yes", COSIGNER_WORDS[True]).otherwise(COSIGNER_WORDS[False]).alias("cosigner_text"),
    )


def q_read_applications_csv(spark, sf_dir):
    """S1 + S4: applications written as CSV to the shared scratch folder and
    read back by column name with the application types (nothing inferred)."""
    from ..sources.applications import APPLICATION_SCHEMA, read_applications
    from .training import scratch_path
    apps = applications(spark, sf_dir)
    cols = [F.col(f.name) if f.name in apps.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in APPLICATION_SCHEMA.fields]
    path = scratch_path(spark, "applications-csv")
    apps.select(*cols).write.mode("overwrite").option("header", "true").csv(path)
    return read_applications(spark, path, "csv", key_type="long")


def q_csv_records(spark, sf_dir):
    """Lines of a file that are records, and those that are not, by reason; with places that are all different."""
    apps = applications(spark, sf_dir)
    path = os.path.join(ensure_checkpoint_dir(spark), f"lines-{uuid.uuid4().hex}")
    names = [f.name for f in APPLICATION_SCHEMA.fields]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in apps.columns else F.lit("") for c in names]
    whole, k = F.concat_ws(",", *text), F.col(ID_COL) % 40
    line = (F.when(k == 0, F.concat_ws(",", *text[:-3])).when(k == 1, F.concat(whole, F.lit(",more"))).when(k == 2, F.concat(F.lit('"'), whole))
            .when(k == 3, F.replace(whole, F.lit("Full-time"), F.lit("Full,time"))).when(k == 4, F.lit("  "))
            .when(k == 5, F.concat(F.lit('"a ""quoted"", id",'), F.concat_ws(",", *text[1:]))).otherwise(whole))
    apps.select(line.alias("value")).write.text(path)
    good, malformed, counts = read_checked(spark, path, header=False)
    total = counts.agg(*[F.sum(c).alias(c) for c in ("n_lines", "n_blank", "n_records")])
    rows = total.select(F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), F.col(c).alias("n"), F.col(c).alias("n_places")) for n, c in (
        ("lines", "n_lines"), ("blank", "n_blank"), ("records", "n_records"))])).alias("r")).select("r.*")
    keys = good.agg(F.lit("applications").alias("reason"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("Age").isNotNull()).alias("n_places"))
    return rows.unionByName(keys).unionByName(malformed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file", "line").alias("n_places")))


def q_decision_memo(spark, sf_dir):
    """the decision note of every scored application."""
    from ..functions.text import decision_memo
    s = scored_table(spark, sf_dir)
    return s.select(ID_COL, decision_memo(F.col("final_class"), F.col("model_score_pct"),
                                          F.col("adjusted_score_pct"), F.col("dti"), F.col("n_rules")).alias("memo"))


def q_validate_applications(spark, sf_dir):
    v = validate_applications(applications(spark, sf_dir))
    return v.select(ID_COL, "is_valid", F.concat_ws(",", "violations").alias("violations"))


# --- decisions and rules -------------------------------------------------------------

def q_score_applications(spark, sf_dir):
    return scored_table(spark, sf_dir).drop("rule_audit")


def q_rule_audit(spark, sf_dir):
    ruled, _ = valid_ruled(spark, sf_dir)
    return rules.explode_audit(ruled)


def q_rule_usage(spark, sf_dir):
    ruled, t = valid_ruled(spark, sf_dir)
    with_cls = ruled.withColumns({"model_class": metrics.classify(F.col("model_probability"), t),
                                  "final_class": metrics.classify(F.col("adjusted_probability"), t)})
    return monitor.rule_usage(with_cls, rules.rule_catalog(spark))


def q_rule_effect(spark, sf_dir):
    ruled, t = valid_ruled(spark, sf_dir)
    return monitor.rule_effect(ruled, t)


#: a rule table of another order and length than the built-in one; the last five cannot be used
USER_RULES = [
    ("thin_file", 10, "NumCreditLines < 2", 1.30), ("steep_rate", 20, "InterestRate >= 18.5 AND LoanTerm >= 36", 1.45),
    ("heavy_loan", 30, "LoanAmount / Income > 4", 1.25), ("young_borrower", 40, "Age BETWEEN 18 AND 24", 1.10),
    ("graduate", 50, "Education IN ('Master''s', 'PhD')", 0.85), ("married_owner", 60, "MaritalStatus = 'Married' AND HasMortgage = 'Yes'", 0.90),
    ("dependents", 70, "HasDependents = 'Yes'", 1.05), ("weak_score", 80, "CreditScore < 580", 1.60),
    ("long_service", 90, "MonthsEmployed >= 60", 0.70), ("business_purpose", 100, "lower(LoanPurpose) LIKE 'bus%'", 1.15),
    ("half_of_all", 110, "DTIRatio > 0.5", 0.50), ("cleared", 120, "CreditScore >= 800 AND HasCoSigner = 'Yes'", 0.0),
    ("open_bracket", 130, "(Age > 20", 1.1), ("no_such_field", 140, "Salary > 10", 1.1), ("number", 150, "Age + 1", 1.1),
    ("of_many", 160, "avg(Income) > 10", 1.1), ("mixed", 170, "Education > 3", 1.1),
]


def user_rules(spark: SparkSession) -> rule_table.RuleSet:
    """The table written to storage, in no order, and read back."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"rules-{uuid.uuid4().hex}")
    rows = [(*r, "user-1") for r in reversed(USER_RULES)]
    spark.createDataFrame(rows, "rule_id string, position int, predicate string, multiplier double, rule_version string").write.parquet(path)
    return rule_table.read_rules(spark, path)


def q_user_rule_scores(spark, sf_dir):
    """D4 with the rules of a table."""
    found = user_rules(spark)
    scored = scoring.score_applications(applications(spark, sf_dir), calibrated_threshold(spark, sf_dir), rules=found.rules,
                                        rule_version=found.version)
    audit = F.transform("rule_audit", lambda a: F.concat_ws(":", a["id"], a["after"].cast("decimal(20,2)").cast("string")))
    return scored.withColumn("rule_audit", F.concat_ws(",", audit))


def q_user_rule_usage(spark, sf_dir):
    """N1 over the rules of a table; refused rules with the reason and no counts."""
    found = user_rules(spark)
    t = calibrated_threshold(spark, sf_dir)
    valid = validate_applications(applications(spark, sf_dir)).filter("is_valid").drop("violations", "is_valid")
    ruled = scoring.rule_adjusted(valid, rules=found.rules)
    with_cls = ruled.withColumns({"model_class": metrics.classify(F.col("model_probability"), t),
                                  "final_class": metrics.classify(F.col("adjusted_probability"), t)})
    used = monitor.rule_usage(with_cls, rules.rule_catalog(spark, found.rules, found.version), found.rules)
    return used.withColumn("rejected", F.lit("")).unionByName(
        found.rejected_frame(spark).select("rule_id", "multiplier", F.col("reason").alias("rejected")), allowMissingColumns=True)


def q_decision_summary(spark, sf_dir):
    return monitor.decision_summary(scored_table(spark, sf_dir))


# --- thresholds and metrics ----------------------------------------------------------

def _rounded_rates(df):
    return df.withColumns({"recall": F.round("recall", 6), "precision": F.round("precision", 6)})


def q_threshold_curve(spark, sf_dir):
    return _rounded_rates(metrics.threshold_curve(applications(spark, sf_dir)))


def q_pick_threshold(spark, sf_dir):
    curve = metrics.threshold_curve(applications(spark, sf_dir))
    return _rounded_rates(metrics.pick_threshold_frame(curve).drop("recall_gap"))


def q_cost_threshold(spark, sf_dir):
    return monitor.cost_threshold(applications(spark, sf_dir))


def q_pr_curve(spark, sf_dir):
    return _rounded_rates(monitor.pr_curve(applications(spark, sf_dir)))


def q_binary_metrics(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    m = metrics.binary_metrics(a, "TrueLabel", "PredictedLabel", "DefaultProbability")
    return m.select("tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in
                                              ("accuracy", "precision", "recall", "f1",
                                               "mean_predicted_default_probability")])


def q_classification_report(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    return metrics.classification_report(a, "TrueLabel", "PredictedLabel")


def q_confusion_matrix(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    return metrics.confusion_matrix(a, "TrueLabel", "PredictedLabel")


def q_error_types(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    return a.select(ID_COL, "TrueLabel", "PredictedLabel", "DefaultProbability", "ErrorType")


def q_error_counts(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    return metrics.error_counts(a)


def q_error_feature_means(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    return metrics.error_feature_means(a.drop(ID_COL))


def q_group_sample(spark, sf_dir):
    a, _, _ = test_analysis(spark, sf_dir)
    return sampling.group_sample(a, "ErrorType", ["False_Positive", "False_Negative"]).select(ID_COL, "ErrorType")


# --- splitting and sampling ----------------------------------------------------------

def q_stratified_split(spark, sf_dir):
    return sampling.stratified_split(applications(spark, sf_dir)).select(ID_COL, TARGET_COL, "is_test")


def q_stratified_split_exact(spark, sf_dir):
    apps = applications(spark, sf_dir)
    return sampling.stratified_split_exact(apps, ID_COL, TARGET_COL).select(ID_COL, TARGET_COL, "is_test")


def q_class_balance(spark, sf_dir):
    s = sampling.stratified_split(applications(spark, sf_dir))
    s = s.withColumn("split", F.when(F.col("is_test"), "test").otherwise("train"))
    return sampling.class_balance(s, TARGET_COL, ["split"])


def q_stratified_sample(spark, sf_dir):
    train, _ = sampling.train_test(applications(spark, sf_dir))
    return sampling.stratified_sample(train).select(ID_COL, TARGET_COL)


# --- encoding and scaling ------------------------------------------------------------

def q_stratified_sample_capped(spark, sf_dir):
    """R4 with a cap below the training rows: exactly 5,000 of them."""
    train, _ = sampling.train_test(applications(spark, sf_dir))
    return sampling.stratified_sample(train, cap=5_000).select(ID_COL, TARGET_COL)


def q_split_fingerprint(spark, sf_dir):
    return training.split_fingerprint(applications(spark, sf_dir), share=training.CALIBRATION_SHARE)


def q_target_guard(spark, sf_dir):
    """Labels that come as text, checked and cast, then counted."""
    text = applications(spark, sf_dir).withColumn(TARGET_COL, F.col(TARGET_COL).cast("string"))
    return sampling.class_balance(require_target(text), by=["EmploymentType"])


def q_metric_sinks(spark, sf_dir):
    """A result table written as JSON and as CSV, and read back."""
    table = sampling.class_balance(applications(spark, sf_dir), by=["MaritalStatus"])
    base = os.path.join(ensure_checkpoint_dir(spark), f"sinks-{uuid.uuid4().hex}")
    sinks.write_metrics(table, f"{base}/json")
    sinks.write_metrics(table, f"{base}/csv", "csv")
    schema = f"MaritalStatus string, {TARGET_COL} int, n long"
    return (spark.read.schema(schema).json(f"{base}/json").withColumn("sink", F.lit("json"))
            .unionByName(spark.read.schema(schema).option("header", "true").csv(f"{base}/csv").withColumn("sink", F.lit("csv"))))


def q_application_profile(spark, sf_dir):
    """the display fields of every application."""
    names = ("Income", "LoanAmount", "CreditScore", "EmploymentType", "MonthsEmployed", "HasCoSigner")
    p = scenario_profile(*[F.col(c) for c in names])
    return (applications(spark, sf_dir).select(ID_COL, p.alias("p"))
            .select(ID_COL, *[F.element_at("p", F.lit(k)).alias(f"field_{i}") for i, k in enumerate(PROFILE_KEYS, 1)]))


def q_onehot_train(spark, sf_dir):
    eng = engineer_features(applications(spark, sf_dir))
    return encode.onehot(eng, learned_spec(spark, sf_dir))


def _fitted_spec(spark, sf_dir):
    eng = engineer_features(applications(spark, sf_dir))

    def fit():
        spec = learned_spec(spark, sf_dir)
        train = sampling.stratified_split(eng).filter("NOT is_test")
        return encode.fit_scaler(encode.onehot(train, spec), spec)

    return eng, fitted(spark, sf_dir, "scaler", fit)


def q_scaler_fit(spark, sf_dir):
    _, spec = _fitted_spec(spark, sf_dir)
    rows = [(i + 1, n, m, s) for i, (n, m, s) in enumerate(zip(spec.names, spec.means, spec.stds))]
    # the statistics came from one distributed aggregate; this frame only lists them
    df = spark.createDataFrame(rows, "position int, feature string, mean double, std double")
    return df.select("position", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def q_prepare_inference(spark, sf_dir):
    apps = applications(spark, sf_dir)
    _, spec = _fitted_spec(spark, sf_dir)
    test = sampling.stratified_split(apps).filter("is_test")
    scaled = encode.prepare_inference(test, spec)
    return scaled.select(ID_COL, *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in spec.names])


def q_rebuild_test(spark, sf_dir):
    a, spec, _ = test_analysis(spark, sf_dir)
    return a.select(ID_COL, F.col("TrueLabel").alias(TARGET_COL), *[F.col(f"`{n}`") for n in spec.names])


# --- checks and monitoring -----------------------------------------------------------

def q_latency_summary(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    calls = ev.select(F.to_date("ts").alias("day"), F.col("value").alias("latency_ms"),
                      (F.col("event_type") == "error").alias("is_error"))
    out = checks.latency_summary(calls, "latency_ms", "is_error", ["day"])
    return out.withColumn("day", F.col("day").cast("string"))


def q_check_rollup(spark, sf_dir):
    v = validate_applications(applications(spark, sf_dir))
    return checks.check_rollup(v, "is_valid", ["LoanPurpose"])


def q_feature_drift(spark, sf_dir):
    eng = engineer_features(applications(spark, sf_dir))
    current = F.col("application_ts") >= F.lit(DRIFT_CUTOFF).cast("timestamp_ntz")
    return monitor.feature_drift(eng, DRIFT_FEATURES, current)


def q_periodic_metrics(spark, sf_dir):
    out = monitor.periodic_metrics(scored_table(spark, sf_dir, keep=[TARGET_COL, "application_ts"]))
    return out.withColumn("period_start", F.col("period_start").cast("string"))


def q_group_error_rates(spark, sf_dir):
    s = scored_table(spark, sf_dir, keep=[TARGET_COL] + FAIRNESS_ATTRIBUTES)
    return monitor.group_error_rates(s, FAIRNESS_ATTRIBUTES)


def q_domain_report(spark, sf_dir):
    return monitor.domain_report(applications(spark, sf_dir), CATEGORICAL_COLUMNS)


# --- careless input: bad values in every field ----------------------------------------

def q_raw_validate(spark, sf_dir):
    v = validate_applications(load_raw_applications(spark, sf_dir))
    return v.select(ID_COL, "is_valid", F.concat_ws(",", "violations").alias("violations"))


def q_raw_violations(spark, sf_dir):
    """How often each violation code occurs."""
    v = validate_applications(load_raw_applications(spark, sf_dir))
    return v.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def q_raw_features(spark, sf_dir):
    """F1 on missing, unparsable and NaN inputs, and the currency form of the amounts."""
    eng = engineer_features(load_raw_applications(spark, sf_dir))
    # adding 0.0 turns the -0.0 of a coerced field times a negative amount into 0.0
    return eng.select(ID_COL, (F.round("DTIRatio", 9) + F.lit(0.0)).alias("DTIRatio"),
                      (F.round("Age_Income_Interaction", 6) + F.lit(0.0)).alias("Age_Income_Interaction"),
                      format_currency(F.col("LoanAmount")).alias("loan_text"))


def q_raw_domain_report(spark, sf_dir):
    return monitor.domain_report(load_raw_applications(spark, sf_dir), CATEGORICAL_COLUMNS)


def q_raw_onehot(spark, sf_dir):
    """Categories learned on clean rows, applied to rows with unseen and missing ones."""
    spec = learned_spec(spark, sf_dir)
    enc = encode.onehot(engineer_features(load_raw_applications(spark, sf_dir)), spec)
    words = [n for n in spec.names if n not in spec.numeric]
    return enc.select(ID_COL, *[F.col(f"`{n}`") for n in words])


SQL_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "applications": q_applications,
    "engineer_features": q_engineer_features,
    "loan_profile": q_loan_profile,
    "application_display": q_application_display,
    "validate_applications": q_validate_applications,
    "read_applications_csv": q_read_applications_csv,
    "csv_records": q_csv_records,
    "decision_memo": q_decision_memo,
    "score_applications": q_score_applications,
    "rule_audit": q_rule_audit,
    "rule_usage": q_rule_usage,
    "user_rule_scores": q_user_rule_scores,
    "user_rule_usage": q_user_rule_usage,
    "rule_effect": q_rule_effect,
    "decision_summary": q_decision_summary,
    "threshold_curve": q_threshold_curve,
    "pick_threshold": q_pick_threshold,
    "cost_threshold": q_cost_threshold,
    "pr_curve": q_pr_curve,
    "binary_metrics": q_binary_metrics,
    "classification_report": q_classification_report,
    "confusion_matrix": q_confusion_matrix,
    "error_types": q_error_types,
    "error_counts": q_error_counts,
    "error_feature_means": q_error_feature_means,
    "group_sample": q_group_sample,
    "stratified_split": q_stratified_split,
    "stratified_split_exact": q_stratified_split_exact,
    "class_balance": q_class_balance,
    "stratified_sample": q_stratified_sample,
    "stratified_sample_capped": q_stratified_sample_capped,
    "split_fingerprint": q_split_fingerprint,
    "target_guard": q_target_guard,
    "metric_sinks": q_metric_sinks,
    "application_profile": q_application_profile,
    "onehot_train": q_onehot_train,
    "scaler_fit": q_scaler_fit,
    "prepare_inference": q_prepare_inference,
    "rebuild_test": q_rebuild_test,
    "latency_summary": q_latency_summary,
    "check_rollup": q_check_rollup,
    "feature_drift": q_feature_drift,
    "periodic_metrics": q_periodic_metrics,
    "group_error_rates": q_group_error_rates,
    "domain_report": q_domain_report,
    "raw_validate": q_raw_validate,
    "raw_violations": q_raw_violations,
    "raw_features": q_raw_features,
    "raw_domain_report": q_raw_domain_report,
    "raw_onehot": q_raw_onehot,
}


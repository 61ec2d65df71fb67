"""The batch decision job (and the plan the stream reuses).

validate -> engineer features -> model probability -> rule chain -> classify.
Every step is a narrow projection or filter, so the whole job is one stage
without a shuffle: it scales linearly with the number of input files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BUSINESS_RULE_VERSION, ID_COL
from ..functions.features import engineer_features
from ..functions.text import decision_label
from ..operators.encode import FeatureSpec, feature_array
from ..operators.metrics import classify
from ..operators.models import score_probability
from ..operators.rules import RULES, Rule, applied_rule_ids, apply_rules, fired_count, rule_audit_column
from ..operators.validate import validate_applications

SCORE_COLUMNS = [
    ID_COL, "model_probability", "adjusted_probability", "model_class", "final_class", "model_score_pct",
    "adjusted_score_pct", "dti", "applied_rules", "n_rules", "rule_audit", "rule_version", "threshold",
    "decision",
]


def rule_adjusted(df: DataFrame, prob_col: str = "model_probability", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Features + rule chain (keeps the per-step columns for the audit)."""
    eng = engineer_features(df)
    if prob_col != "model_probability":
        eng = eng.withColumn("model_probability", F.col(prob_col).cast("double"))
    return apply_rules(eng, "model_probability", "adjusted_probability", rules=rules)


def model_adjusted(df: DataFrame, model, spec: FeatureSpec, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Features, once for both the model and the rules: C5 -> M4 -> D2."""
    eng = engineer_features(df.drop("model_probability"))
    prepared = eng.withColumn("_x", feature_array(eng, spec))
    return apply_rules(score_probability(model, prepared, x_col="_x").drop("_x"), "model_probability", "adjusted_probability",
                       rules=rules)


def decide(ruled: DataFrame, threshold: float, keep: list[str] | None = None, rules: Sequence[Rule] = RULES,
           rule_version: str = BUSINESS_RULE_VERSION) -> DataFrame:
    """Turn a frame adjusted by these rules into the scored record."""
    t = float(threshold)
    model_class = classify(F.col("model_probability"), t)
    final_class = classify(F.col("adjusted_probability"), t)
    return ruled.select(
        *(keep or []),
        F.col(ID_COL),
        F.col("model_probability"),
        F.col("adjusted_probability"),
        model_class.alias("model_class"),
        final_class.alias("final_class"),
        F.round(F.col("model_probability") * 100.0, 2).alias("model_score_pct"),
        F.round(F.col("adjusted_probability") * 100.0, 2).alias("adjusted_score_pct"),
        F.round(F.col("DTIRatio"), 4).alias("dti"),
        applied_rule_ids(rules=rules).alias("applied_rules"),
        fired_count(rules).alias("n_rules"),
        rule_audit_column(rules=rules).alias("rule_audit"),
        F.lit(rule_version).alias("rule_version"),
        F.round(F.lit(t), 3).alias("threshold"),
        decision_label(final_class).alias("decision"),
    )


def score_applications(apps: DataFrame, threshold: float, prob_col: str = "model_probability",
                       keep: list[str] | None = None, rules: Sequence[Rule] = RULES,
                       rule_version: str = BUSINESS_RULE_VERSION) -> DataFrame:
    """D4 on a table: only valid rows are scored (see ``quarantine`` for the rest)."""
    valid = validate_applications(apps).filter("is_valid").drop("violations", "is_valid")
    return decide(rule_adjusted(valid, prob_col, rules), threshold, keep, rules, rule_version)


def score_with_model(apps: DataFrame, model, spec: FeatureSpec, threshold: float,
                     keep: list[str] | None = None, rules: Sequence[Rule] = RULES,
                     rule_version: str = BUSINESS_RULE_VERSION) -> DataFrame:
    """D4 with the model in the loop: V1 -> C5 -> M4 -> D2 -> M5 for the valid rows."""
    valid = validate_applications(apps).filter("is_valid").drop("violations", "is_valid")
    return decide(model_adjusted(valid, model, spec, rules), threshold, keep, rules, rule_version)


def quarantine(apps: DataFrame) -> DataFrame:
    """Rows refused by validation, with their violation codes."""
    return validate_applications(apps).filter("NOT is_valid").select(ID_COL, "violations")

"""Monitoring and rule-calibration reports.

All of them are single-pass conditional aggregates (partial aggregation on
the map side, a few rows shuffled), or read the small threshold grid.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORICAL_COLUMNS, DOMAINS
from .metrics import _zero_div, threshold_counts, with_rates
from .quantiles import kth_smallest
from .rules import RULES, Rule

PSI_FLOOR = 1e-4
# --- Fixed values: PSI alarm levels (common industry convention) ---
PSI_LEVELS = [(0.10, "stable"), (0.25, "moderate")]
PSI_TOP_LEVEL = "significant"


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def rule_usage(ruled: DataFrame, catalog: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """N1 (+D1): how often each rule fires and how often it flips a decision.

    ``ruled`` carries the rule flags ``_f<position>`` and ``model_class`` /
    ``final_class``.
    """
    changed = F.col("model_class") != F.col("final_class")
    aggs = [F.count(F.lit(1)).alias("n_total")]
    for r in rules:
        f = F.col(f"_f{r.position}")
        aggs += [_cnt(f).alias(f"fired_{r.position}"), _cnt(f & changed).alias(f"changed_{r.position}")]
    wide = ruled.agg(*aggs)
    stack = ", ".join(f"{r.position}, fired_{r.position}, changed_{r.position}" for r in rules)
    long = wide.selectExpr("n_total", f"stack({len(rules)}, {stack}) AS (position, n_fired, n_decision_changed)")
    # the catalog has a row per rule, at most rule_table.MAX_RULES: a proven broadcast bound
    return (long.join(F.broadcast(catalog.select("position", "rule_id", "direction", "multiplier")), "position")
            .select(F.col("position").cast("int"), "rule_id", "direction", "multiplier", "n_fired",
                    "n_decision_changed",
                    F.round(_zero_div(F.col("n_fired"), F.col("n_total")), 6).alias("fire_rate")))


def _clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rule_effect(ruled: DataFrame, threshold: float, label_col: str = "Default") -> DataFrame:
    """Leave-one-rule-out effect on FP and recall.

    One aggregate of 8 variants (0 keeps all rules, i leaves rule i out) times 4
    conditional counts, so a task sends one row; ``stack`` turns the single
    row into a row per variant, which carries the baseline along.
    """
    t = F.lit(float(threshold))
    names = ["all_rules"] + [f"without_{r.id}" for r in RULES]
    y = F.col(label_col)

    variants = range(len(names))
    df = ruled.select(y.alias("_y"), *[f"_f{r.position}" for r in RULES],
                      *[F.col("model_probability").cast("double").alias(f"_q{i}") for i in variants])
    for r in RULES:                 # one projection per rule, so no expression is written out twice
        fired = F.col(f"_f{r.position}")
        df = df.withColumns({f"_q{i}": F.when(fired, _clamp01(F.col(f"_q{i}") * F.lit(float(r.multiplier)))).otherwise(F.col(f"_q{i}"))
                             for i in variants if i != r.position})
    predicted = df.select("_y", *[(F.col(f"_q{i}") >= t).alias(f"_p{i}") for i in variants])
    yy, counts = F.col("_y"), []
    for i in range(len(names)):
        p = F.col(f"_p{i}")
        counts += [_cnt((yy == 1) & p).alias(f"tp{i}"), _cnt((yy == 0) & p).alias(f"fp{i}"),
                   _cnt((yy == 1) & ~p).alias(f"fn{i}"), _cnt((yy == 0) & ~p).alias(f"tn{i}")]
    one = predicted.agg(*counts)
    rows = ", ".join(f"'{n}', {i}, tp{i}, fp{i}, fn{i}, tn{i}, tp0, fp0, fn0" for i, n in enumerate(names))
    long = with_rates(one.selectExpr(f"stack({len(names)}, {rows}) AS (variant, variant_order, tp, fp, fn, tn, _tp, _fp, _fn)"))
    base_recall = _zero_div(F.col("_tp"), F.col("_tp") + F.col("_fn"))
    return long.select(
        "variant", F.col("variant_order").cast("int"), "tp", "fp", "fn", "tn",
        F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"),
        (F.col("fp") - F.col("_fp")).alias("fp_added_without_rule"),
        F.round(base_recall - F.col("recall"), 6).alias("recall_lost_without_rule"),
    )


def cost_threshold(df: DataFrame, cost_fn: float = 5.0, cost_fp: float = 1.0, label_col: str = "Default",
                   prob_col: str = "model_probability", low: int = 100, high: int = 900) -> DataFrame:
    """The grid threshold minimising ``cost_fn*FN + cost_fp*FP`` (lowest t on ties)."""
    c = threshold_counts(df, label_col, prob_col).filter((F.col("step") >= low) & (F.col("step") <= high))
    cost = F.lit(float(cost_fn)) * F.col("fn") + F.lit(float(cost_fp)) * F.col("fp")
    return (with_rates(c).withColumn("cost", cost).orderBy(F.col("cost"), F.col("step")).limit(1)
            .select("step", "threshold", "tp", "fp", "fn", "tn", "cost",
                    F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")))


def pr_curve(df: DataFrame, label_col: str = "Default", prob_col: str = "model_probability") -> DataFrame:
    """Precision-recall at every grid point 0.000 ... 1.000."""
    return with_rates(threshold_counts(df, label_col, prob_col)).select(
        "step", "threshold", "tp", "fp", "recall", "precision")


def _psi_level(psi: Column) -> Column:
    out = F.lit(PSI_TOP_LEVEL)
    for bound, name in reversed(PSI_LEVELS):
        out = F.when(psi < bound, F.lit(name)).otherwise(out)
    return out


def feature_drift(df: DataFrame, features: list[str], is_current: Column, n_bins: int = 10) -> DataFrame:
    """Population stability index of each feature, baseline vs current.

    Bin edges are the exact baseline quantiles (the ``ceil(i*n/n_bins)``-th
    smallest value, i = 1..n_bins-1), found 16 bits at a time; a value
    falls in the bin counting the edges strictly below it.  Shares are
    floored at 1e-4 before ``sum((c - b) * ln(c / b))``.
    """
    long = df.select(is_current.alias("is_current"),
                     F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                                  F.col(f).cast("double").alias("x")) for f in features])).alias("kv")
                     ).select("is_current", "kv.feature", "kv.x").filter(F.col("x").isNotNull() & ~F.isnan("x"))
    base = long.filter(~F.col("is_current"))
    n_base = base.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    ranks = n_base.select("feature", F.explode(F.sequence(F.lit(1), F.lit(n_bins - 1))).alias("rank_id"), "n") \
        .select("feature", "rank_id", ((F.col("rank_id") * F.col("n") + (n_bins - 1)) / n_bins).cast("long").alias("k"))
    edges = kth_smallest(base, ["feature"], "x", ranks)
    # edges: (features x (n_bins-1)) rows -- bounded by the feature list, so broadcast
    edge_arr = edges.groupBy("feature").agg(F.collect_list("value").alias("edges"))
    n_edges = n_bins - 1
    bin_ = sum((F.coalesce((F.col("edges")[i] < F.col("x")).cast("int"), F.lit(0)) for i in range(n_edges)),
               F.lit(0))
    binned = long.join(F.broadcast(edge_arr), "feature").select("feature", "is_current", bin_.alias("bin"))
    counts = binned.groupBy("feature", "bin").agg(_cnt(~F.col("is_current")).alias("nb"),
                                                  _cnt(F.col("is_current")).alias("nc"))
    tot = counts.groupBy("feature").agg(F.sum("nb").alias("total_b"), F.sum("nc").alias("total_c"))
    # every bin of the grid, including empty ones
    grid = tot.select("feature", "total_b", "total_c",
                      F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["nb", "nc"])
    b = F.greatest(_zero_div(F.col("nb"), F.col("total_b")), F.lit(PSI_FLOOR))
    c = F.greatest(_zero_div(F.col("nc"), F.col("total_c")), F.lit(PSI_FLOOR))
    part = (c - b) * F.log(c / b)
    res = full.groupBy("feature").agg(F.sum(part).alias("psi"), F.first("total_b").alias("n_baseline"),
                                      F.first("total_c").alias("n_current"))
    return res.select("feature", F.round("psi", 6).alias("psi"), _psi_level(F.col("psi")).alias("level"),
                      F.col("n_baseline").cast("long"), F.col("n_current").cast("long"))


def decision_metrics_aggs(label_col: str = "Default", pred_col: str = "final_class",
                          prob_col: str = "adjusted_probability") -> list[Column]:
    y, p = F.col(label_col), F.col(pred_col)
    return [F.count(F.lit(1)).alias("n"), _cnt(y == 1).alias("n_default"), _cnt(p == 0).alias("n_approvable"),
            _cnt((y == 1) & (p == 1)).alias("tp"), _cnt((y == 0) & (p == 1)).alias("fp"),
            _cnt((y == 1) & (p == 0)).alias("fn"), _cnt((y == 0) & (p == 0)).alias("tn"),
            F.avg(prob_col).alias("_mean_p")]


def decision_metrics_sums(label_col: str = "Default", pred_col: str = "final_class",
                          prob_col: str = "adjusted_probability") -> list[Column]:
    """The same as parts that add up: counts, and the sum in place of the mean."""
    return [*decision_metrics_aggs(label_col, pred_col, prob_col)[:-1], F.sum(prob_col).alias("sum_p")]


def decision_metrics_rates(df: DataFrame) -> DataFrame:
    return with_rates(df).withColumns({
        "recall": F.round("recall", 6), "precision": F.round("precision", 6),
        "default_rate": F.round(_zero_div(F.col("n_default"), F.col("n")), 6),
        "mean_adjusted_probability": F.round("_mean_p", 6),
    }).drop("_mean_p")


def periodic_metrics(scored: DataFrame, ts_col: str = "application_ts", unit: str = "quarter",
                     label_col: str = "Default") -> DataFrame:
    """N6 (batch): decision metrics per calendar period of the application time."""
    period = F.to_date(F.date_trunc(unit, F.col(ts_col))).alias("period_start")
    agg = scored.groupBy(period).agg(*decision_metrics_aggs(label_col))
    return decision_metrics_rates(agg)


def group_error_rates(scored: DataFrame, attributes: list[str], label_col: str = "Default") -> DataFrame:
    """Error rates of the final decision per value of each attribute."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value"))
                                for a in attributes]))
    long = scored.select(F.col(label_col), "final_class", "adjusted_probability", pairs.alias("kv")) \
        .select(label_col, "final_class", "adjusted_probability", "kv.attribute", "kv.value")
    agg = long.groupBy("attribute", "value").agg(*decision_metrics_aggs(label_col))
    out = decision_metrics_rates(agg)
    return out.withColumns({
        "false_positive_rate": F.round(_zero_div(F.col("fp"), F.col("fp") + F.col("tn")), 6),
        "false_negative_rate": F.round(_zero_div(F.col("fn"), F.col("fn") + F.col("tp")), 6),
        "approval_rate": F.round(_zero_div(F.col("n_approvable"), F.col("n")), 6),
    })


def domain_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULL and out-of-domain categories per column (both encode as the baseline)."""
    columns = [c for c in (columns or CATEGORICAL_COLUMNS) if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        col = F.col(c)
        aggs += [_cnt(col.isNull()).alias(f"null{i}"),
                 _cnt(col.isNotNull() & ~col.isin(*DOMAINS[c])).alias(f"unk{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', null{i}, unk{i}" for i, c in enumerate(columns))
    return wide.selectExpr("n_rows", f"stack({len(columns)}, {stack}) AS (column_name, n_null, n_unknown)") \
        .select("column_name", "n_rows", "n_null", "n_unknown",
                (F.col("n_null") + F.col("n_unknown")).alias("n_encoded_as_baseline"))


def decision_summary(scored: DataFrame) -> DataFrame:
    """Model class x final class counts (where the rules changed the decision)."""
    return scored.groupBy("model_class", "final_class").agg(F.count(F.lit(1)).alias("n"))


def psi_value(base_share: float, cur_share: float) -> float:
    """Scalar PSI term (used by tests)."""
    b, c = max(base_share, PSI_FLOOR), max(cur_share, PSI_FLOOR)
    return (c - b) * math.log(c / b)

"""Threshold calibration (T1, T2) and evaluation reports.

The threshold sweep is one pass over the data: every probability is mapped
to the highest grid step it clears, the steps are histogrammed with a
partial (map-side) aggregation, and suffix sums over the 1,002-row grid give
true/false positives at every threshold at once.  There is no cross join of
thresholds with rows and no sort of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..constants import (ERROR_TYPE_LABELS, ERROR_TYPE_UNKNOWN, THRESHOLD_GRID_HIGH, THRESHOLD_GRID_LOW,
                         THRESHOLD_GRID_SCALE, TARGET_RECALL)


def _zero_div(num: Column, den: Column) -> Column:
    """num / den as double, 0.0 when den is 0 (sklearn's zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def grid_step(prob: Column, scale: int = THRESHOLD_GRID_SCALE) -> Column:
    """Highest step j in [0, scale] with ``j/scale <= p`` (compared as doubles); -1 if none.

    ``floor(p*scale)`` can be one off next to a grid point because ``p*scale``
    rounds; the two comparisons below correct that exactly.  NULL/NaN never
    clear a threshold.
    """
    p = prob.cast("double")
    pc = F.least(F.greatest(p, F.lit(-1.0)), F.lit(2.0))
    k0 = F.least(F.greatest(F.floor(pc * scale), F.lit(-1)), F.lit(scale)).cast("long")
    below = (k0 >= 0) & ((k0.cast("double") / F.lit(float(scale))) > p)
    above = (k0 < scale) & (((k0 + 1).cast("double") / F.lit(float(scale))) <= p)
    k = F.when(below, k0 - 1).when(above, k0 + 1).otherwise(k0)
    return F.when(p.isNull() | F.isnan(p), F.lit(-1).cast("long")).otherwise(k)


def threshold_counts(df: DataFrame, label_col: str = "Default", prob_col: str = "model_probability",
                     scale: int = THRESHOLD_GRID_SCALE) -> DataFrame:
    """Counts at every grid threshold ``step/scale``, step = 0..scale.

    Returns step, threshold, tp, fp, fn, tn (BIGINT).  Rows whose label is
    not 0/1 are ignored, as a binary metric would.
    """
    spark = df.sparkSession
    lab = F.col(label_col).cast("int")
    hist = (df.select(grid_step(F.col(prob_col), scale).alias("step"), lab.alias("y"))
            .filter(F.col("y").isin(0, 1))
            .groupBy("step")
            .agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).cast("long").alias("pos"),
                 F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).cast("long").alias("neg")))
    # The histogram has at most scale + 2 rows, a proven bound: broadcast it.
    grid = spark.range(-1, scale + 1).withColumnRenamed("id", "step")
    joined = grid.join(F.broadcast(hist), "step", "left").fillna(0, ["pos", "neg"])
    suffix = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy(F.lit(1))
    out = joined.select(
        "step",
        F.sum("pos").over(suffix).alias("tp"),
        F.sum("neg").over(suffix).alias("fp"),
        F.sum("pos").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("P"),
        F.sum("neg").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("N"),
    ).filter(F.col("step") >= 0)
    return out.select(
        "step",
        (F.col("step").cast("double") / F.lit(float(scale))).alias("threshold"),
        F.col("tp").cast("long").alias("tp"),
        F.col("fp").cast("long").alias("fp"),
        (F.col("P") - F.col("tp")).cast("long").alias("fn"),
        (F.col("N") - F.col("fp")).cast("long").alias("tn"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "recall": _zero_div(F.col("tp"), F.col("tp") + F.col("fn")),
        "precision": _zero_div(F.col("tp"), F.col("tp") + F.col("fp")),
    })


def threshold_curve(df: DataFrame, label_col: str = "Default", prob_col: str = "model_probability",
                    low: int = THRESHOLD_GRID_LOW, high: int = THRESHOLD_GRID_HIGH) -> DataFrame:
    """Recall and precision for t = low/1000 ... high/1000."""
    counts = threshold_counts(df, label_col, prob_col)
    return with_rates(counts.filter((F.col("step") >= low) & (F.col("step") <= high)))


def pick_threshold_frame(curve: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """The row minimising (|recall - target|, -precision); lowest t wins ties."""
    gap = F.abs(F.col("recall") - F.lit(float(target_recall)))
    return (curve.withColumn("recall_gap", gap)
            .orderBy(F.col("recall_gap").asc(), F.col("precision").desc(), F.col("step").asc())
            .limit(1))


def pick_threshold(df: DataFrame, label_col: str = "Default", prob_col: str = "model_probability",
                   target_recall: float = TARGET_RECALL) -> float:
    """T2 as a scalar (one 1-row action); the grid always yields a value."""
    row = pick_threshold_frame(threshold_curve(df, label_col, prob_col), target_recall).first()
    return float(row["threshold"])


def classify(prob: Column, threshold: float) -> Column:
    """M5: inclusive threshold, ``p >= t`` -> 1."""
    return F.when(prob >= F.lit(float(threshold)), 1).otherwise(0)


def _counter(weight_col: str | None):
    """Conditional count; with ``weight_col`` each row counts as its weight
    (a pre-aggregated (actual, predicted, n) table)."""
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1)

    def cnt(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w).otherwise(0)), F.lit(0)).cast("long")

    return cnt


def confusion_counts(df: DataFrame, label_col: str, pred_col: str, weight_col: str | None = None) -> DataFrame:
    """One-row conditional-sum aggregate: tp, fp, tn, fn."""
    y, p = F.col(label_col), F.col(pred_col)
    cnt = _counter(weight_col)

    return df.agg(cnt((y == 1) & (p == 1)).alias("tp"), cnt((y == 0) & (p == 1)).alias("fp"),
                  cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 1) & (p == 0)).alias("fn"))


def binary_metrics(df: DataFrame, label_col: str = "Default", pred_col: str = "prediction",
                   prob_col: str | None = "model_probability", weight_col: str | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (zero division -> 0), mean probability."""
    y, p = F.col(label_col), F.col(pred_col)
    cnt = _counter(weight_col)

    aggs = [cnt((y == 1) & (p == 1)).alias("tp"), cnt((y == 0) & (p == 1)).alias("fp"),
            cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 1) & (p == 0)).alias("fn")]
    if prob_col:
        aggs.append(F.avg(F.col(prob_col)).alias("mean_predicted_default_probability"))
    c = df.agg(*aggs)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    out = c.select(
        "*",
        _zero_div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _zero_div(tp, tp + fp).alias("precision"),
        _zero_div(tp, tp + fn).alias("recall"),
        _zero_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    return out


def confusion_matrix(df: DataFrame, label_col: str = "Default", pred_col: str = "prediction",
                     weight_col: str | None = None) -> DataFrame:
    """Dense 2x2 (rows actual 0/1, columns predicted_0/predicted_1), zero cells kept."""
    c = confusion_counts(df, label_col, pred_col, weight_col)
    return c.selectExpr("stack(2, 0, tn, fp, 1, fn, tp) AS (actual, predicted_0, predicted_1)") \
        .select(F.col("actual").cast("int"), "predicted_0", "predicted_1")


def classification_report(df: DataFrame, label_col: str = "Default", pred_col: str = "prediction",
                          weight_col: str | None = None) -> DataFrame:
    """Per-class precision/recall/f1/support, accuracy, macro and weighted averages."""
    c = confusion_counts(df, label_col, pred_col, weight_col)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    p1, r1 = _zero_div(tp, tp + fp), _zero_div(tp, tp + fn)
    p0, r0 = _zero_div(tn, tn + fn), _zero_div(tn, tn + fp)
    f1_1 = _zero_div(2 * tp, 2 * tp + fp + fn)
    f1_0 = _zero_div(2 * tn, 2 * tn + fn + fp)
    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    acc = _zero_div(tp + tn, n)
    w = c.select(p0.alias("p0"), r0.alias("r0"), f1_0.alias("f0"), s0.alias("s0"),
                 p1.alias("p1"), r1.alias("r1"), f1_1.alias("f1"), s1.alias("s1"), acc.alias("acc"),
                 n.cast("double").alias("n"))
    rows = w.selectExpr(
        "stack(5,"
        " '0', p0, r0, f0, s0,"
        " '1', p1, r1, f1, s1,"
        " 'accuracy', acc, acc, acc, n,"
        " 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,"
        " 'weighted avg', CASE WHEN n = 0 THEN 0D ELSE (p0 * s0 + p1 * s1) / n END,"
        "   CASE WHEN n = 0 THEN 0D ELSE (r0 * s0 + r1 * s1) / n END,"
        "   CASE WHEN n = 0 THEN 0D ELSE (f0 * s0 + f1 * s1) / n END, n"
        ") AS (label, precision, recall, f1_score, support)")
    return rows.select("label", *[F.round(F.col(x), 6).alias(x) for x in ("precision", "recall", "f1_score")],
                       F.col("support").cast("long").alias("support"))


def error_type(label: Column, pred: Column) -> Column:
    """TP/TN/FP/FN label, Unknown otherwise."""
    out = F.lit(ERROR_TYPE_UNKNOWN)
    for (y, p), name in reversed(list(ERROR_TYPE_LABELS.items())):
        out = F.when((label == y) & (pred == p), F.lit(name)).otherwise(out)
    return out


def error_counts(df: DataFrame, type_col: str = "ErrorType") -> DataFrame:
    """E5: count per error type, most frequent first."""
    return df.groupBy(type_col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(),
                                                                              F.col(type_col))


def error_feature_means(df: DataFrame, type_col: str = "ErrorType", decimals: int = 4) -> DataFrame:
    """Mean of every numeric column per error type, rounded."""
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    return df.groupBy(type_col).agg(*[F.round(F.avg(F.col(f"`{c}`")), decimals).alias(c) for c in numeric])

"""Training job (A) and error-analysis job (C) of the reference, on Spark.

A: applications -> features -> one-hot (categories from the whole table)
   -> hash split -> scaler fitted on train -> SMOTE on train -> boosted
   trees -> recall-targeted threshold on the calibration split (or, as the
   reference does, on the test split) -> probabilities on test -> metrics
   -> saved model, spec and threshold.
C: the same split is a filter, so the test frame is rebuilt exactly; it is
   scored, labelled TP/TN/FP/FN, summarised per group and attributed.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GBT_PARAMS, ID_COL, RANDOM_STATE, TARGET_COL, TARGET_RECALL
from ..functions.features import engineer_features
from ..operators import artifacts, checks, encode, explain, metrics, models, sampling, smote
from ..session import cut_lineage, ensure_checkpoint_dir


@dataclass
class TrainingData:
    spec: encode.FeatureSpec
    train: DataFrame          # LoanID, Default, scaled features, x (array<double>)
    test: DataFrame
    calibration: DataFrame | None = None


@dataclass
class TrainedModel:
    spec: encode.FeatureSpec
    model: object
    threshold: float
    test_scored: DataFrame    # LoanID, Default, x, model_probability
    balanced: DataFrame
    fingerprint: dict         # of the splits it was trained and tested on


CALIBRATION_SHARE = 0.1      # of the rows that are not test rows


def three_splits(df: DataFrame, seed: int = RANDOM_STATE, share: float = CALIBRATION_SHARE) -> DataFrame:
    """Adds ``split``: test (R1), calibration or train, each a pure function of the row key."""
    own = sampling.key_hash32(F.col(ID_COL), f"#calibration{seed}") % sampling.BUCKETS < int(round(share * sampling.BUCKETS))
    return sampling.stratified_split(df, seed=seed).withColumn(
        "split", F.when(F.col("is_test"), "test").when(own, "calibration").otherwise("train")).drop("is_test")


def split_fingerprint(df: DataFrame, seed: int = RANDOM_STATE, share: float = 0.0) -> DataFrame:
    """Per split its rows, defaults, and sum and exclusive or of hashes of (key, label): the same in any order of the rows.

    Other rows, labels, seed or shares give another table.
    """
    print_ = sampling.key_hash32(F.concat_ws("|", F.col(ID_COL).cast("string"), F.col(TARGET_COL).cast("string")), "#print")
    return (three_splits(df, seed, share).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(TARGET_COL).cast("long").alias("n_default"), F.sum(print_).alias("hash_sum"), F.bit_xor(print_).alias("hash_xor")))


def fingerprint(apps: DataFrame, seed: int, share: float) -> dict:
    """The fingerprint as it is kept with the artifacts: three rows."""
    return {"seed": seed, "share": share, "splits": {r["split"]: [r["n"], r["n_default"], r["hash_sum"], r["hash_xor"]]
                                                     for r in split_fingerprint(apps, seed, share).collect()}}


def require_fingerprint(apps: DataFrame, kept: dict, seed: int | None = None, share: float | None = None) -> None:
    """Refuses applications, or a seed or share, whose splits are not those of the fingerprint."""
    now = fingerprint(apps, kept["seed"] if seed is None else seed, kept["share"] if share is None else share)
    differ = sorted(s for s in {*now["splits"], *kept["splits"]} if list(now["splits"].get(s, ())) != list(kept["splits"].get(s, ())))
    if differ:
        raise ValueError(f"the rebuilt splits differ from the trained ones: {', '.join(differ)}")


def prepare_training(apps: DataFrame, seed: int = RANDOM_STATE, calibrate_on: str = "test") -> TrainingData:
    """Scaled splits; with ``calibrate_on="calibration"`` a third split is kept out of training."""
    if calibrate_on not in ("calibration", "test"):
        raise ValueError(f"calibrate_on must be 'calibration' or 'test', not {calibrate_on!r}")
    eng = engineer_features(apps)
    spec = encode.learn_spec(eng)
    flagged = three_splits(eng, seed, CALIBRATION_SHARE if calibrate_on == "calibration" else 0.0)
    parts = {name: flagged.filter(F.col("split") == name).drop("split") for name in ("train", "calibration", "test")}
    spec = encode.fit_scaler(encode.onehot(parts["train"], spec), spec)
    names = spec.names

    def prep(df: DataFrame) -> DataFrame:
        sc = encode.scale(encode.onehot(df, spec, keep=[ID_COL, TARGET_COL]), spec, keep=[ID_COL, TARGET_COL])
        return sc.withColumn("x", F.array(*[F.col(f"`{n}`") for n in names]))

    return TrainingData(spec, prep(parts["train"]), prep(parts["test"]),
                        prep(parts["calibration"]) if calibrate_on == "calibration" else None)


def train_pipeline(apps: DataFrame, max_iter: int = GBT_PARAMS["n_estimators"], seed: int = RANDOM_STATE,
                   target_recall: float = TARGET_RECALL, oversample: bool = True,
                   calibrate_on: str = "calibration") -> TrainedModel:
    """A.  ``calibrate_on``: the split the threshold is picked on, ``calibration`` (rows that
    neither training nor the metrics see) or ``test`` (the reference's behaviour)."""
    data = prepare_training(apps, seed, calibrate_on)
    return fit_pipeline(apps, data, balanced_rows(data, seed, oversample), max_iter, seed, target_recall, calibrate_on)


def balanced_rows(data: TrainingData, seed: int = RANDOM_STATE, oversample: bool = True) -> DataFrame:
    """A, up to the model: the scaled training rows with SMOTE's, written."""
    # SMOTE and the model read the scaled training set several times: materialise it once
    train = cut_lineage(data.train.select(ID_COL, TARGET_COL, "x"))
    balanced = smote.smote_oversample(train, ID_COL, "x", TARGET_COL, seed=seed) if oversample else \
        train.select(F.col(ID_COL).alias("key"), "x", F.col(TARGET_COL).alias("label"))
    return cut_lineage(balanced.select("key", "x", "label", *[c for c in ("is_synthetic", "id", "source_id", "neighbour_id")
                                                              if c in balanced.columns]))


def fit_pipeline(apps: DataFrame, data: TrainingData, balanced: DataFrame, max_iter: int = GBT_PARAMS["n_estimators"],
                 seed: int = RANDOM_STATE, target_recall: float = TARGET_RECALL, calibrate_on: str = "calibration") -> TrainedModel:
    """A, from the balanced rows on: model, threshold and scored test rows."""
    model = models.train_gbt(balanced, max_iter=max_iter, label_col="label", seed=seed, x_col="x", key_col="key")

    def scored(df: DataFrame) -> DataFrame:
        return models.score_probability(model, df.select(ID_COL, TARGET_COL, "x"), x_col="x")

    test_scored = cut_lineage(scored(data.test))
    held = test_scored if data.calibration is None else scored(data.calibration)
    t = metrics.pick_threshold(held, TARGET_COL, "model_probability", target_recall)
    share = CALIBRATION_SHARE if calibrate_on == "calibration" else 0.0
    return TrainedModel(data.spec, model, t, test_scored, balanced, fingerprint(apps, seed, share))


def scenario_rows(spark: SparkSession, trained: TrainedModel) -> DataFrame:
    """The golden applications with the trained model's probability."""
    rows = engineer_features(checks.scenario_frame(spark, pinned_scores=False))
    scored = models.score_probability(trained.model, rows.withColumn("x", encode.feature_array(rows, trained.spec)), x_col="x")
    return scored.drop("x", "DTIRatio", "Age_Income_Interaction")


def save_artifacts(spark: SparkSession, trained: TrainedModel, path: str, **notes) -> str:
    """S3: publishes model, spec and threshold as one version, with the fingerprint of its splits; returns its name."""
    return artifacts.publish(spark, path, trained.model, trained.spec, trained.threshold, fingerprint=trained.fingerprint, **notes)


def load_artifacts(spark: SparkSession, path: str, version: str | None = None):
    """Model, spec and threshold of the current version, or of a named one."""
    found = artifacts.load(spark, path, version)
    return found.model, found.spec, found.threshold


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def error_frame(trained: TrainedModel) -> DataFrame:
    """C: test rows with predicted label and error type."""
    pred = metrics.classify(F.col("model_probability"), trained.threshold)
    return trained.test_scored.withColumns({"PredictedLabel": pred}).withColumn(
        "ErrorType", metrics.error_type(F.col(TARGET_COL), F.col("PredictedLabel")))


def attribution(spark: SparkSession, trained: TrainedModel, rows: DataFrame) -> DataFrame:
    """Per-row Shapley values of the boosted model's margin (contributions, base, margin)."""
    tables = explain.tree_tables(spark, trained.model)
    keep = [c for c in rows.columns if c != "x"]
    return explain.tree_contributions(rows, tables, "x", keep)

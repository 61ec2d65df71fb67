"""One-hot encoding and standardisation driven by a ``FeatureSpec``.

The spec (feature names, categories, means, stds) is model state: small,
learned with distributed aggregates, kept on the driver and written as a
one-row JSON table next to the model.  Applying it is a projection with
literals, which Catalyst folds into one codegen stage.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CATEGORICAL_COLUMNS, DEFAULT_THRESHOLD, ENGINEERED_COLUMNS, ID_COL, NUMERIC_COLUMNS


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...]
    categories: tuple[tuple[str, tuple[str, ...]], ...]   # column -> categories kept (first dropped)
    means: tuple[float, ...] = field(default=())
    stds: tuple[float, ...] = field(default=())

    @property
    def dummy_names(self) -> list[str]:
        return [f"{c}_{v}" for c, cats in self.categories for v in cats]

    @property
    def names(self) -> list[str]:
        return list(self.numeric) + self.dummy_names

    @property
    def is_fitted(self) -> bool:
        return len(self.means) == len(self.names)

    def to_json(self) -> str:
        return json.dumps({"numeric": list(self.numeric),
                           "categories": [[c, list(v)] for c, v in self.categories],
                           "means": list(self.means), "stds": list(self.stds)})

    @staticmethod
    def from_json(text: str) -> "FeatureSpec":
        d = json.loads(text)
        return FeatureSpec(tuple(d["numeric"]), tuple((c, tuple(v)) for c, v in d["categories"]),
                           tuple(d.get("means", ())), tuple(d.get("stds", ())))


def category_values(df: DataFrame, columns: list[str], max_per_column: int | None = None) -> dict[str, list[str]]:
    """Distinct non-null values per column, one distributed group-by per column set.

    Only the (column, value) pairs cross to the driver: as many as the encoded
    frame has columns.  ``max_per_column`` refuses a column with more values,
    counted before anything is collected.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return {}
    # a row per distinct combination first: the explode then sees few rows, whatever the table's size
    combos = df.select(*[F.col(c).cast("string").alias(c) for c in present]).distinct()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in present]))
    distinct = (combos.select(pairs.alias("kv")).select("kv.column", "kv.value")
                .filter(F.col("value").isNotNull()).distinct())
    if max_per_column is not None:
        for r in distinct.groupBy("column").count().filter(F.col("count") > max_per_column).orderBy("column").limit(1).collect():
            raise ValueError(f"column {r['column']!r} has {r['count']} categories, more than {max_per_column}")
    out: dict[str, list[str]] = {c: [] for c in present}
    for r in distinct.collect():
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items()}


def learn_spec(df: DataFrame, numeric: list[str] | None = None,
               categorical: list[str] | None = None) -> FeatureSpec:
    """C1 (learning part): categories on the whole table, first one dropped.

    Sorted like pandas (code-point order); only categorical columns present
    in ``df`` are encoded, as in the reference.
    """
    numeric = list(numeric if numeric is not None else NUMERIC_COLUMNS + ENGINEERED_COLUMNS)
    categorical = list(categorical if categorical is not None else CATEGORICAL_COLUMNS)
    values = category_values(df, categorical)
    cats = tuple((c, tuple(values[c][1:])) for c in categorical if c in values)
    return FeatureSpec(tuple(numeric), cats)


def onehot_columns(df: DataFrame, spec: FeatureSpec) -> list[Column]:
    """Features in spec order; absent inputs and unseen/NULL categories -> 0."""
    cols: list[Column] = []
    for name in spec.numeric:
        cols.append((F.col(name).cast("double") if name in df.columns else F.lit(0.0)).alias(name))
    for c, cats in spec.categories:
        for v in cats:
            expr = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)) if c in df.columns else F.lit(0)
            cols.append(expr.alias(f"{c}_{v}"))
    return cols


def onehot(df: DataFrame, spec: FeatureSpec, keep: list[str] | None = None) -> DataFrame:
    keep = [k for k in (keep if keep is not None else [ID_COL]) if k in df.columns]
    return df.select(*[F.col(k) for k in keep], *onehot_columns(df, spec))


def fit_scaler(encoded: DataFrame, spec: FeatureSpec) -> FeatureSpec:
    """Mean and population std of every feature in one aggregate.

    A zero (or vanishing) std becomes 1, so a constant feature scales to 0.
    """
    names = spec.names
    aggs = []
    for i, n in enumerate(names):
        aggs += [F.avg(F.col(f"`{n}`")).alias(f"m{i}"), F.stddev_pop(F.col(f"`{n}`")).alias(f"s{i}")]
    row = encoded.agg(*aggs).first()
    means = tuple(float(row[f"m{i}"] or 0.0) for i in range(len(names)))
    stds = []
    for i in range(len(names)):
        s = row[f"s{i}"]
        s = float(s) if s is not None else 0.0
        stds.append(1.0 if s < 10 * 2.220446049250313e-16 else s)
    return replace(spec, means=means, stds=tuple(stds))


def scale_columns(spec: FeatureSpec) -> list[Column]:
    """C4: ``(x - mean) / std`` for every feature, with literals."""
    if not spec.is_fitted:
        raise ValueError("FeatureSpec has no scaler statistics; call fit_scaler first")
    return [((F.col(f"`{n}`").cast("double") - F.lit(m)) / F.lit(s)).alias(n)
            for n, m, s in zip(spec.names, spec.means, spec.stds)]


def scale(encoded: DataFrame, spec: FeatureSpec, keep: list[str] | None = None) -> DataFrame:
    keep = [k for k in (keep if keep is not None else [ID_COL]) if k in encoded.columns]
    return encoded.select(*[F.col(k) for k in keep], *scale_columns(spec))


def feature_array(eng: DataFrame, spec: FeatureSpec) -> Column:
    """C2 + C4 as one array<double> column (raw columns stay untouched)."""
    if not spec.is_fitted:
        raise ValueError("FeatureSpec has no scaler statistics; call fit_scaler first")
    return F.array(*[(c.cast("double") - F.lit(m)) / F.lit(s)
                     for c, m, s in zip(onehot_columns(eng, spec), spec.means, spec.stds)])


def prepare_inference(df: DataFrame, spec: FeatureSpec, keep: list[str] | None = None) -> DataFrame:
    """Features (F4) -> aligned one-hot (C2) -> scaled (C4), in one projection."""
    from ..functions.features import engineer_features
    eng = engineer_features(df)
    keep = [k for k in (keep if keep is not None else [ID_COL]) if k in eng.columns]
    enc = eng.select(*[F.col(k) for k in keep], *onehot_columns(eng, spec))
    return scale(enc, spec, keep)


def spec_frame(spark: SparkSession, spec: FeatureSpec, threshold: float | None = None) -> DataFrame:
    """S3: the spec (and the decision threshold) as a one-row table."""
    return spark.createDataFrame([(spec.to_json(), threshold)], "spec string, threshold double")


def save_spec(spark: SparkSession, spec: FeatureSpec, path: str, threshold: float | None = None) -> None:
    spec_frame(spark, spec, threshold).coalesce(1).write.mode("overwrite").json(path)


def load_spec(spark: SparkSession, path: str,
              default_threshold: float = DEFAULT_THRESHOLD) -> tuple[FeatureSpec, float]:
    """S3: read spec and threshold back; a missing threshold falls back to 0.50."""
    row = spark.read.schema("spec string, threshold double").json(path).first()
    if row is None:
        raise FileNotFoundError(f"no feature spec at {path}")
    t = row["threshold"] if row["threshold"] is not None else default_threshold
    return FeatureSpec.from_json(row["spec"]), float(t)

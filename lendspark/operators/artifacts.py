"""S3: model, feature spec and threshold that belong together, in versions.

A version is published whole: its parts first, its manifest last.  Loading checks the parts against the
manifest, so parts of two versions never meet.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .. import published
from .boosting import BoostedTrees
from .encode import FeatureSpec, load_spec, save_spec


@dataclass(frozen=True)
class Artifacts:
    version: str
    model: BoostedTrees
    spec: FeatureSpec
    threshold: float


def _digest(spec: FeatureSpec) -> str:
    return hashlib.sha256(spec.to_json().encode()).hexdigest()


def write_parts(spark: SparkSession, root: str, name: str, model: BoostedTrees, spec: FeatureSpec, threshold: float) -> dict:
    """Writes a version's parts; nobody sees them before its manifest is published."""
    folder = os.path.join(root, "versions", name)
    model.save(spark, os.path.join(folder, "model"))
    save_spec(spark, spec, os.path.join(folder, "spec"), threshold)
    return {"trees": int(model.getNumTrees), "features": len(spec.names), "spec": _digest(spec), "threshold": float(threshold)}


def publish(spark: SparkSession, root: str, model: BoostedTrees, spec: FeatureSpec, threshold: float, **notes) -> str:
    """Writes a version and makes it current; ``notes`` are kept in its manifest.  Returns its name."""
    name = published.new_name(spark, root)
    published.publish(spark, root, name, {**notes, **write_parts(spark, root, name, model, spec, threshold)})
    return name


def load(spark: SparkSession, root: str, version: str | None = None) -> Artifacts:
    """The current version, or a named one."""
    manifest = published.current(spark, root, version)
    if manifest is None:
        raise FileNotFoundError(f"no published version in {root}" if version is None else f"no version {version} in {root}")
    folder = os.path.join(root, "versions", manifest["name"])
    model = BoostedTrees.load(spark, os.path.join(folder, "model"))
    spec, threshold = load_spec(spark, os.path.join(folder, "spec"))
    if (model.getNumTrees, len(spec.names), _digest(spec), threshold) != tuple(manifest[k] for k in ("trees", "features", "spec", "threshold")):
        raise ValueError(f"the parts of {folder} are not those of its manifest")
    return Artifacts(manifest["name"], model, spec, threshold)

"""Folders that readers see whole or not at all.

A publisher writes its data into a folder of its own and then, last, a small manifest that names it.  A manifest counts once
it is complete (Spark's writers leave ``_SUCCESS`` as their last file), so whatever a killed publisher left is never
seen.  Manifests are numbered; the highest complete one is current, and of equal numbers the last by name.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none where it is absent."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, os.path.join(path, "_SUCCESS"))


def new_name(spark: SparkSession, root: str) -> str:
    """A name above all manifests there are, complete or not."""
    found = names(spark, os.path.join(root, "manifest"))
    number = max((int(n.split("-")[0]) for n in found if n.split("-")[0].isdigit()), default=0) + 1
    return f"{number:012d}-{uuid.uuid4().hex}"


def publish(spark: SparkSession, root: str, name: str, content: dict) -> None:
    """Makes a finished folder current."""
    spark.createDataFrame([(json.dumps({**content, "name": name}),)], "value string").coalesce(1).write.text(os.path.join(root, "manifest", name))


def current(spark: SparkSession, root: str, name: str | None = None) -> dict | None:
    """The named manifest, or the highest complete one; None where there is none."""
    base = os.path.join(root, "manifest")
    for n in [name] if name is not None else reversed(names(spark, base)):
        if complete(spark, os.path.join(base, n)):
            return json.loads(spark.read.text(os.path.join(base, n)).first()[0])
    return None

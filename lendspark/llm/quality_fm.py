"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Pairwise interactions have low rank and are scored in time linear in the number
of features with the sum-of-squares identity
``sum_{i<j} <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2``.
Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts are scored by their structure and
metadata alone; a null ``n_chars`` is a metadata value of its own; repeated rows
are scored one by one; without both labels every score is 0.5.  Only ``doc_id``,
``text`` and ``n_chars`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm import textkernel as K
from lendspark.llm.labelled import bounded, crc_fold, label_table
from lendspark.llm.quality_rules import FEATURES, measure

WORD_BITS = 16
BINS = 12                       # per structure statistic
META = 40                       # stated length: unknown, or its power of two
RANK = 8
MAX_LABELLED = 8_000            # labelled documents the machine is fitted on, at most
STRUCT_X = 0.35                 # weight of one structure or metadata feature beside a unit word vector

_STRUCT_AT = 1 << WORD_BITS
_META_AT = _STRUCT_AT + BINS * len(FEATURES)
SIZE = _META_AT + META


@dataclass
class Machine:
    cuts: np.ndarray           # statistic x (BINS - 1)
    bias: float
    linear: np.ndarray         # SIZE
    factors: np.ndarray        # SIZE x RANK


def sparse(data: np.ndarray, offsets: np.ndarray, stated: np.ndarray,
           cuts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, x, row bounds) of one block's texts, row by row, and their statistics.

    ``stated`` is the length metadata (-1: unknown).  Without cuts only words come out.
    """
    n = len(offsets) - 1
    hashes, _, _, bounds = K.words(data, offsets, "space", lower=True)
    key = (np.repeat(np.arange(n), np.diff(bounds)) << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, times = np.unique(key, return_counts=True)
    row, feature = key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)
    x = 1.0 + np.log(times)
    norm = np.sqrt(np.bincount(row, x * x, n))
    x = x / norm[row] if len(row) else x
    stats = measure(data, offsets)[1]
    if cuts is not None:
        bins = np.stack([np.searchsorted(cuts[j], stats[:, j], side="right") for j in range(len(FEATURES))], axis=1)
        fixed = _STRUCT_AT + bins + BINS * np.arange(len(FEATURES))
        meta = np.where(stated < 0, 0, 1 + np.log2(np.maximum(stated, 1)).astype(np.int64))
        fixed = np.concatenate([fixed, (_META_AT + np.minimum(meta, META - 1))[:, None]], axis=1)
        feature = np.concatenate([feature, fixed.ravel()])
        x = np.concatenate([x, np.full(fixed.size, STRUCT_X)])
        row = np.concatenate([row, np.repeat(np.arange(n), fixed.shape[1])])
        order = np.argsort(row, kind="stable")
        feature, x, row = feature[order], x[order], row[order]
    return feature, x, np.searchsorted(row, np.arange(n + 1)), stats


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows' ranges (no range is empty)."""
    return np.add.reduceat(values, bounds[:-1], axis=0)


def margins(m: Machine, feature: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    vx = m.factors[feature] * x[:, None]
    s = _sums(vx, bounds)
    return m.bias + _sums(m.linear[feature] * x, bounds) + 0.5 * ((s * s).sum(axis=1) - _sums((vx * vx).sum(axis=1), bounds))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cuts: np.ndarray, epochs: int = 6, rate: float = 0.1,
        l2: float = 1e-5, batch: int = 64) -> Machine:
    """AdaGrad on the logistic loss, in small batches of rows."""
    rng = np.random.default_rng(11)
    prior = np.clip(y.mean(), 0.01, 0.99)
    m = Machine(cuts, float(np.log(prior / (1 - prior))), np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    seen_bias, seen_w, seen_v = 1e-8, np.full(SIZE, 1e-8), np.full((SIZE, RANK), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            feature = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            length = np.array([len(rows[i][0]) for i in part])
            bounds = np.concatenate([[0], np.cumsum(length)])
            vx = m.factors[feature] * x[:, None]
            s = _sums(vx, bounds)
            margin = m.bias + _sums(m.linear[feature] * x, bounds) + 0.5 * (
                (s * s).sum(axis=1) - _sums((vx * vx).sum(axis=1), bounds))
            g = (1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - y[part]) / len(part)
            gx = np.repeat(g, length) * x
            found, where = np.unique(feature, return_inverse=True)
            gw = np.bincount(where, gx, len(found)) + l2 * m.linear[found]
            pull = gx[:, None] * (np.repeat(s, length, axis=0) - vx)
            gv = np.stack([np.bincount(where, pull[:, f], len(found)) for f in range(RANK)], axis=1) + l2 * m.factors[found]
            seen_w[found] += gw * gw
            seen_v[found] += gv * gv
            m.linear[found] -= rate * gw / np.sqrt(seen_w[found])
            m.factors[found] -= 0.3 * rate * gv / np.sqrt(seen_v[found])
            seen_bias += float(g.sum()) ** 2
            m.bias -= rate * float(g.sum()) / np.sqrt(seen_bias)
    return m


def _stated(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)


def _inputs(docs: DataFrame) -> DataFrame:
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", length.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine | None:
    """Machine from labelled documents outside the held-out fold (crc32 mod 3 = 1); None without both labels."""
    sample = bounded(label_table(labels, "quality").where(crc_fold("doc_id", 3) != 1), "doc_id", max_labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stated = _stated(batch)
            for a, b, data, offsets in K.blocks(batch):
                f, x, bounds, stats = sparse(data, offsets, stated[a:b], None)
                cut = list(zip(bounds[:-1], bounds[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b], batch.column("y")[a:b], batch.column("n_chars")[a:b],
                     pa.array([f[i:j].astype(np.uint16).tobytes() for i, j in cut], pa.binary()),
                     pa.array([x[i:j].astype(np.float32).tobytes() for i, j in cut], pa.binary()),
                     pa.array(list(stats), pa.list_(pa.float64()))], ["doc_id", "y", "n_chars", "f", "x", "stats"])

    got = (_inputs(docs).join(F.broadcast(sample), "doc_id")     # at most max_labelled rows of two numbers
           .select("doc_id", "y", "n_chars", "text")
           .mapInArrow(features, "doc_id long, y int, n_chars long, f binary, x binary, stats array<double>")
           .toArrow().sort_by([("doc_id", "ascending")]))
    y = got.column("y").to_numpy().astype(float)
    if len(y) < 10 or y.min() == y.max():
        return None
    stats = np.array(got.column("stats").to_pylist())
    cuts = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.copy()
    stated = got.column("n_chars").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = []
    for i, (f, x) in enumerate(zip(got.column("f").to_pylist(), got.column("x").to_pylist(), strict=True)):
        bins = np.array([np.searchsorted(cuts[j], stats[i, j], side="right") for j in range(len(FEATURES))])
        meta = 0 if stated[i] < 0 else min(META - 1, 1 + int(np.log2(max(stated[i], 1))))
        rows.append((np.concatenate([np.frombuffer(f, np.uint16).astype(np.int64),
                                     _STRUCT_AT + bins + BINS * np.arange(len(FEATURES)), [_META_AT + meta]]),
                     np.concatenate([np.frombuffer(x, np.float32).astype(float), np.full(len(FEATURES) + 1, STRUCT_X)])))
    return fit(rows, y, cuts)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stated = _stated(batch)
            parts = [np.zeros(0)]
            for a, b, data, offsets in K.blocks(batch):
                if machine is None:
                    parts.append(np.full(b - a, 0.5))
                else:
                    f, x, bounds, _ = sparse(data, offsets, stated[a:b], machine.cuts)
                    parts.append(1.0 / (1.0 + np.exp(-np.clip(margins(machine, f, x, bounds), -30, 30))))
            p = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return (_inputs(docs).withColumn("held_out", crc_fold("doc_id", 3) == 1)
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))

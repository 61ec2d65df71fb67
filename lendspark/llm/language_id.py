"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

Training: document frequencies over every learnable text; weights by
follow-the-regularised-leader (per-coordinate, elastic net: L1 for sparsity, L2
for size) on a bounded sample per language; a temperature fitted on the part of
that sample kept out of training makes the probabilities calibrated.

Defined results: a null text or one without letters is ``und`` with score 0, and
so is every text when nothing can be learned (empty table, no language given).
Repeated rows are predicted one by one.  Long texts are read in pieces, so
memory does not grow with them.  Only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendspark.llm.labelled import crc_fold
from lendspark.llm.textkernel import mix64

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_PER_LANGUAGE = 1_000     # documents of a language the weights are fitted on, at most
PIECE = 1 << 20                 # characters handled at once
UNKNOWN = "und"
SHORT = 1 << 15                 # characters up to which sorting beats a count of every bucket
_SCALE = 1 << 30
_PRIME = np.uint64(0x100000001B3)
_SPREAD = {n: np.uint64(m) for n, m in zip(ORDERS, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93), strict=True)}
_TOP = np.uint64(48)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def profile(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's character n-grams and how often each occurs.

    Lower-cased; a run of other characters than letters counts as one space.
    Nothing for a text without letters.
    """
    counts = None
    tail = np.zeros(0, np.uint32)
    any_letter = False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        any_letter = any_letter or bool(letter.any())
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= not len(tail) or tail[-1] != 32
        codes = np.where(letter, codes, 32).astype(np.uint32)[keep]
        joined = np.concatenate([tail, codes])
        keys = _gram_keys(joined.astype(np.uint64), len(tail))
        tail = joined[-(max(ORDERS) - 1):]
        if len(text) <= min(SHORT, PIECE):
            if not any_letter:
                break
            keys.sort(kind="stable")                    # radix sort of 16 bits
            edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            return keys[edge[:-1]].astype(np.int64), np.diff(edge)
        more = np.bincount(keys, minlength=BUCKETS)
        counts = more if counts is None else counts + more
    if not any_letter:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.flatnonzero(counts)
    return found, counts[found]


def _gram_keys(c: np.ndarray, old: int) -> np.ndarray:
    """Buckets of the n-grams that end after the first ``old`` characters."""
    out = []
    h = np.zeros(len(c), dtype=np.uint64)
    for n in ORDERS:                                    # h[i]: of the n characters from i
        size = len(c) - n + 1
        if size <= 0:
            break
        h = h[:size] * _PRIME + c[n - 1:]
        k = h[max(old - n + 1, 0):] * _SPREAD[n]
        out.append((k >> _TOP).astype(np.uint16))
    return np.concatenate(out) if out else np.zeros(0, np.uint16)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf
    return x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray            # per bucket
    weight: np.ndarray         # bucket x language, mostly zero
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = profile(text or "")
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((weigh(counts, self.idf[found]) @ self.weight[found] + self.bias) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, epochs: int = 3,
         alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal weights (bucket x class) and biases; the last bucket row holds the bias."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))
    order = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            found, x = rows[r]
            at = np.append(found, BUCKETS)
            x = np.append(x, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w)
            p[y[r]] -= 1.0
            g = x[:, None] * p[None, :]
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean())

    lo, hi, ratio = np.log(0.02), np.log(20.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def sampled(rows: DataFrame, per_language: dict[str, int], sample_per_language: int) -> DataFrame:
    """At most so many rows of each language, those of lowest hash."""
    order = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(_SCALE))
    # a hash threshold for each language; then its rows are cut to the bound
    share = F.create_map(*[F.lit(v) for k in sorted(per_language)
                           for v in (k, int(_SCALE * min(1.0, 1.1 * sample_per_language / per_language[k])))])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id", F.xxhash64("text")))
    return rows.where(order < share[F.col("lang")]).withColumn("place", place).where(F.col("place") <= sample_per_language).drop("place")


def train(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Model from the documents with text and language outside the held-out fold (crc32 mod 3 = 1)."""
    rows = (docs.select("doc_id", "text", "lang")
            .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_fold("doc_id", 3) != 1)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, langs = np.zeros(BUCKETS, np.int64), 0, {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                found, _ = profile(text)
                df[found] += 1
                n += 1
                langs[lang] = langs.get(lang, 0) + 1
        found = np.flatnonzero(df)
        names = sorted(langs)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*found.tolist(), *[-1] * len(names)], pa.int32()), pa.array([*[""] * len(found), *names], pa.string()),
             pa.array([*df[found].tolist(), *[langs[k] for k in names]], pa.int64())], ["bucket", "lang", "n"])

    # at most BUCKETS rows, and one per language, as many as the model has rows and columns
    counted = (rows.mapInArrow(frequencies, "bucket int, lang string, n long")
               .groupBy("bucket", "lang").agg(F.sum("n").alias("n")).toArrow())
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    per_language = {k: v for k, v, b in zip(counted.column("lang").to_pylist(), n.tolist(), bucket.tolist(), strict=True) if b < 0}
    languages = sorted(per_language)
    total = sum(per_language.values())
    df = np.zeros(BUCKETS)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    empty = Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    if not languages:
        return empty

    sample = sampled(rows, per_language, sample_per_language)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profile(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([f.astype(np.uint16).tobytes() for f, _ in found], pa.binary()),
                 pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())], ["doc_id", "lang", "found", "counts"])

    got = sample.mapInArrow(features, "doc_id long, lang string, found binary, counts binary").toArrow().sort_by([("doc_id", "ascending")])
    ids, langs = got.column("doc_id").to_pylist(), got.column("lang").to_pylist()
    x, y = [], []
    for f, c, lang in zip(got.column("found").to_pylist(), got.column("counts").to_pylist(), langs, strict=True):
        found = np.frombuffer(f, np.uint16).astype(np.int64)
        x.append((found, weigh(np.frombuffer(c, np.float32).astype(float), idf[found]) if len(found) else np.zeros(0)))
        y.append(languages.index(lang))
    y = np.array(y, dtype=np.int64)
    apart = np.array([mix64(np.array([i or 0], np.int64).view(np.uint64))[0] % 5 == 0 for i in ids], dtype=bool)
    learn = np.flatnonzero(~apart)
    weight, bias = ftrl([x[i] for i in learn], y[learn], len(languages))
    model = Model(languages, idf, weight, bias, 1.0)
    test = np.flatnonzero(apart)
    if len(test):
        model.temperature = fit_temperature(np.stack([x[i][1] @ weight[x[i][0]] + bias for i in test]), y[test])
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array([k for k, _ in out], pa.string()),
                 pa.array([p for _, p in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "text")
            .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double"))

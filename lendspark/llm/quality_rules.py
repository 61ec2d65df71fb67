"""Quality rules: gradient-boosted trees over document statistics.

Statistics of whole texts are computed in Arrow batches (`statistics`); trees
are fitted on a bounded sample of labelled documents and scored as flat NumPy
node arrays.  Symbol share, duplicate-line share and repeated-word share can
only lower the probability of a good document (monotone constraints).

Defined results: a null or empty text has no words and fails the base rule
(``n_words < 20``); repeated rows are judged one by one; an empty table gives an
empty result; without usable labels the base rule alone decides and ``score`` is
null.  Only ``doc_id``, ``text`` and the label column are read, so extra columns
with clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendspark.llm import gbt
from lendspark.llm import textkernel as K
from lendspark.llm.labelled import bounded, crc_fold, label_table

MAX_LABELLED = 20_000      # labelled documents the trees are fitted on, at most
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
THRESHOLD = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share",
            "digit_share", "punct_share", "distinct_share", "words_a_line", "stop_share", "log_chars")
MONOTONE = {FEATURES.index(f): -1 for f in ("symbol_share", "dup_line_share", "repeat_share")}

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!?;:\"'()[]{}@^_~`/\\+=-"]] = True
_SHORT = 3                 # words of at most so many bytes stand for function words


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the texts in one block, a row each."""
    n = len(offsets) - 1
    hashes, starts, ends, bounds = K.words(data, offsets, "space")
    n_words = np.diff(bounds)
    rows = np.repeat(np.arange(n), n_words)

    inside = K.byte_class("space")[data]
    chars = K.per_row(inside & ((data & 0xC0) != 0x80), offsets)
    symbols = K.per_row(_SYMBOLS[data], offsets)

    line_starts, line_ends = K.spans(data, offsets, "line")
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_hash = K.span_hashes(data, line_starts, line_ends)
    line_bounds = np.searchsorted(line_starts, offsets)
    line_rows = np.repeat(np.arange(n), np.diff(line_bounds))
    _, distinct_lines = K.distinct_in_rows(line_hash, line_rows, n)
    n_lines = np.diff(line_bounds)
    dup_lines = n_lines - np.diff(distinct_lines)

    window, first = K.runs(hashes, bounds, REPEAT_WINDOW)
    first = first[K.repeated(K.in_row(window, rows[first]))]
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + REPEAT_WINDOW, -1)
    repeat = K.per_row(np.cumsum(cover[:-1]) > 0, bounds)

    _, distinct = K.distinct_in_rows(hashes, rows, n)
    short = K.per_row((ends - starts) <= _SHORT, bounds)
    counts = np.stack([n_words, chars, symbols, dup_lines, repeat], axis=1).astype(np.int64)
    some_words, some_chars = np.maximum(n_words, 1), np.maximum(chars, 1)
    features = np.stack([
        np.log1p(n_words), chars / some_words, symbols / some_chars, dup_lines / np.maximum(n_lines, 1),
        repeat / some_words, K.per_row(_UPPER[data], offsets) / some_chars,
        K.per_row(_DIGIT[data], offsets) / some_chars, K.per_row(_PUNCT[data], offsets) / some_chars,
        np.diff(distinct) / some_words, n_words / np.maximum(n_lines, 1), short / some_words, np.log1p(chars),
    ], axis=1)
    return counts, features


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])


def _measure_batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    parts = [measure(data, offsets) for _, _, data, offsets in K.blocks(batch)]
    if not parts:
        return np.zeros((0, len(COUNTS)), np.int64), np.zeros((0, len(FEATURES)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def labelled_features(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``max_labelled`` labelled training documents."""
    sample = bounded(label_table(labels, "quality").where(crc_fold("doc_id", 3) != 1), "doc_id", max_labelled)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _measure_batch(batch)[1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    rows = (docs.select("doc_id", "text").where(F.col("text").isNotNull())
            .join(F.broadcast(sample), "doc_id")      # at most max_labelled rows of two numbers
            .mapInArrow(features, "doc_id long, y int, x array<double>").toArrow())
    rows = rows.sort_by([("doc_id", "ascending")])
    x = np.array(rows.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return x, rows.column("y").to_numpy().astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> gbt.Forest | None:
    """Trees from labelled documents outside the held-out fold; None without both labels."""
    x, y = labelled_features(docs, labels, max_labelled)
    if len(y) < 10 or y.min() == y.max():
        return None
    # the same weight for a label whatever its share: repeat the rarer one's rows
    few, many = sorted((0.0, 1.0), key=lambda v: (y == v).sum())
    times = max(1, int((y == many).sum() // max(1, (y == few).sum())))
    rows = np.concatenate([np.flatnonzero(y == many), np.repeat(np.flatnonzero(y == few), min(times, 8))])
    return gbt.fit(x[rows], y[rows], MONOTONE)


RESULT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.LongType()) for c in COUNTS),
                       T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()),
                       T.StructField("kept", T.BooleanType())])


def judge(docs: DataFrame, model: gbt.Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base rule, score and verdict of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = _measure_batch(batch)
            failed = base_failed(counts)
            score = model.probability(x) if model is not None else None
            kept = ~failed if score is None else ~failed & (score >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *(pa.array(counts[:, j]) for j in range(len(COUNTS))),
                 pa.array(failed), pa.nulls(batch.num_rows, pa.float64()) if score is None else pa.array(score),
                 pa.array(kept)], RESULT.names)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, model: gbt.Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose verdict is good, columns unchanged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, x = _measure_batch(batch)
            kept = ~base_failed(counts)
            if model is not None and len(x):
                kept &= model.probability(x) >= threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)

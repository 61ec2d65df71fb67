"""Hard negatives for embedding training, by a secondary-sort shuffle.

Anchors are scored against all rows.  For each of an anchor's positives (its best
``POSITIVES`` other rows of the same label) the best ``NEGATIVES`` rows of another label
are wanted whose score lies within a window below the positive's: at least ``LOW_PERCENT``
and at most ``HIGH_PERCENT`` of it.

Pair scores are packed into byte keys (anchor, descending score, kind, id), partitioned by
anchor and sorted within the partition by the shuffle itself.  An iterator reads an anchor's keys
once, in order: a positive opens a window, a negative is emitted to all open windows that
hold its score and still want one.  Nothing of an anchor is held but its open windows.

Before the shuffle each task combines: a first pass keeps an anchor's best same-label
pairs, and the global positives come out of a sort of those.  Then the windows are known, and a second
pass keeps each window's best pairs.  Both cuts are exact, as what is not among a task's best is not
among the best of all.  Anchors are taken in blocks of a bounded size, a pass over the
rows each, and a block's anchors and positives are all that is broadcast.

Scores are integer inner products of floor(``SCALE`` * x); products that doubles do not
hold exactly are computed with Python's integers, and a score beyond 64 bits counts as the
nearest 64-bit value.

Defined results: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part; a missing component counts as zero where vectors differ in length;
an empty vector scores zero with all; repeated rows are rows of their own, and an anchor's
other rows are all rows but itself; rows with one id and score stand in an order fixed by the rows' places in the table;
an empty table, or one without anchors, gives no rows.  Only the id, vector and label columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendspark.llm.scratch import stage
from lendspark.session import ensure_checkpoint_dir

POSITIVES = 5
NEGATIVES = 3
LOW_PERCENT = 50
HIGH_PERCENT = 95
SCALE = 256
BLOCK_BYTES = 16 << 20          # of anchors' vectors in one pass over the rows
TILE_ANCHORS, TILE_ROWS = 1024, 8192

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_NONE = np.iinfo(np.int64).min
_KEY = struct.Struct(">QQQBQQ")         # anchor's id and place, descending score, kind (0 positive, 1 negative), id, row's place
_ANCHOR = 16                            # bytes that name the anchor


# --- rows

def usable(rows: DataFrame, vec_id: str, vector: str, label: Column | str) -> DataFrame:
    """(uid, vec_id, vector, label) of the rows that take part, written once so that uid is the same in every pass."""
    label = F.col(label) if isinstance(label, str) else label
    found = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"),
                        label.cast("long").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return stage(found.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
                 .withColumn("uid", F.monotonically_increasing_id()))


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(SCALE * components)) for each length that occurs."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    return [(rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]) for n in np.unique(lengths).tolist()
            for rows in [np.flatnonzero(lengths == n)]]


class Anchors:
    """One block of anchors: places, ids, labels and vectors, those of equal length together; sent to every task."""

    def __init__(self, table: pa.Table):
        self.uid, self.id, self.label = (table.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        self.groups = _vectors(table.column("vector")) if table.num_rows else []


def _dot(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, bool]:
    """Integer inner products of all rows of a and x, and whether they are small enough to be packed with a row's number."""
    n = min(a.shape[1], x.shape[1])
    a, x = a[:, :n], x[:, :n]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * n
    if bound < 2 ** 48:
        return (a @ x.T).astype(np.int64), True
    whole = [[[int(v) for v in r] for r in m.tolist()] for m in (a, x)]
    out = [[min(_MOST, max(_LEAST, sum(p * q for p, q in zip(r, s, strict=True)))) for s in whole[1]] for r in whole[0]]
    return np.array(out, dtype=np.int64).reshape(len(a), len(x)), False


def _tiles(batch: pa.RecordBatch, anchors: Anchors) -> Iterator[tuple]:
    """(anchors' numbers, ids, places and labels of rows, scores, small) of blocks of pairs, rows by id and place."""
    ids, uid, label = (batch.column(c).to_numpy() for c in ("vec_id", "uid", "label"))
    for rows, x in _vectors(batch.column("vector")):
        order = np.lexsort((uid[rows], ids[rows]))
        rows, x = rows[order], x[order]
        for r in range(0, len(rows), TILE_ROWS):
            part = rows[r:r + TILE_ROWS]
            for who, a in anchors.groups:
                for s in range(0, len(who), TILE_ANCHORS):
                    scores, small = _dot(a[s:s + TILE_ANCHORS], x[r:r + TILE_ROWS])
                    yield who[s:s + TILE_ANCHORS], ids[part], uid[part], label[part], scores, small


class _Best:
    """The best ``most`` pairs of each list met so far: score, then smaller id and place."""

    def __init__(self, lists: int, most: int):
        self.score = np.full((lists, most), _NONE)
        self.id, self.uid = np.full((lists, most), _MOST), np.full((lists, most), _MOST)
        self.full = np.zeros((lists, most), dtype=bool)

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray, uid: np.ndarray, full: np.ndarray) -> None:
        score, ids, uid, full = (np.concatenate([own[at], new], axis=1) for own, new in
                                 ((self.score, score), (self.id, ids), (self.uid, uid), (self.full, full)))
        most = self.score.shape[1]
        # ~score descends as score ascends, without overflow
        order = np.lexsort((uid, ids, ~score, ~full), axis=1)[:, :most]
        self.score[at], self.id[at], self.uid[at], self.full[at] = (np.take_along_axis(m, order, 1) for m in (score, ids, uid, full))


def _first(scores: np.ndarray, allowed: np.ndarray, most: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the best allowed scores of each row, earlier columns first among equals, and which exist."""
    most = min(most, scores.shape[1])
    if not most:
        return np.zeros((len(scores), 0), dtype=np.int64), np.zeros((len(scores), 0), dtype=bool)
    if small:
        key = np.where(allowed, scores * TILE_ROWS + np.arange(scores.shape[1] - 1, -1, -1), _NONE)
        if key.shape[1] > most:
            key = np.partition(key, key.shape[1] - most, axis=1)[:, -most:]
        exists = key != _NONE
        return np.where(exists, scores.shape[1] - 1 - key % TILE_ROWS, 0), exists
    order = np.lexsort((np.broadcast_to(np.arange(scores.shape[1]), scores.shape), ~scores, ~allowed), axis=1)[:, :most]
    return order, np.take_along_axis(allowed, order, 1)


def _emit(best: _Best, anchors: Anchors, width: int, kind: int) -> pa.RecordBatch:
    """Packed keys of all pairs, none twice; an anchor has ``width`` lists."""
    lists, at = np.nonzero(best.full)
    keys = {_KEY.pack(a - _LEAST, place, _MOST - s, kind, i - _LEAST, u) for a, place, s, i, u in
            zip(anchors.id[lists // width].tolist(), anchors.uid[lists // width].tolist(), best.score[lists, at].tolist(),
                best.id[lists, at].tolist(), best.uid[lists, at].tolist(), strict=True)}
    return pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.binary())], ["key"])


# --- the two passes

def _positive_keys(rows: DataFrame, block, positives: int) -> DataFrame:
    """Keys of each task's best same-label pairs of each anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = block.value
        best = _Best(len(anchors.uid), positives)
        for batch in batches:
            for who, ids, uid, label, scores, small in _tiles(batch, anchors):
                own = anchors.label[who]
                for one in np.intersect1d(own, label).tolist():
                    a, x = np.flatnonzero(own == one), np.flatnonzero(label == one)
                    s = scores[np.ix_(a, x)]
                    column, exists = _first(s, anchors.uid[who[a]][:, None] != uid[x], positives, small)
                    best.add(who[a], np.take_along_axis(s, column, 1), ids[x][column], uid[x][column], exists)
        yield _emit(best, anchors, 1, 0)

    return rows.mapInArrow(run, "key binary")


def _negative_keys(rows: DataFrame, block, windows, negatives: int, low: int, high: int) -> DataFrame:
    """Keys of each task's best pairs of each window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, scores_of = block.value, windows.value        # scores_of: anchor's number -> positive scores
        width = scores_of.shape[1]
        best = _Best(len(anchors.uid) * width, negatives)
        for batch in batches:
            for who, ids, uid, label, scores, small in _tiles(batch, anchors):
                other = anchors.label[who][:, None] != label
                for w in range(width):
                    least, most, open_ = _window(scores_of[who, w], low, high)
                    a = np.flatnonzero(open_)
                    if not len(a):
                        continue
                    s = scores[a]
                    allowed = other[a] & (s >= least[a][:, None]) & (s <= most[a][:, None])
                    some = allowed.any(axis=1)
                    a, s, allowed = a[some], s[some], allowed[some]
                    if len(a):
                        column, exists = _first(s, allowed, negatives, small)
                        best.add(who[a] * width + w, np.take_along_axis(s, column, 1), ids[column], uid[column], exists)
        yield _emit(best, anchors, width, 1)

    return rows.mapInArrow(run, "key binary")


def _window(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest score with low * p <= 100 * n <= high * p, and whether there is any; ``_NONE`` is no positive."""
    ends = [(-(-low * p // 100), high * p // 100) for p in scores.tolist()]
    open_ = np.array([p != _NONE and a <= b for p, (a, b) in zip(scores.tolist(), ends, strict=True)], dtype=bool)
    least, most = (np.array([e[i] if o else 0 for e, o in zip(ends, open_, strict=True)], dtype=np.int64) for i in (0, 1))
    return least, most, open_


def _sorted_by_anchor(keys: DataFrame, partitions: int):
    """An RDD of the packed keys, an anchor's in one partition, in their order."""
    return (keys.rdd.map(lambda row: (bytes(row[0]), None))
            .repartitionAndSortWithinPartitions(partitions, lambda key: zlib.crc32(key[:_ANCHOR])))


def first_positives(keys: Iterator[tuple[bytes, None]], positives: int) -> Iterator[tuple[bytes]]:
    """The first keys of each anchor."""
    current, n = None, 0
    for key, _ in keys:
        if key[:_ANCHOR] != current:
            current, n = key[:_ANCHOR], 0
        if n < positives:
            n += 1
            yield (key,)


def stream_windows(keys: Iterator[tuple[bytes, None]], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Emits (anchor's id, positive id, rank, negative id, positive score, negative score) as an anchor's keys go by.

    Scores fall, and positives stand before negatives of their score, so a window is open
    before any score that it may hold arrives and is closed for good once a score lies below it.
    """
    current, windows = None, []
    for key, _ in keys:
        if key[:_ANCHOR] != current:
            current, windows = key[:_ANCHOR], []
        anchor, _, down, kind, shifted, _ = _KEY.unpack(key)
        score, row_id = _MOST - down, shifted + _LEAST
        if kind == 0:
            windows.append([row_id, score, 0])
            continue
        for window in windows:
            if low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield anchor + _LEAST, window[0], window[2], row_id, window[1], score
        windows = [w for w in windows if w[2] < negatives and 100 * score >= low * w[1]]


def mine(rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low_percent: int = LOW_PERCENT, high_percent: int = HIGH_PERCENT,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``RESULT`` rows for the rows of which ``is_anchor``, an expression of ``vec_id`` and ``label``, holds."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    data = usable(rows, vec_id, vector, label)
    picked = stage(data.where(is_anchor))
    size = picked.agg(F.coalesce(F.sum(24 + 8 * F.size("vector")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    for b in range(blocks):
        # a hash deals anchors evenly; a block is bounded by block_bytes, not by the table
        table = picked.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == b).toArrow()
        block = sc.broadcast(Anchors(table))
        top = stage(spark.createDataFrame(
            _sorted_by_anchor(_positive_keys(data, block, positives), partitions)
            .mapPartitions(lambda keys: first_positives(keys, positives)), "key binary"))
        windows = sc.broadcast(_positive_scores(top.toArrow(), block.value, positives))
        keys = top.unionAll(_negative_keys(data, block, windows, negatives, low_percent, high_percent))
        (spark.createDataFrame(_sorted_by_anchor(keys, partitions)
                               .mapPartitions(lambda keys: stream_windows(keys, negatives, low_percent, high_percent)), RESULT)
         .write.mode("append").parquet(path))
        block.unpersist()
        windows.unpersist()
    return spark.read.schema(RESULT).parquet(path)


def _positive_scores(table: pa.Table, anchors: Anchors, positives: int) -> np.ndarray:
    """Scores of the positives of each anchor of the block, by its number; ``_NONE`` where it has fewer."""
    number = {u: i for i, u in enumerate(anchors.uid.tolist())}
    out = np.full((len(number), positives), _NONE)
    filled = np.zeros(len(number), dtype=np.int64)
    for key in sorted(table.column("key").to_pylist()):
        _, anchor, down, *_ = _KEY.unpack(key)
        at = number[anchor]
        out[at, filled[at]] = _MOST - down
        filled[at] += 1
    return out

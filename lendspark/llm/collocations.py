"""Phrase collocation mining by direct-address tiling.

Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and line ends into pieces and at spaces and tabs into words.
All counts are per language.  A candidate is a phrase of 2 to ``MAX_WORDS`` words of one piece with at least
``MIN_COUNT`` contiguous occurrences, overlapping ones included.

Words with ``MIN_COUNT`` occurrences are ranked by frequency over all languages together; the rank is the word's id, and
texts are written once as ids.  A pair of neighbours is a cell of a table that is cut into tiles of ``TILE`` x ``TILE``
ids.  Within a task, pairs are counted tile by tile: tiles with many pairs densely with ``bincount``, the cell being
the address, the others as sorted coordinates.  Spark adds up the tasks' cells (map-side first, so a very frequent pair is one
row a task).  Frequent pairs are ranked by frequency again, and a phrase of three words is a cell of (pair's rank, word's
id), one of four words of (triple's rank, word's id); both its parts of one word less must be frequent.

Ids are sent to the tasks in blocks of at most ``BLOCK`` entries.  Where more words than that are frequent, texts that
hold others are counted by phrase text as well, each phrase on just one of the two ways; where more pairs or triples are frequent, each further
block is one more pass over the ids.  Both are exact, so no size of the vocabulary drops a phrase.

Score of a candidate: of its cuts into two parts, the smallest floor(``SCALE`` * a / (l + r)), a, l and r being the occurrences
of the phrase and of the two parts; ties go to the shortest left part.  A candidate goes if a longer candidate
that contains it has at least ``CONTAINED_PERCENT`` of its occurrences.

Defined results: null, empty and white texts have no words; a null language is ``und``; repeated rows are counted each;
equal scores are ordered by occurrences, then by the phrase's bytes; empty tables give no rows; a language without candidates has none
in the result.  Texts of any length are read whole.  Only the text and language columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendspark.llm.scratch import stage

MIN_COUNT = 30
MAX_WORDS = 4
CONTAINED_PERCENT = 80
SCALE = 2_000_000
TOP = 2000
TILE = 1024
DENSE_SHARE = 64                # a tile is counted densely if it has a pair for every so many of its cells
CHUNK = 1 << 20                 # ids that are counted together
ROW = 2048                      # ids of a written row, about: a task takes 10,000 rows at a time
BLOCK = 1 << 20                 # entries of a vocabulary that a task holds at a time
COUNTED = 1 << 18               # different words that a task counts before it hands them on

RESULT = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]

_BREAK, _SKIP = -1, -2
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_NORMAL = bytes(32 if c == 9 else 10 if c in _SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- words and ids

def _normal(text: str | None) -> bytes:
    """Lower-cased bytes with spaces within and line feeds between pieces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, f); the row with a null word has the number of all words of the language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    own = counts.setdefault(lang, Counter())
                    before = len(own)
                    own.update(_normal(text).split())
                    size += len(own) - before
                    if size > COUNTED:
                        yield from _counted(counts)
                        counts, size = {}, 0
        yield from _counted(counts)

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _counted(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, own in counts.items():
        words = [*own.keys()]
        f = np.fromiter(own.values(), dtype=np.int64, count=len(own))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(own) + 1), pa.string()),
                                          pa.array([w.decode("utf-8", "surrogatepass") for w in words] + [None], pa.string()),
                                          pa.array(np.append(f, f.sum()))], ["lang", "word", "f"])


def _ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with ``id``: 0, 1, ... by falling f.

    Rows are sorted over all partitions and numbered within each; where the number of rows
    before a partition begins is known from one count a partition.
    """
    spark = counts.sparkSession
    ordered = stage(counts.orderBy(F.desc("f"), *keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = sorted(ordered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low")).collect())
    before, rows = 0, []
    for part, n, low in sizes:
        rows.append((part, before - low))
        before += n
    shift = spark.createDataFrame(rows, "__part int, __shift long")      # one row for each partition
    return ordered.join(F.broadcast(shift), "__part").withColumn("id", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


class Vocabulary:
    """The most frequent words: language -> word -> id, and the words by id; at most ``BLOCK`` entries, sent to every task."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id")
        self.lang, self.word = table.column("lang").to_pylist(), table.column("word").to_pylist()
        self._ids: dict[str, dict[bytes, int]] | None = None

    def __getstate__(self):
        return {"lang": self.lang, "word": self.word, "_ids": None}

    def ids(self, lang: str) -> dict[bytes, int]:
        if self._ids is None:
            self._ids = {}
            for i, (own, word) in enumerate(zip(self.lang, self.word, strict=True)):
                self._ids.setdefault(own, {b"\n": _BREAK, b"": _SKIP})[word.encode("utf-8", "surrogatepass")] = i
        return self._ids.get(lang, {b"": _SKIP})


def encoded(texts: DataFrame, vocabulary) -> DataFrame:
    """(ids): texts as ids, -1 between pieces and for words without an id, cut between pieces into rows; written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            found = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    get = words.ids(lang).get
                    ids = np.array([get(w, _BREAK) for w in _normal(text).replace(b"\n", b" \n ").split(b" ")], dtype=np.int32)
                    ids = ids[ids != _SKIP]
                    known = ids >= 0
                    # an id without neighbours is in no phrase
                    known[1:-1] &= known[:-2] | known[2:]
                    keep = known.copy()
                    keep[1:] |= known[:-1]
                    found.append(np.where(known, ids, _BREAK)[keep])
                    found.append(np.array([_BREAK], dtype=np.int32))
            if found:
                ids = np.concatenate(found)
                breaks = np.flatnonzero(ids == _BREAK) + 1
                ends = np.unique(breaks[np.minimum(np.searchsorted(breaks, np.arange(ROW, len(ids) + ROW, ROW)), len(breaks) - 1)])
                starts = np.concatenate([[0], ends]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(starts), pa.array(ids))], ["ids"])

    return stage(texts.mapInArrow(run, "ids array<int>"))


# --- tiles

def count_cells(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs (left, right) and their numbers, tile by tile."""
    width = np.int64(int(right.max(initial=0)) // TILE + 1)
    tile = left // TILE * width + right // TILE
    order = np.argsort(tile, kind="stable")
    tile, left, right = tile[order], left[order], right[order]
    starts = np.flatnonzero(np.diff(tile, prepend=-1))
    sizes = np.diff(np.append(starts, len(tile)))
    out = []
    dense = sizes * DENSE_SHARE >= TILE * TILE
    for s, n in zip(starts[dense].tolist(), sizes[dense].tolist(), strict=True):
        cells = np.bincount(left[s:s + n] % TILE * TILE + right[s:s + n] % TILE, minlength=TILE * TILE)
        some = np.flatnonzero(cells)
        out.append((left[s] // TILE * TILE + some // TILE, right[s] // TILE * TILE + some % TILE, cells[some]))
    rest = ~np.repeat(dense, sizes)
    if rest.any():
        # all sparse tiles at once, as sorted coordinates
        key, n = np.unique(left[rest] << 32 | right[rest], return_counts=True)
        out.append((key >> 32, key & 0xFFFFFFFF, n))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Ranks:
    """A block of frequent phrases of one length: (left, right) -> rank; -1 for others.  Sent to every task."""

    def __init__(self, table: pa.Table):
        key = table.column("x").to_numpy().astype(np.int64) << 32 | table.column("y").to_numpy().astype(np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], table.column("id").to_numpy().astype(np.int64)[order]

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(left), -1, dtype=np.int64)
        key = np.where((left >= 0) & (right >= 0), left << 32 | right & 0xFFFFFFFF, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], -1)


def cells(ids: DataFrame, chain: list, complete: bool) -> DataFrame:
    """(x, y, f): cells of the phrases that are one word longer than the last of ``chain``, which has ranks of pairs, then of triples.

    ``complete`` says that the last ranks are all there are; then the phrase's second part must be among them as well.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = [c.value for c in chain]
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                held.append(batch.column("ids")[row].values.to_numpy(zero_copy_only=False))
                size += len(held[-1])
                if size >= CHUNK:
                    yield _cells_of(np.concatenate(held), ranks, complete)
                    held, size = [], 0
        if held:
            yield _cells_of(np.concatenate(held), ranks, complete)

    return ids.mapInArrow(run, "x long, y long, f long").groupBy("x", "y").agg(F.sum("f").alias("f")).where(F.col("f") >= MIN_COUNT)


def _cells_of(ids: np.ndarray, ranks: list[Ranks], complete: bool) -> pa.RecordBatch:
    words = ids.astype(np.int64)
    left = words
    for step, one in enumerate(ranks):
        # left[p] is the phrase of step + 1 words that begins at p
        left = one.of(left[:len(left) - 1], words[step + 1:])
    right = words[len(ranks) + 1:]
    begin = left[:len(right)]
    some = (begin >= 0) & (right >= 0)
    if ranks and complete:
        some &= left[1:len(right) + 1] >= 0
    x, y, f = count_cells(begin[some], right[some])
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(f)], ["x", "y", "f"])


# --- phrases

def _blocks(ranked: DataFrame, total: int) -> Iterator[tuple[pa.Table, bool]]:
    """The entries in blocks of at most ``BLOCK``, and whether the block is all there is."""
    for low in range(0, total, BLOCK):
        yield ranked.where((F.col("id") >= low) & (F.col("id") < low + BLOCK)).select("x", "y", "id").toArrow(), total <= BLOCK


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def frequent(ids: DataFrame, vocabulary) -> DataFrame:
    """(lang, words, f): the frequent phrases of words with ids."""
    sc = ids.sparkSession.sparkContext
    pairs = _ranked(stage(cells(ids, [], True)), ["x", "y"]).transform(stage)
    levels, current, n = [pairs], [], pairs.count()
    level_tables: list[list] = [[[sc.broadcast(Ranks(t)), whole] for t, whole in _blocks(pairs, n)]]
    for _ in range(3, MAX_WORDS + 1):
        chains = [[]]
        for own in level_tables:
            chains = [[*c, b] for c in chains for b in own]
        current = [cells(ids, [b for b, _ in c], all(w for _, w in c)) for c in chains if c]
        if not current:
            break
        found = _ranked(stage(_union(current)), ["x", "y"]).transform(stage)
        levels.append(found)
        level_tables.append([[sc.broadcast(Ranks(t)), whole] for t, whole in _blocks(found, found.count())])
    named = levels[0].select("id", F.array("x", "y").alias("words"), "f")
    out = [named]
    for found in levels[1:]:
        # the left part's words by its rank
        named = stage(found.join(named.select(F.col("id").alias("x"), "words"), "x")
                      .select("id", F.concat("words", F.array("y")).alias("words"), "f"))
        out.append(named)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        for batch in batches:
            rows = batch.column("words").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([words.lang[r[0]] for r in rows], pa.string()), pa.array([[words.word[i] for i in r] for r in rows], pa.list_(pa.string())),
                 batch.column("f")], ["lang", "words", "f"])

    return _union([o.select("words", "f") for o in out]).mapInArrow(spell, "lang string, words array<string>, f long")


def frequent_beyond(texts: DataFrame, vocabulary) -> DataFrame:
    """(lang, words, f): the frequent phrases that hold a word without an id, counted by their texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_words = vocabulary.value
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                known, own = known_words.ids(lang), counts.setdefault(lang, Counter())
                for piece in _normal(text).split(b"\n"):
                    words = piece.split()
                    other = np.cumsum([0, *(w not in known for w in words)])
                    for size in range(2, MAX_WORDS + 1):
                        for p in np.flatnonzero(other[size:] > other[:-size]).tolist():
                            own[b" ".join(words[p:p + size])] += 1
            for lang, own in counts.items():
                phrases = [p.decode("utf-8", "surrogatepass").split(" ") for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(phrases, pa.list_(pa.string())),
                                                  pa.array([*own.values()], pa.int64())], ["lang", "words", "f"])

    return (texts.mapInArrow(run, "lang string, words array<string>, f long").groupBy("lang", "words").agg(F.sum("f").alias("f"))
            .where(F.col("f") >= MIN_COUNT))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, words, phrase, f) of the candidates; (lang, phrase, f) of frequent words; (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    texts = _texts(docs, text, lang)
    counted = stage(word_counts(texts).where(F.col("word").isNull() | (F.col("f") >= MIN_COUNT)))
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = stage(_ranked(counted.where("word IS NOT NULL"), ["lang", "word"]))
    vocabulary = sc.broadcast(Vocabulary(words.where(F.col("id") < BLOCK).select("lang", "word", "id").toArrow()))
    found = frequent(encoded(texts, vocabulary), vocabulary)
    if words.count() > BLOCK:
        found = found.unionByName(frequent_beyond(texts, vocabulary))
    phrases = stage(found.withColumn("phrase", F.concat_ws(" ", "words")))
    return phrases, words.select("lang", F.col("word").alias("phrase"), "f"), totals


def _whole(c: Column | str) -> Column:
    """A count as a decimal, whose products do not overflow."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one contains often enough."""
    counts = phrases.select("lang", "phrase", "f").unionByName(words)
    size = F.size("words")
    cuts = (phrases.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("words", F.lit(1), F.col("k"))).alias("left"),
                    F.concat_ws(" ", F.slice("words", F.col("k") + 1, size - F.col("k"))).alias("right")))
    part = (cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    best = part.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    inner = (phrases.where(size > 2).select("lang", "words", "f", F.explode(F.sequence(F.lit(2), size - 1)).alias("z"))
             .select("lang", "words", "f", "z", F.explode(F.sequence(F.lit(1), size - F.col("z") + 1)).alias("b"))
             .select("lang", F.concat_ws(" ", F.slice("words", F.col("b"), F.col("z"))).alias("phrase"), "f")
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    return (best.join(inner, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (_whole("longer") * 100 < _whole("a") * CONTAINED_PERCENT))
            .select("lang", "phrase", "a", "l", "r", "score"))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """The first ``top`` candidates of each language: ``RESULT``."""
    phrases, words, totals = phrase_counts(docs, text, lang)
    # a rank limit in each task comes before the shuffle, so a language is at most top rows a task
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored(phrases, words).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.col("rank").cast("long")).join(totals, "lang").select(*RESULT)

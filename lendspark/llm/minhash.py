"""MinHash near-duplicates with tensored banding and exact verification.

Each document has two collections of ``HALVES`` half keys of ``PER_HALF``
minhashes.  A table key joins one half key of the first collection with one of
the second: ``HALVES ** 2`` tables from ``2 * HALVES * PER_HALF`` minhashes.  Two
documents meet in a table when a pair of half keys agrees, which for similarity
0.8 fails with probability below 2 * (1 - 0.8 ** 2) ** 10 < 1e-4.

Steps: documents with equal shingle sets collapse to one representative; half
keys that nobody else has are dropped, and table keys are formed of the rest;
in a bucket documents are compared with a centre, not with one another: the
one that meets most others in its buckets, which in a family of copies is the one
closest to the original.  Documents that still share a bucket with another
component are joined exactly across components on the rarest shingles of their
sets, with the positional bound of set joins, so a document with many shingles of
its own meets few.  Every link is confirmed on the full shingle sets of both texts.

Defined results: texts without words have no shingles and link with nothing; a
null id links with nothing and its component is null; rows with one doc_id are
one document and linked if any of its texts is; repeated rows are kept or
dropped alike.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendspark.llm import textkernel as K
from lendspark.llm.components import components
from lendspark.llm.scratch import stage

SHINGLE = 5
PERCENT = 80
HALVES = 10
PER_HALF = 2
STAR_ROUNDS = 2                 # rounds against centres before what is left is joined across components

_ODD = K.mix64(np.arange(1, 2 * HALVES * PER_HALF + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = K.mix64(np.arange(101, 2 * HALVES * PER_HALF + 101, dtype=np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the texts' ranges.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer
    than k words, but not none, has one shingle, all of its words.
    """
    n = len(offsets) - 1
    hashes, _, _, bounds = K.words(data, offsets, "space", lower=True)
    h, first = K.runs(hashes, bounds, k)
    rows = K.row_of(first, bounds)
    n_words = np.diff(bounds)
    for size in range(1, k):
        short = np.flatnonzero(n_words == size)
        if len(short):
            whole = hashes[bounds[short][:, None] + np.arange(size)]
            h = np.concatenate([h, K.runs(whole.ravel(), np.arange(0, whole.size + 1, size), size)[0] ^ np.uint64(size)])
            rows = np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return K.distinct_in_rows(h[order], rows[order], n)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (size of the shingle set), d1 and d2 (digest of the set), a and b (half keys)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.blocks(batch):
                h, bounds = shingle_sets(data, offsets, k)
                some = np.flatnonzero(np.diff(bounds))
                n = hi - lo
                digest = np.zeros((2, n), dtype=np.uint64)
                half = np.zeros((n, 2 * HALVES), dtype=np.uint64)
                if len(some):
                    at = bounds[:-1][some]
                    for d in range(2):
                        digest[d, some] = np.add.reduceat(K.mix64(h * np.uint64(0x2545F4914F6CDD1D) + np.uint64(d + 1)), at)
                    for j in range(2 * HALVES):
                        for i in range(PER_HALF):
                            f = j * PER_HALF + i
                            low = np.minimum.reduceat(h * _ODD[f] + _ADD[f], at)
                            half[some, j] = K.mix64(half[some, j] + low)
                keys = half.view(np.int64)
                edges = pa.array(np.arange(0, n * HALVES + 1, HALVES, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[lo:hi], pa.array(np.diff(bounds)), pa.array(digest[0].view(np.int64)),
                     pa.array(digest[1].view(np.int64)),
                     pa.ListArray.from_arrays(edges, pa.array(keys[:, :HALVES].ravel())),
                     pa.ListArray.from_arrays(edges, pa.array(keys[:, HALVES:].ravel()))], ["doc_id", "n", "d1", "d2", "a", "b"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "doc_id long, n long, d1 long, d2 long, a array<long>, b array<long>"))


def table_keys(reps: DataFrame) -> DataFrame:
    """(rep, key) for the tables in which a representative may meet another."""
    halves = reps.select("rep", F.posexplode(F.concat("a", "b")).alias("i", "v"))
    shared = halves.groupBy("i", "v").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("i", "v")
    mine = (halves.join(shared, ["i", "v"]).groupBy("rep")
            .agg(F.collect_list(F.when(F.col("i") < HALVES, F.struct("i", "v"))).alias("a"),
                 F.collect_list(F.when(F.col("i") >= HALVES, F.struct("i", "v"))).alias("b")))
    return (mine.select("rep", F.explode("a").alias("x"), "b").select("rep", "x", F.explode("b").alias("y"))
            .select("rep", F.xxhash64("x.i", "x.v", "y.i", "y.v").alias("key")))


def similar(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            keep = np.zeros(batch.num_rows, dtype=bool)
            tb = batch.column("tb")
            same = (b[1:] == b[:-1]) & pc.equal(tb.slice(1), tb.slice(0, max(0, batch.num_rows - 1))).to_numpy(zero_copy_only=False)
            # of rows with one centre and text (they come together) its set is made once
            start = 0
            while start < batch.num_rows:
                end = start + 1
                while end < batch.num_rows and same[end - 1]:
                    end += 1
                centre = _sets(batch.slice(start, 1), "tb", k)[0]
                for i, s in enumerate(_sets(batch.slice(start, end - start), "ta", k)):
                    if len(s) and len(centre):
                        at = np.minimum(np.searchsorted(centre, s), len(centre) - 1)
                        both = int((centre[at] == s).sum())
                        keep[start + i] = 100 * both >= percent * (len(s) + len(centre) - both)
                start = end
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return (pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
            .select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _sets(batch: pa.RecordBatch, column: str, k: int) -> list[np.ndarray]:
    out = []
    for _, _, data, offsets in K.blocks(batch, column):
        h, bounds = shingle_sets(data, offsets, k)
        out += [h[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sig = stage(signatures(docs, k))
    reps = stage(sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n")
                 .agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")))
    keys = stage(table_keys(reps))
    texts = stage(_texts(docs, keys))
    labels = _linked(keys, reps, texts, k, percent)
    same = reps.select("d1", "d2", "n", "rep")
    ids = sig.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2", "n").distinct()
    # all texts of one id belong to one node
    split = ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id")
    extra = stage(ids.join(split, "doc_id").join(same, ["d1", "d2", "n"])
                  .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b"))
    if not extra.isEmpty():
        labels = stage(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(extra)))
    found = sig.select("doc_id", "n", "d1", "d2").join(same, ["d1", "d2", "n"], "left")
    found = found.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"),
                        F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(rep, text) of the representatives that share a table key; several texts where rows share an id."""
    wanted = (keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("key"))
    wanted = keys.join(wanted, "key").select("rep").distinct()
    text = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where(F.col("text").isNotNull())
    return text.join(wanted, "rep").distinct()


def _linked(keys: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, component) of the representatives that link with another."""
    crowd = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    keys = stage(keys.join(crowd, "key").join(reps.select("rep", "n"), "rep"))
    # how many others a representative meets in its buckets
    met_by = keys.groupBy("rep").agg(F.sum("c").alias("pop"))
    keys = stage(keys.drop("c").join(met_by, "rep"))
    labels, tested = None, None
    for r in range(STAR_ROUNDS):
        here = _labelled(keys, labels)
        rank = F.struct("pop", (-F.col("rep")).alias("o")) if r == 0 else F.struct(F.xxhash64("rep", F.lit(r)).alias("o"))
        live = _live(here, F.max_by(F.struct("rep", "comp", "n"), rank).alias("c"))
        live = live.select("key", F.col("c.rep").alias("b"), F.col("c.comp").alias("cb"), F.col("c.n").alias("nb"))
        # each representative is compared with the centre it meets most often; sizes too far apart cannot do
        met = (here.join(live, "key").where(F.col("comp") != F.col("cb"))
               .where(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb"))
               .groupBy(F.col("rep").alias("a"), "b").agg(F.count(F.lit(1)).alias("times")))
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        pairs = stage(met.groupBy("a").agg(F.max_by("b", F.struct("times", -F.col("b"))).alias("b")))
        if pairs.isEmpty():
            break
        labels = _merge(labels, stage(similar(pairs, texts, k, percent)))
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tested = both if tested is None else tested.union(both)
    here = _labelled(keys, labels)
    left = stage(here.join(_live(here).select("key"), "key", "left_semi").select("rep", "comp").distinct())
    if not left.isEmpty():
        pairs = _across(left, texts, k, percent)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        labels = _merge(labels, stage(similar(stage(pairs), texts, k, percent)))
    if labels is None:
        return reps.where("false").select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    return labels


def _labelled(keys: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return keys.withColumn("comp", F.col("rep"))
    return (keys.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
            .withColumn("comp", F.coalesce("component", "rep")).drop("component"))


def _live(here: DataFrame, *more) -> DataFrame:
    """The keys that hold several components."""
    return here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *more).where("lo < hi")


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    if links.isEmpty():
        return labels
    old = None if labels is None else labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return stage(components(links if old is None else links.union(old)))


def _across(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b), a > b, of different components that may have the similarity: an exact prefix-filtered set join.

    Shingles are ordered by how many of these documents hold them.  If two sets
    share o shingles and the first one shared stands at places i and j of them,
    o is at most min(n_a - i, n_b - j), places counted from 0.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.blocks(batch):
                h, bounds = shingle_sets(data, offsets, k)
                n = np.diff(bounds)
                at = pa.array(np.repeat(np.arange(lo, hi), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").take(at), batch.column("comp").take(at), pa.array(np.repeat(n, n)),
                     pa.array(h.view(np.int64))], ["rep", "comp", "n", "s"])

    sets = texts.join(left, "rep").select("rep", "comp", "text").mapInArrow(run, "rep long, comp long, n long, s long")
    sets = stage(sets)
    known = sets.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a shingle that only one document holds comes first in its order and matches nothing: only its number counts
    shared = sets.join(known, "s")
    own = shared.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("m"))
    # o >= percent / 100 * n for any partner, so a set with too many shingles of its own has none
    own = own.where(100 * F.col("m") >= percent * F.col("n"))
    place = Window.partitionBy("rep", "n").orderBy("df", "s")
    prefix = (shared.join(own, ["rep", "n"]).withColumn("i", F.col("n") - F.col("m") + F.row_number().over(place) - 1)
              .where(100 * (F.col("n") - F.col("i")) >= percent * F.col("n")).select("s", "rep", "comp", "n", "i"))
    x, y = prefix.alias("x"), prefix.alias("y")
    share = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    fits = (100 + percent) * share >= percent * (F.col("x.n") + F.col("y.n"))
    return (x.join(y, (F.col("x.s") == F.col("y.s")) & (F.col("x.rep") > F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & fits)
            .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stays: one of each component, columns unchanged.

    Of rows that share an id one stays, that of the smallest text hash; rows with a null id all stay.
    """
    found = stage(near_duplicates(docs, k, percent))
    drop = found.where(~F.col("kept")).select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(drop, docs["doc_id"].cast("long") == drop["_id"], "left_anti")
    again = stage(found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id")
                  .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")))
    if again.isEmpty():
        return kept
    several = kept.join(again, kept["doc_id"].cast("long") == again["_id"], "left_semi")
    one = (several.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))).alias("r"))
           .select("r.*"))
    return kept.join(again, kept["doc_id"].cast("long") == again["_id"], "left_anti").unionByName(one)

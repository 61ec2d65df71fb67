"""Substring dedup by hashed word windows, with exact spans.

A window is a run of ``PASSAGE_WORDS`` words anywhere in a text, across lines
too, normalised as in ``unit_dedup``.  Of equal windows the occurrence of lowest
rank stays (smallest doc_id, null last, then text hash, then place); a word goes
if any other window covers it.  A repeat that overlaps its first occurrence in
the same text goes only from that one's end on.  So every repeated passage of
``PASSAGE_WORDS`` words or more goes whole, and each word that goes is kept at an
earlier place.

Windows are as many as words, so only those that may repeat are written: the
fingerprint of a window is the least hash of its runs of half as many words.
Equal windows have equal fingerprints, and neighbours mostly share one, so about
one word in thirteen makes a row; windows are formed where a fingerprint
occurs twice.  Nothing is sampled: a repeated window is always found.

Defined results as in ``unit_dedup``.  Removed offsets are in characters and
include the blanks after the last word.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm import textkernel as K
from lendspark.llm.scratch import stage
from lendspark.llm.unit_dedup import remaining, shortened, text_key

PASSAGE_WORDS = 50

_WORD = re.compile(r"[^\x20\x09-\x0D]+[\x20\t]*")


def run_hashes(hashes: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k words from each word on; rows are not looked at."""
    up, down = K._power_tables(len(hashes) + 1)
    run = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(K.mix64(hashes + np.uint64(salt)) * up[:len(hashes)], out=run[1:])
    n = max(0, len(hashes) - k + 1)
    return K.mix64((run[k:k + n] - run[:n]) * down[:n])


def sliding(values: np.ndarray, width: int, reduce: np.ufunc) -> np.ndarray:
    """The least (or largest) of each run of ``width`` values."""
    n, reach = max(0, len(values) - width + 1), 1
    while 2 * reach <= width:
        values = reduce(values[:-reach], values[reach:])
        reach *= 2
    return reduce(values[:n], values[width - reach:width - reach + n])


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows that lie in one row, their fingerprints, all runs' hashes, and the runs that are fingerprints."""
    half = (size + 1) // 2
    width = size - half + 1
    if len(hashes) < size:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none
    runs = run_hashes(hashes, half, 3)
    least = sliding(runs, width, np.minimum)
    row_end = np.repeat(bounds[1:], np.diff(bounds))[:len(least)]
    whole = np.arange(len(least)) + size <= row_end
    # a run is the fingerprint of a window around it if it equals the largest of those windows' least
    around = np.concatenate([np.zeros(width - 1, np.uint64), np.where(whole, least, np.uint64(0)), np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((sliding(around, width, np.maximum) == runs) & (runs > 0))
    first = np.flatnonzero(whole)
    return first, least[first], runs, chosen


def prints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, f): the fingerprints of a text, a row for each place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in K.blocks(batch):
                hashes, _, _, bounds = K.words(data, offsets, "space", lower=True)
                _, _, runs, chosen = fingerprints(hashes, bounds, size)
                at = pa.array(K.row_of(chosen, bounds) + lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("h").take(at),
                                                  pa.array(runs[chosen].view(np.int64))], ["doc_id", "h", "f"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), "text")
            .mapInArrow(run, "doc_id long, h long, f long"))


def windows(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, place, d1, d2) of the windows that have one of their text's wanted fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.blocks(batch):
                hashes, _, _, bounds = K.words(data, offsets, "space", lower=True)
                first, least, _, _ = fingerprints(hashes, bounds, size)
                rows = K.row_of(first, bounds)
                asked = batch.column("fs").slice(lo, hi - lo)
                owners = np.repeat(np.arange(hi - lo), asked.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                known = K.in_row(asked.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), owners)
                keep = np.isin(K.in_row(least, rows), known)
                first, rows = first[keep], rows[keep]
                at = pa.array(rows + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(first - bounds[rows]),
                     *[pa.array((run_hashes(hashes, size, salt)[first] if len(first) else np.zeros(0, np.uint64)).view(np.int64))
                       for salt in (1, 2)]], ["doc_id", "h", "place", "d1", "d2"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), "text")
    wanted = wanted.select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "fs")
    return (keyed.join(wanted, F.col("h").eqNullSafe(F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
            .select("doc_id", "h", "text", "fs").mapInArrow(run, "doc_id long, h long, place long, d1 long, d2 long"))


def surplus(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, words): ranges of words (first, end) to be removed from a text."""
    found = stage(prints(docs, size))
    # as with lines: partial counts before the shuffle, and a written table so that Spark splits large partitions of the join
    often = stage(found.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f"))
    wanted = found.join(often, "f").groupBy("doc_id", "h").agg(F.collect_set("f").alias("fs"))
    placed = stage(windows(docs, wanted, size))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "place")
    first = stage(placed.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
                  .where("n > 1").select("d1", "d2", "first"))
    mine = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    begin = F.when(mine, F.greatest("place", F.col("first.place") + size)).otherwise(F.col("place"))
    return (placed.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first")))
            .select("doc_id", "h", begin.alias("a"), (F.col("place") + size).alias("b"))
            .groupBy("doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("words")))


def cut(text: str, words: list[dict]) -> tuple[str, list[dict]]:
    """The text without these ranges of words, and the offsets of what went."""
    spans = [m.span() for m in _WORD.finditer(text)]
    change = np.zeros(len(spans) + 1, dtype=np.int64)
    for r in words:
        change[r["a"]] += 1
        change[r["b"]] -= 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]]))).reshape(-1, 2)
    removed = [{"start": spans[a][0], "end": spans[b - 1][1]} for a, b in edge.tolist()]
    left = [text[a:b] for a, b in zip([0, *(r["end"] for r in removed)], [*(r["start"] for r in removed), len(text)], strict=True)]
    return "".join(left), removed


def dedup_passages(docs: DataFrame, size: int = PASSAGE_WORDS) -> DataFrame:
    """The rows of ``docs`` with shortened texts and, in ``__removed``, the offsets of what was removed."""
    return shortened(docs, surplus(docs, size), "words", cut)


def keep_first_passages(docs: DataFrame, size: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without repeated passages, columns unchanged; ``n_chars`` follows the text.

    A document of which nothing but white space is left goes.
    """
    return remaining(docs, dedup_passages(docs, size))

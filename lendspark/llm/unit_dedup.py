"""Substring dedup by line, paragraph or sentence hashing.

Units are lines, paragraphs (runs of lines with words) or sentences (parts of lines that end with
``.``, ``!`` or ``?`` before white space).  They are normalised (A-Z lower
case, one space between words, no white space around), their 128-bit digests
grouped over all documents, and of each digest the occurrence of lowest rank
stays: smallest doc_id (null last), then text hash, then place.  All others are repeats.

Of lines and paragraphs, repeats of at least ``MIN_WORDS`` words are removed.  Sentences are hashed whatever
their length, and repeats are removed where they stand in an unbroken run of at least ``RUN_WORDS`` words
together: so a passage that was copied into a longer line, or across lines, goes whole, and a short sentence that
two texts have by chance stays.  The offsets of what is removed, in characters of the original text, are returned.
What is removed is always kept at an earlier place.

Defined results: null and empty texts have no units and stay as they are;
repeated rows (equal id and text) are one document and are cut alike; rows that
share an id but not the text are different documents; equal ranks do not occur, as a place in a
text is part of the rank; texts of any length are read whole; an empty table gives an empty table.  Only
``doc_id`` and ``text`` are read; other columns pass unchanged whatever their names (but names that begin with ``__``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendspark.llm import textkernel as K
from lendspark.llm.scratch import stage

MIN_WORDS = 13          # of a line or paragraph
RUN_WORDS = 20          # of a run of sentences

_REMOVED = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the parts of lines between sentence ends, those without words included."""
    newlines = np.flatnonzero(data == 0x0A)
    mark = (data == 0x2E) | (data == 0x21) | (data == 0x3F)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    cuts = np.flatnonzero(mark[:-1] & white[1:]) + 1 if len(data) else newlines
    cuts = cuts[~np.isin(cuts, offsets)]                 # white space of the next text
    return (np.sort(np.concatenate([offsets[:-1], newlines + 1, cuts])), np.sort(np.concatenate([offsets[1:], newlines, cuts])))


def unit_lines(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte span (start, end) of each unit with words, its row, and its number in the row.

    The number of a line is its place among all lines, that of a paragraph its first line's, that of
    a sentence its place among the sentences with words.
    """
    starts, ends = _sentences(data, offsets) if unit == "sentence" else K.spans(data, offsets, "line")
    words = K.spans(data, offsets, "space")[0]
    some = np.searchsorted(words, ends) > np.searchsorted(words, starts)
    starts, ends = starts[some], ends[some]
    rows = np.searchsorted(offsets, starts, side="right") - 1
    if unit == "sentence":
        return starts, ends, rows, np.arange(len(rows)) - np.searchsorted(rows, rows)
    newlines = np.flatnonzero(data == 0x0A)
    line = np.searchsorted(newlines, starts) - np.searchsorted(newlines, offsets[rows])
    if unit == "paragraph" and len(starts):
        first = np.ones(len(starts), dtype=bool)
        first[1:] = (rows[1:] != rows[:-1]) | (line[1:] != line[:-1] + 1)
        last = np.append(first[1:], True)
        return starts[first], ends[last], rows[first], line[first]
    if unit not in ("line", "paragraph"):
        raise ValueError(unit)
    return starts, ends, rows, line


def digests(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each unit and two hashes of its normalised words."""
    hashes, word_starts, _, _ = K.words(data, offsets, "space", lower=True)
    a, b = np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)
    out = []
    for salt in (1, 2):
        up, down = K._power_tables(len(hashes) + 1)
        run = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(K.mix64(hashes + np.uint64(salt)) * up[:len(hashes)], out=run[1:])
        out.append(K.mix64((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64)))
    return b - a, out[0], out[1]


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def units(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(doc_id, h, line, d1, d2) of the units long enough; sentences of any length."""
    least = 1 if unit == "sentence" else min_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.blocks(batch):
                starts, ends, rows, line = unit_lines(data, offsets, unit)
                n, d1, d2 = digests(data, offsets, starts, ends)
                keep = np.flatnonzero(n >= least)
                at = pa.array(rows[keep] + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(line[keep]),
                     pa.array(d1[keep].view(np.int64)), pa.array(d2[keep].view(np.int64))], ["doc_id", "h", "line", "d1", "d2"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("h"), "text")
            .mapInArrow(run, "doc_id long, h long, line long, d1 long, d2 long"))


def surplus(docs: DataFrame, unit: str, min_words: int) -> DataFrame:
    """(doc_id, h, lines): the first lines of the units to be removed from a document."""
    found = stage(units(docs, unit, min_words))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "line")
    # minima are taken in each task before the shuffle, so a very common unit is no large group; written, so
    # that the join is one of two plain shuffles, whose large partitions Spark splits
    first = stage(found.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first"))
                  .where("n > 1").select("d1", "d2", "first"))
    return (found.join(first, ["d1", "d2"]).where(~rank.eqNullSafe(F.col("first")))
            .groupBy("doc_id", "h").agg(F.collect_set("line").alias("lines")))


def cut_sentences(text: str, sentences: list[int], run_words: int) -> tuple[str, list[dict]]:
    """The text without the runs of these sentences that are long enough, and the offsets of the runs."""
    edges = [m.span() for m in _SENTENCE_END.finditer(text)]
    spans = [(a, b, len(_WORD.findall(text[a:b]))) for a, b in zip([0, *(e for _, e in edges)], [*(s for s, _ in edges), len(text)], strict=True)]
    spans = [s for s in spans if s[2]]
    runs: list[list[int]] = []                          # start, end, words, number of the last sentence
    for i in sorted(sentences):
        if runs and runs[-1][3] == i - 1:
            runs[-1][1:] = [spans[i][1], runs[-1][2] + spans[i][2], i]
        else:
            runs.append([*spans[i], i])
    removed = [{"start": a, "end": b} for a, b, n, _ in runs if n >= run_words]
    kept = zip([0, *(r["end"] for r in removed)], [*(r["start"] for r in removed), len(text)], strict=True)
    return "".join(text[a:b] for a, b in kept), removed


def cut(text: str, lines: list[int], unit: str, min_words: int = RUN_WORDS) -> tuple[str, list[dict]]:
    """The text without the units that have these numbers, and their offsets."""
    if unit == "sentence":
        return cut_sentences(text, lines, min_words)
    parts = text.split("\n")
    gone = np.zeros(len(parts), dtype=bool)
    removed, at = [], np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    for first in sorted(lines):
        last = first
        while unit == "paragraph" and last + 1 < len(parts) and _has_word(parts[last + 1]):
            last += 1
        gone[first:last + 1] = True
        removed.append({"start": int(at[first]), "end": int(at[last] + len(parts[last]))})
    return "\n".join(p for p, g in zip(parts, gone, strict=True) if not g), removed


_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])(?=[\x20\x09-\x0D])|\n")


def _has_word(line: str) -> bool:
    return bool(line.strip(_SPACE))


def least_words(unit: str, min_words: int | None) -> int:
    return min_words if min_words is not None else RUN_WORDS if unit == "sentence" else MIN_WORDS


def dedup_units(docs: DataFrame, unit: str = "line", min_words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with shortened texts and, in ``__removed``, the offsets of what was removed.

    ``min_words``: of a line or paragraph, or of a run of sentences.
    """
    least = least_words(unit, min_words)
    return shortened(docs, surplus(docs, unit, least), "lines", lambda text, lines: cut(text, lines, unit, least))


def shortened(docs: DataFrame, gone: DataFrame, column: str, cut_one: Callable[[str, list], tuple[str, list[dict]]]) -> DataFrame:
    """The rows of ``docs``, those with a row in ``gone`` (doc_id, h and this column) cut, and ``__removed``."""
    gone = gone.select(F.col("doc_id").alias("__unit_id"), F.col("h").alias("__unit_h"), F.col(column).alias("__unit_lines"))
    joined = (docs.withColumn("__unit_key", text_key())
              .join(gone, F.col("__unit_key").eqNullSafe(F.col("__unit_h")) & docs["doc_id"].cast("long").eqNullSafe(F.col("__unit_id")), "left")
              .drop("__unit_key", "__unit_id", "__unit_h"))
    schema = T.StructType([*docs.schema.fields, T.StructField("__removed", _REMOVED)])
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = batch.column(batch.num_columns - 1)
            texts, removed = batch.column(place), [[] for _ in range(batch.num_rows)]
            changed = np.flatnonzero(lines.is_valid().to_numpy(zero_copy_only=False))
            if len(changed):
                texts = texts.to_pylist()
                for i in changed.tolist():
                    texts[i], removed[i] = cut_one(texts[i], lines[i].as_py())
                texts = pa.array(texts, pa.string())
            columns = [texts if j == place else batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], schema.names)

    return joined.mapInArrow(run, schema)


def keep_first_units(docs: DataFrame, unit: str = "line", min_words: int | None = None) -> DataFrame:
    """``docs`` without repeated units, columns unchanged; ``n_chars`` follows the text.

    A document of which nothing but white space is left goes.
    """
    return remaining(docs, dedup_units(docs, unit, min_words))


def remaining(docs: DataFrame, cut_docs: DataFrame) -> DataFrame:
    """The cut rows with the columns of ``docs``, without those of which nothing is left."""
    changed = F.size("__removed") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut_docs = cut_docs.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut_docs.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)

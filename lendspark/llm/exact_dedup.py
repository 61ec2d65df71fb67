"""Exact dedup against a minimal perfect hash of historical digests.

Texts are equal when identical after lower-casing A-Z only; a text's key is the SHA-256
digest of its normalised UTF-8 bytes, a null text counts as empty.

The distinct digests of the history are dealt into shards by digest, about
``SHARD_DIGESTS`` in each, and every shard gets a minimal perfect hash: levels of bits
in which a digest claims the bit it alone falls on, the others go on to the next level;
the rank of its bit is the digest's slot.  Slots hold the full digest, the locator of
the winner (doc_id and place) and the size of the group.  ``build_index`` returns that
as a table of one row a shard, which can be written and kept for later runs.

New documents are grouped by digest in each task before the shuffle, so a text that a
third of all rows share is one row a task.  Each digest is looked up in its shard: the slot
is computed and its full digest compared byte by byte.  Members are repeats of the
history, the others form groups of their own.

Of equal texts the row with the largest doc_id stays (a null id is smaller than any), of rows
with one id the one that was read last.

Defined results: null and empty texts are equal to one another; white space counts; rows
repeated in full are rows of their own, of which one stays; no row is dropped from the
result of ``dedup``; empty tables give empty tables; an empty history is an index without
slots.  Texts of any length are read whole.  Only ``doc_id`` and ``text`` are read, and
other columns pass ``keep_one`` unchanged whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendspark.llm.scratch import stage

SHARD_DIGESTS = 1024
LEVEL_BITS = 2                  # bits of a level for each digest that is left
DIGEST_BYTES = 32

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

INDEX_SCHEMA = "shard long, sizes binary, bits binary, digests binary, ids binary, has_id binary, places binary, counts binary"
_FOUND_SCHEMA = "digest binary, keep_id long, keep_place long, group_size long, member boolean"


# --- the hash of one shard

def _level_place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where each digest (a row of four words) falls in a level of this many bits."""
    x = np.full(len(words), (level * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for column in range(words.shape[1]):
        x = (x ^ words[:, column]) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        x ^= x >> np.uint64(32)
    return x % np.uint64(size)


def build_levels(words: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Bits of each level, all bits end to end, and the slot of each of these distinct digests."""
    sizes, bits, place = [], [], np.zeros(len(words), dtype=np.int64)
    left, start = np.arange(len(words)), 0
    while len(left):
        size = max(1, LEVEL_BITS * len(left))
        at = _level_place(words[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        place[left[alone[at]]] = at[alone[at]] + start
        left = left[~alone[at]]
        sizes.append(size)
        bits.append(alone)
        start += size
    filled = np.concatenate(bits) if bits else np.zeros(0, dtype=bool)
    rank = np.cumsum(filled) - 1
    return sizes, filled, rank[place] if len(words) else place


def look_up(sizes: list[int], filled: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The slot each digest would have; -1 where no level has a bit for it.  A digest that is not in the hash may get any slot."""
    rank = np.cumsum(filled) - 1
    slot, left, start = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
    for level, size in enumerate(sizes):
        at = _level_place(words[left], level, size).astype(np.int64) + start
        hit = filled[at]
        slot[left[hit]] = rank[at[hit]]
        left = left[~hit]
        start += size
    return slot


def _raw(column: pa.Array) -> np.ndarray:
    """Digests of a binary column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, DIGEST_BYTES)


def _words(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<u8").reshape(len(raw), DIGEST_BYTES // 8)


# --- digests of documents

def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, place): one row per document, written once; place tells rows with one id and text apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(_LOWER)).digest()
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "digest"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest binary")
    return stage(found.withColumn("place", F.monotonically_increasing_id()))


def _best() -> Column:
    """Of equal texts: the largest doc_id, null smallest, then the last place."""
    return F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "place")).alias("best")


def grouped(prints: DataFrame) -> DataFrame:
    """(digest, best, n): one row per distinct digest; maxima and counts are taken in each task before the shuffle."""
    return prints.groupBy("digest").agg(_best(), F.count(F.lit(1)).alias("n"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")


# --- the index

def build_index(groups: DataFrame, shards: int) -> DataFrame:
    """The hash of these distinct digests, a row for each shard that has any."""
    def one(table: pa.Table) -> pa.Table:
        raw = _raw(table.column("digest").combine_chunks())
        sizes, filled, slot = build_levels(_words(raw))
        order = np.argsort(slot)

        def of(name: str, kind: str) -> bytes:
            return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)[order].astype(kind).tobytes()

        row = {"shard": table.column("shard")[0].as_py(), "sizes": np.array(sizes, "<i8").tobytes(), "bits": np.packbits(filled).tobytes(),
               "digests": raw[order].tobytes(), "ids": of("doc_id", "<i8"), "places": of("place", "<i8"), "counts": of("n", "<i8"),
               "has_id": table.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[order].astype("u1").tobytes()}
        return pa.Table.from_pylist([row], _ARROW)

    return (groups.select(_shard(shards), "digest", F.col("best.doc_id").alias("doc_id"), F.col("best.place").alias("place"), "n")
            .groupBy("shard").applyInArrow(one, INDEX_SCHEMA))


_ARROW = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("sizes", "bits", "digests", "ids", "has_id", "places", "counts"))])


def look_up_groups(index: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """Groups of the history (member, with what the new rows add) and new groups that the history does not have.

    Both tables are dealt by shard; a shard has about ``SHARD_DIGESTS`` distinct digests of either.
    """
    def both(shard: pa.Table, new: pa.Table) -> pa.Table:
        new_raw = _raw(new.column("digest").combine_chunks())
        has = new.column("doc_id").combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        ids, places, n = (new.column(c).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                          for c in ("doc_id", "place", "n"))
        member = np.zeros(len(new_raw), dtype=bool)
        digests, keep_has, keep_ids, keep_places, counts = new_raw[:0], has[:0], ids[:0], ids[:0], ids[:0]
        if shard.num_rows:
            row = shard.to_pylist()[0]
            sizes = np.frombuffer(row["sizes"], "<i8").tolist()
            filled = np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool)
            digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST_BYTES)
            keep_ids, keep_places, counts = (np.frombuffer(row[c], "<i8").copy() for c in ("ids", "places", "counts"))
            keep_has = np.frombuffer(row["has_id"], "u1").astype(bool)
            slot = look_up(sizes, filled, _words(new_raw))
            member = slot >= 0
            member[member] = (digests[slot[member]] == new_raw[member]).all(axis=1)      # all bytes, not the hash, decide
            at = slot[member]
            counts[at] += n[member]
            # digests are distinct on both sides, so a slot is met once
            ours, theirs = ((h.astype(np.int8), i, p) for h, i, p in
                            ((keep_has[at], keep_ids[at], keep_places[at]), (has[member], ids[member], places[member])))
            later = np.zeros(len(at), dtype=bool)
            same = np.ones(len(at), dtype=bool)
            for a, b in zip(ours, theirs, strict=True):
                later |= same & (b > a)
                same &= a == b
            keep_has[at[later]], keep_ids[at[later]], keep_places[at[later]] = (
                has[member][later], ids[member][later], places[member][later])
        other = ~member
        out_has = np.concatenate([keep_has, has[other]])
        return pa.table({
            "digest": pa.array([bytes(x) for x in digests] + [bytes(x) for x in new_raw[other]], pa.binary()),
            "keep_id": pa.array(np.concatenate([keep_ids, ids[other]]), pa.int64(), mask=~out_has),
            "keep_place": pa.array(np.concatenate([keep_places, places[other]]), pa.int64()),
            "group_size": pa.array(np.concatenate([counts, n[other]]), pa.int64()),
            "member": pa.array(np.arange(len(digests) + int(other.sum())) < len(digests))})

    new = groups.select(_shard(shards), "digest", F.col("best.doc_id").alias("doc_id"), F.col("best.place").alias("place"), "n")
    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(both, _FOUND_SCHEMA)


def dedup_prints(history: DataFrame, new: DataFrame) -> DataFrame:
    """``_FOUND_SCHEMA``: every distinct digest of both tables of fingerprints once, by way of the history's index."""
    old_groups, new_groups = stage(grouped(history)), stage(grouped(new))
    shards = max(1, -(-max(old_groups.count(), new_groups.count()) // SHARD_DIGESTS))
    return look_up_groups(stage(build_index(old_groups, shards)), new_groups, shards)


def _older_half(prints: DataFrame) -> Column:
    """Rows of the lower half of the range of ids: the history of a single table."""
    low, high = prints.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return F.lit(False)
    return F.coalesce(F.col("doc_id") <= (low + high) // 2, F.lit(False))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; the table's older half of ids is the history."""
    prints = fingerprints(docs)
    older = _older_half(prints)
    # only groups of several rows are joined back, a text of its own stays without a look; the join is one of two
    # plain shuffles, whose large partitions Spark splits
    several = stage(dedup_prints(prints.where(older), prints.where(~older)).where("group_size > 1").drop("member"))
    return (prints.join(several, "digest", "left")
            .select("doc_id",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                    F.coalesce(F.col("place") == F.col("keep_place"), F.lit(True)).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep_one(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each text, columns unchanged; texts that ``history`` has go.

    Rows with one id and equal text are one document here, of which any one row stays.
    """
    def with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashlib.sha256((t or "").encode("utf-8", "surrogatepass").translate(_LOWER)).digest()
                     for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, "__digest"])

    at, names = docs.columns.index("text"), docs.columns
    new = fingerprints(docs)
    if history is None:
        older = _older_half(new)
        old, new = new.where(older), new.where(~older)
    else:
        old = fingerprints(history)
    found = dedup_prints(old, new)
    member = F.lit(False) if history is None else F.col("member")
    several = stage(found.where((F.col("group_size") > 1) | member)
                    .select(F.col("digest").alias("__several"), F.col("keep_id").alias("__keep_id"), member.alias("__member")))
    marked = docs.mapInArrow(with_digest, T.StructType([*docs.schema.fields, T.StructField("__digest", T.BinaryType())])).join(
        several, F.col("__digest") == F.col("__several"), "left")
    alone = marked.where("__several IS NULL").select(*names)
    winners = (marked.where(F.col("__several").isNotNull() & ~F.col("__member")
                            & F.col("doc_id").cast("long").eqNullSafe(F.col("__keep_id")))
               .groupBy("__digest").agg(F.first(F.struct(*names)).alias("__row")).select("__row.*"))
    return alone.unionByName(winners)

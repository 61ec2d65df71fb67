"""Best-fit packing of documents into sequences, by the sum-of-squares rule.

Each piece of a document goes to the gap for which the sum over all gap sizes of
(number of open sequences with that gap) squared becomes smallest; ties go to the
tightest gap, and a new sequence is opened only when no open one has room.
Pieces are placed in order of falling length.  A pool of documents is packed in
the task that reads it; a pool ends at ``POOL_TOKENS`` tokens or with the task's rows, which bounds memory.  What a pool
leaves in sequences that are not full to ``SLACK`` is packed again, by the same rule, in pools over all
tasks: so the number of sequences hardly depends on how the rows lie in files, and only these pieces are moved.

Defined results: a null or empty text is the end token alone; repeated rows are
packed one by one; of pieces of equal length the one read first is placed first; texts of any length are read whole and cut
into pieces; an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm.scratch import stage

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k.json"
POOL_TOKENS = 1 << 24
SLACK = 0.01                    # share of a sequence that may stay empty in the first pass
# fixed value: how byte-level BPE vocabularies of this kind cut a text into parts
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ROWS_OUT = 1_000

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
_PLACED = PIECES + ", open boolean"
_SECOND = 1 << 61               # sequence ids of the second pass begin here


class Encoder:
    """Token ids (little-endian unsigned 32-bit) of whole texts; none are added, and an added token in a text is one id.

    The vocabulary is a tokenizer file.  If it is byte-level BPE whose ids follow
    its merges, as the default is, tiktoken's encoder is built from that same file:
    the ids are equal and it takes a fifth of the time.
    """

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path(VOCABULARY)
        ranks = byte_ranks(path)
        if ranks:
            import tiktoken
            encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added_tokens(path))
            self._encode = lambda text: encoding.encode(text, allowed_special="all", disallowed_special=())
        else:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            self._encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", self._encode(t)).tobytes() if t else b"" for t in texts]


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings and their ids, if the file is plain byte-level BPE and its ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = (model.get("type") in (None, "BPE") and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
             and before.get("use_regex", True) and not file.get("normalizer") and not model.get("dropout"))
    added = file.get("added_tokens") or []
    # added tokens that take blanks or whole words only, or begin like one another, are left to the tokenizer itself
    plain = plain and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added) and not any(
        s is not t and s["content"].startswith(t["content"]) for s in added for t in added)
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocabulary = model.get("vocab", {})
    if not plain or any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # printable bytes stand for themselves, the others for the characters from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i < 256 + len(merges)}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file and their ids."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens") or []}


_encoders: dict[str | None, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def place(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item by the sum-of-squares rule, and the number of bins.

    Items are taken by falling size, equal ones in the order given.
    """
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, dtype=np.int64)          # open bins by gap
    cost = np.empty(capacity + 1, dtype=np.int64)
    bins = np.zeros(len(sizes), dtype=np.int64)
    offset = np.zeros(len(sizes), dtype=np.int64)
    used = 0
    closed = np.int64(1) << 60
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if s == capacity:
            bins[i], used = used, used + 1
            continue
        have = n[s:]
        # change of the sum of squares when a bin moves from gap g to gap g - s; a bin without a gap is no longer open
        c = cost[:len(have)]
        np.multiply(have, -2, out=c)
        c[0] += 1
        c[1:] += 2 * n[1:capacity + 1 - s] + 2
        c[have == 0] = closed
        k = int(np.argmin(c))
        gap = s + k
        if c[k] < closed:
            b = open_at[gap].pop()
            n[gap] -= 1
        else:
            gap, b, used = capacity, used, used + 1
        bins[i], offset[i] = b, capacity - gap
        left = gap - s
        if left:
            open_at[left].append(b)
            n[left] += 1
    return bins, offset, used


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than the capacity if there are more."""
    first = length % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


class _Pool:
    """Pieces that are packed together, handed on in rows of the result."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.rows: list[tuple[int | None, int, int, bytes]] = []        # doc_id, piece, start, ids
        self.tokens = 0

    def add(self, doc_id: int | None, piece: int, start: int, ids: bytes) -> None:
        self.rows.append((doc_id, piece, start, ids))
        self.tokens += len(ids) // 4

    def flush(self) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(r[3]) // 4 for r in self.rows], dtype=np.int64)
        bins, offset, used = place(sizes, self.capacity)
        gap = self.capacity - np.bincount(bins, weights=sizes, minlength=used)
        open_ = gap[bins] > SLACK * self.capacity
        for a in range(0, len(self.rows), _ROWS_OUT):
            part = slice(a, a + _ROWS_OUT)
            doc, piece, start, ids = zip(*self.rows[part], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes[part]), pa.array(ids, pa.binary()),
                 pa.array(bins[part] + self.sequence), pa.array(offset[part]), pa.array(open_[part])],
                ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "open"])
        self.sequence += used
        self.rows, self.tokens = [], 0


def _first_sequence() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None,
         pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """A row per piece: its ids (binary, little-endian unsigned 32-bit), sequence and offset there.

    ``vocabulary`` is the path of a tokenizer file on every machine; by default
    the installed public one.
    """
    last = np.array([end], dtype="<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, enc = _Pool(capacity, _first_sequence()), encoder(vocabulary)
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a in range(0, len(texts), 256):
                for name, ids in zip(names[a:a + 256], enc.encode([t or "" for t in texts[a:a + 256]]), strict=True):
                    ids += last
                    for p, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                        pool.add(name, p, s, ids[4 * s:4 * (s + n)])
                if pool.tokens >= pool_tokens:
                    yield from pool.flush()
        if pool.rows:
            yield from pool.flush()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(capacity, _SECOND + _first_sequence())
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids")), strict=True):
                pool.add(*row)
                if pool.tokens >= pool_tokens:
                    yield from pool.flush()
        if pool.rows:
            yield from pool.flush()

    placed = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(first, _PLACED))
    left = placed.where("open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    again = left.repartition(max(1, -(-tokens // pool_tokens))).mapInArrow(second, _PLACED)
    return placed.where("NOT open").unionByName(again).drop("open")

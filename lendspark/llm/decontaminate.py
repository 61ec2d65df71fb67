"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of ``width`` consecutive words (a shorter item is one
window).  A window's shingles are ordered by how rare they are in all documents;
a document that contains the share ``containment`` of them must contain one of
the ``m - ceil(containment * m) + 1`` rarest, so only those prefix tokens are
joined.  A match at word p of a document with a token at place o of a window
fixes where the window would lie (p - o); it must lie inside the document
(length and positional bound) and is then compared word by word.

The windows of a benchmark are the query side: at most ``WINDOWS_PER_BLOCK`` of
them are handed to the tasks at once, larger benchmarks go block by block, so
memory does not depend on the benchmark's size and documents are never shuffled.

Defined results: a null or empty text has no words and no hits, a null or empty
item no windows; a null item id counts as the text ``null``; repeated rows are
judged one by one; an empty benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.llm import textkernel as K
from lendspark.session import cut_lineage

WIDTH = 10
SHINGLE = 3                     # words of a shingle; fewer for windows with fewer words
WINDOWS_PER_BLOCK = 200_000

HITS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _text_words(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    low = raw.translate(_LOWER)
    return [low[s:e] for s, e in zip(*(a.tolist() for a in K.spans(data, np.array([0, len(data)]), "alnum")), strict=True)]


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Distinct (window, item_id); a window is its words with one space between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, items = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _text_words(text or "")
                n = min(width, len(words))
                for a in range(len(words) - n + 1 if n else 0):
                    found.append(b" ".join(words[a:a + n]).decode("utf-8", "surrogatepass"))
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(items, pa.string())], ["window", "item_id"])

    return (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
            .mapInArrow(run, "window string, item_id string").distinct())


@dataclass
class Group:
    """Windows of one length and the places of their shingles."""

    length: int
    words: np.ndarray                       # window x length, word hashes
    texts: list[bytes]
    items: list[list[str]]
    shingles: np.ndarray = field(init=False)     # window x places

    def __post_init__(self) -> None:
        n, k = len(self.texts), min(SHINGLE, self.length)
        h, _ = K.runs(self.words.ravel(), np.arange(0, (n + 1) * self.length, self.length), k)
        self.shingles = h.reshape(n, self.length - k + 1)


@dataclass
class Index:
    """Prefix tokens of a block of windows: for each size of shingle the sorted tokens and their (group, window, place)."""

    groups: list[Group]
    tokens: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def _group(rows: list[tuple[str, str]]) -> list[Group]:
    by_text: dict[bytes, list[str]] = {}
    for window, item in rows:
        by_text.setdefault(window.encode("utf-8", "surrogatepass"), []).append(item)
    by_length: dict[int, list[bytes]] = {}
    for text in by_text:
        by_length.setdefault(text.count(b" ") + 1, []).append(text)
    groups = []
    for length, texts in sorted(by_length.items()):
        data = np.frombuffer(b"".join(texts), np.uint8)
        h = K.words(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), "alnum", lower=True)[0]
        groups.append(Group(length, h.reshape(len(texts), length), texts, [sorted(by_text[t]) for t in texts]))
    return groups


def shingle_counts(docs: DataFrame, groups: list[Group]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """How often the windows' shingles occur in all documents: size of shingle -> (sorted tokens, counts)."""
    sizes = sorted({min(SHINGLE, g.length) for g in groups})
    tokens = {k: np.unique(np.concatenate([g.shingles.ravel() for g in groups if min(SHINGLE, g.length) == k])) for k in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch):
                hashes, _, _, bounds = K.words(data, offsets, "alnum", lower=True)
                for k, known in tokens.items():
                    h = K.runs(hashes, bounds, k)[0]
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    sums[k] += np.bincount(at[known[at] == h], minlength=len(known))
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    # no more rows than the block has shingles
    got = (docs.select("text").where(F.col("text").isNotNull()).mapInArrow(run, "k int, at long, n long")
           .groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow())
    k_of, at, n = (got.column(c).to_numpy() for c in ("k", "at", "n"))
    counts = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
    for k in sizes:
        counts[k][at[k_of == k]] = n[k_of == k]
    return {k: (tokens[k], counts[k]) for k in sizes}


def build_index(docs: DataFrame, rows: list[tuple[str, str]], containment: float) -> Index:
    """Index on the rarest shingles that a match cannot all lack."""
    groups = _group(rows)
    counts = shingle_counts(docs, groups)
    entries: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for g, group in enumerate(groups):
        k = min(SHINGLE, group.length)
        known, n = counts[k]
        rarity = n[np.searchsorted(known, group.shingles)]
        order = np.lexsort((group.shingles, rarity), axis=1)
        m = group.shingles.shape[1]
        prefix = order[:, :m - ceil(containment * m - 1e-9) + 1]
        window = np.repeat(np.arange(len(prefix)), prefix.shape[1])
        place = prefix.ravel()
        entries.setdefault(k, []).append((group.shingles[window, place],
                                          np.stack([np.full(len(window), g), window, place], axis=1)))
    index = Index(groups)
    for k, parts in entries.items():
        token, where = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(token, kind="stable")
        index.tokens[k] = token[order], where[order]
    return index


def find(index: Index, containment: float, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Per text of a block: number of words, hit word ranges, ids of the items with a hit."""
    n = len(offsets) - 1
    hashes, starts, ends, bounds = K.words(data, offsets, "alnum", lower=True)
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    items: list[set] = [set() for _ in range(n)]
    for k, (tokens, where) in index.tokens.items():
        h, first = K.runs(hashes, bounds, k)
        lo = np.searchsorted(tokens, h)
        some = np.flatnonzero((lo < len(tokens)) & (tokens[np.minimum(lo, len(tokens) - 1)] == h))
        if not len(some):
            continue
        lo, first = lo[some], first[some]
        times = np.searchsorted(tokens, h[some], side="right") - lo
        entry = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
        at, row = np.repeat(first, times), np.repeat(K.row_of(first, bounds), times)
        g, window, place = where[entry].T
        at = at - place
        for number, group in enumerate(index.groups):
            fits = np.flatnonzero((g == number) & (at >= bounds[row]) & (at + group.length <= bounds[row + 1]))
            for a in range(0, len(fits), 50_000):
                c = fits[a:a + 50_000]
                got = hashes[at[c][:, None] + np.arange(group.length)]
                if containment >= 1.0:
                    c = c[(got == group.words[window[c]]).all(axis=1)]
                else:
                    size = min(SHINGLE, group.length)
                    same = K.runs(got.ravel(), np.arange(0, got.size + 1, group.length), size)[0].reshape(len(c), -1) == group.shingles[window[c]]
                    c = c[same.sum(axis=1) >= containment * same.shape[1] - 1e-9]
                for w, p, r in sorted(set(zip(window[c].tolist(), at[c].tolist(), row[c].tolist(), strict=True))):
                    if containment >= 1.0 and b" ".join(
                            data[s:e].tobytes() for s, e in zip(starts[p:p + group.length], ends[p:p + group.length], strict=True)
                    ).translate(_LOWER) != group.texts[w]:
                        continue
                    cover[p] += 1
                    cover[p + group.length] -= 1
                    items[r].update(group.items[w])
    hit = np.cumsum(cover[:-1]) > 0
    # ends of hit runs; a row's end closes a run
    edge = np.zeros(len(hit) + 1, dtype=bool)
    edge[bounds] = True
    opens = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]]))) if len(hit) else np.zeros(0, int)
    closes = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1 if len(hit) else np.zeros(0, int)
    spans: list[list] = [[] for _ in range(n)]
    for o, c, r in zip(opens.tolist(), closes.tolist(), K.row_of(opens, bounds).tolist(), strict=True):
        spans[r].append((o - int(bounds[r]), c - int(bounds[r])))
    return np.diff(bounds), spans, [sorted(i) for i in items]


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def window_blocks(benchmark: DataFrame, width: int, most: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The windows, at most about ``most`` at once, and whether they are the last."""
    windows = cut_lineage(item_windows(benchmark, width))
    n = windows.count()
    if not n:
        return
    blocks = -(-n // most)
    at = F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks))
    for b in range(blocks):
        yield [(r.window, r.item_id) for r in windows.where(at == b).collect()], b == blocks - 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = 1.0,
                  windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """Per document: number of words, hit word ranges and the items found, sorted as strings."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("n_words"),
                       F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"),
                       F.expr("cast(array() as array<string>)").alias("items"))
    found = None
    for block, last in window_blocks(benchmark, width, windows_per_block):
        rows = cut_lineage(found) if found is not None else rows
        found = rows.mapInArrow(_search(build_index(docs, block, containment), containment, not last),
                                HITS if last else f"{HITS}, text string")
    return rows.mapInArrow(_search(Index([]), containment, False), HITS) if found is None else found


def _search(index: Index, containment: float, more: bool):
    """Adds the index's hits to the rows; keeps the text where more are to be looked for."""
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before_spans, before_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            for a, b, data, offsets in K.blocks(batch):
                n_words, spans, items = find(index, containment, data, offsets)
                for i in range(b - a):
                    if before_spans[a + i]:
                        spans[i] = _merge([(s["start"], s["end"]) for s in before_spans[a + i]], spans[i])
                        items[i] = sorted({*before_items[a + i], *items[i]})
                columns = {"doc_id": batch.column("doc_id")[a:b], "n_words": pa.array(n_words),
                           "spans": pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], pa.list_(pair)),
                           "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns | ({"text": batch.column("text")[a:b]} if more else {}))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = 1.0,
                      windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """The rows of ``docs`` without a hit, columns unchanged."""
    schema = docs.schema

    def keep(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, data, offsets in K.blocks(batch):
                    spans = find(index, containment, data, offsets)[1]
                    yield batch.slice(a, b - a).filter(pa.array([not s for s in spans], pa.bool_()))
        return run

    for block, _ in window_blocks(benchmark, width, windows_per_block):
        index = build_index(docs, block, containment)
        docs = docs.mapInArrow(keep(index), schema)
    return docs

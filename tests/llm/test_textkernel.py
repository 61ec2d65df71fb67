import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lendspark.llm import textkernel as K

PATTERNS = {"space": r"[^\x20\x09-\x0D]+", "alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "line": r"[^\n]+"}


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té1-|", max_size=30)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for kind, pattern in PATTERNS.items():
        seen, hashes = [], {}
        for lo, hi, data, offsets in K.blocks(batch, limit=20):
            h, starts, ends, bounds = K.words(data, offsets, kind, lower=True)
            for r in range(hi - lo):
                mine = [lower(data[starts[i]:ends[i]].tobytes().decode()) for i in range(bounds[r], bounds[r + 1])]
                seen.append(mine)
                for w, x in zip(mine, h[bounds[r]:bounds[r + 1]], strict=True):
                    assert hashes.setdefault(w, x) == x
        assert seen == [re.findall(pattern, lower(t or "")) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_hashes_do_not_depend_on_pieces(monkeypatch):
    data = np.frombuffer(("ab cde f " * 400).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    whole = K.words(data, offsets)[0]
    monkeypatch.setattr(K, "PIECE", 37)
    assert np.array_equal(whole, K.words(data, offsets)[0])


def test_runs_stay_in_their_row():
    h = np.arange(10, dtype=np.uint64)
    _, first = K.runs(h, np.array([0, 4, 4, 10]), 3)
    assert first.tolist() == [0, 1, 4, 5, 6, 7]


def test_distinct_in_rows():
    h = np.array([3, 1, 3, 2, 2], dtype=np.uint64)
    got, bounds = K.distinct_in_rows(h, np.array([0, 0, 0, 2, 2]), 3)
    assert got.tolist() == [1, 3, 2] and bounds.tolist() == [0, 2, 2, 3]

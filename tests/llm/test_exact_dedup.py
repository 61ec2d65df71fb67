import hashlib

import numpy as np
import pytest
from conftest_llm import ODD, words

from lendspark.llm import exact_dedup


def normal(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def brute(rows):
    """Sorted (doc_id, keep_id, group_size, kept, digest) of all rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for t, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), n == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    return sorted(out, key=repr)


COPIES = [*[(i, words(i % 40, 12)) for i in range(120)], *[(200 + i, words(7, 12).upper()) for i in range(90)], (1, "É É"), (2, "é é"), (3, "a  b"), (4, "a b"),
          (None, words(3, 12)), (None, words(888, 9)), (None, words(888, 9)), (-5, words(9, 12)), *ODD]


@pytest.mark.parametrize("shard", [1024, 4])
def test_groups_are_those_of_equal_texts(make_docs, monkeypatch, shard):
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", shard)
    got = exact_dedup.dedup(make_docs(COPIES, extra=True)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(COPIES)


def test_empty_tables(make_docs):
    none = make_docs([(1, "x")]).where("false")
    assert exact_dedup.dedup(none).count() == 0 and exact_dedup.keep_one(none).count() == 0
    docs = make_docs([(1, "x"), (2, "X")])
    assert [r.doc_id for r in exact_dedup.keep_one(docs, none).collect()] == [2]
    assert exact_dedup.keep_one(none, docs).count() == 0


def test_keep_one_row_of_each_text(make_docs):
    docs = make_docs(COPIES, extra=True)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in brute(COPIES) if r[3]), key=repr)


def test_texts_that_the_history_has_go(make_docs):
    history = [(i, words(i, 10)) for i in range(30)]
    new = [(100 + i, words(i, 10).upper()) for i in range(20, 40)] + [(200, words(35, 10)), (201, words(50, 10))]
    kept = exact_dedup.keep_one(make_docs(new), make_docs(history)).collect()
    assert sorted(r.doc_id for r in kept) == [130, 131, 132, 133, 134, 136, 137, 138, 139, 200, 201]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_hash_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    sizes, filled, slot = exact_dedup.build_levels(keys)
    assert sorted(slot.tolist()) == list(range(n)) and filled.sum() == n
    assert (exact_dedup.look_up(sizes, filled, keys) == slot).all()
    other = exact_dedup.look_up(sizes, filled, keys + np.uint64(1))
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_a_digest_that_shares_a_slot_is_no_member(make_docs):
    """With one slot every other digest that has a bit meets it, and only the bytes tell them apart."""
    history, new = make_docs([(1, "one")]), make_docs([(i, f"text {i}") for i in range(2, 60)] + [(60, "ONE")])
    found = exact_dedup.dedup_prints(exact_dedup.fingerprints(history), exact_dedup.fingerprints(new)).collect()
    assert [(r.keep_id, r.group_size) for r in found if r.member] == [(60, 2)]
    assert len(found) == 59

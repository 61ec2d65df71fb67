import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, words

from lendspark.llm import gbt, language_id, quality_fm, quality_rules

A, B = "ka lo mi ru te sa no", "zhi qua wex ygg orn"


def fold(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def corpus(make_docs):
    rows = [(i, words(i, 40, A if i % 2 else B), "aa" if i % 2 else "bb") for i in range(120)]
    rows += [(200 + i, words(i, 40, A), None) for i in range(5)]
    return rows, make_docs([*rows, *((i, t, "aa") for i, t in ODD)], extra=True)


def test_language_id(corpus):
    rows, docs = corpus
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.train(docs)).collect()}
    right = [got[i].lang_pred == lang for i, _, lang in rows if lang and got[i].held_out]
    assert len(right) > 20 and np.mean(right) >= 0.95
    assert all(r.held_out == (fold(i, 3) == 1) for i, r in got.items() if i is not None)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (9001, 9002, 9003))


def test_a_rare_language_keeps_its_sample(make_docs):
    """Frequent languages take nothing from the bound of a rare one."""
    n = {**{f"l{k}": 600 for k in range(6)}, "rare": 75}
    rows = [(i, f"text {i}", lang) for i, lang in enumerate(k for k, c in n.items() for _ in range(c))]
    got = Counter(r.lang for r in language_id.sampled(make_docs(rows), n, 50).collect())
    assert got["rare"] >= 48 and max(got.values()) == 50


def test_language_id_without_rows(make_docs, spark):
    empty = make_docs([(1, "text", None)]).where("false")
    assert language_id.predict(empty, language_id.train(empty)).count() == 0
    docs = make_docs([(1, "some text", None), (2, "more text", None)])
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs)).collect()} == {"und"}


def test_profile_in_pieces(monkeypatch):
    text = "Ab, cd  ef ß1 " * 500
    whole = language_id.profile(text)
    monkeypatch.setattr(language_id, "PIECE", 61)
    parts = language_id.profile(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_temperature_of_overconfident_logits():
    r = np.random.default_rng(1)
    z = r.normal(0, 1, (4000, 3))
    y = np.array([r.choice(3, p=p) for p in language_id.softmax(z)])
    assert abs(language_id.fit_temperature(5 * z, y) - 5) < 0.6


def junk(i):
    r = random.Random(i)
    return " ".join(w + r.choice(["###", "***", "%%%"]) for w in words(i, 40, A).split())


@pytest.fixture(scope="module")
def graded(spark, make_docs):
    rows = [(i, junk(i) if i % 3 == 0 else words(i, 40, A)) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)] + [(1, None, 0), (None, 1, 0), (5, 7, 0), (4, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    return rows, make_docs([*rows, *ODD], extra=True), labels


@pytest.mark.parametrize("n", [0, 1])
def test_quality_fm(graded, n):
    rows, docs, labels = graded
    got = quality_fm.score(docs, quality_fm.train(docs, labels, 10_000 if n else 150)).collect()
    assert len(got) == len(rows) + len(ODD)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].predicted == int(i % 3 != 0) for i, _ in rows if by[i].held_out]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_fm_identity():
    """The linear-time score equals the sum over all pairs."""
    r = np.random.default_rng(2)
    m = quality_fm.Machine(None, 0.3, r.normal(size=quality_fm.SIZE), r.normal(size=(quality_fm.SIZE, quality_fm.RANK)))
    f, x, bounds = np.array([5, 9, 70, 3, 8]), r.normal(size=5), np.array([0, 3, 5])
    for row, (a, b) in enumerate(((0, 3), (3, 5))):
        want = m.bias + sum(m.linear[f[i]] * x[i] for i in range(a, b)) + sum(
            m.factors[f[i]] @ m.factors[f[j]] * x[i] * x[j] for i in range(a, b) for j in range(i + 1, b))
        assert np.isclose(quality_fm.margins(m, f, x, bounds)[row], want)


def test_without_labels(graded):
    _, docs, labels = graded
    none = labels.where("false")
    assert {r.score for r in quality_fm.score(docs, quality_fm.train(docs, none)).collect()} == {0.5}
    assert all(r.score is None and r.kept == (not r.base_failed)
               for r in quality_rules.judge(docs, quality_rules.train(docs, none)).collect())


def brute(text):
    import re
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    from collections import Counter
    often = Counter(runs)
    hit = {i + j for i, r in enumerate(runs) if often[r] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_quality_rules(graded, make_docs, spark):
    rows, docs, labels = graded
    more = [(9100, "a b c d e f g h i\n" * 4), (9101, "x" * 10 + "\n \n" + "x" * 10 + "\n\n"), (9102, words(3, 25) + "\n" + words(3, 25))]
    docs = docs.unionByName(make_docs(more), allowMissingColumns=True)
    model = quality_rules.train(docs, labels)
    texts = {**dict(rows), **dict(ODD), **dict(more)}
    got = quality_rules.judge(docs, model).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)
    by = {r.doc_id: r.kept for r in got}
    held = [i for i, _ in rows if fold(i, 3) == 1]
    assert np.mean([by[i] == (i % 3 != 0) for i in held]) >= 0.95
    kept = quality_rules.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.judge(docs.where("false"), model).count() == 0


def test_trees_are_monotone_and_flat_scoring_walks_them():
    r = np.random.default_rng(3)
    x = r.uniform(0, 1, (3000, 3))
    y = (x[:, 0] + 0.4 * np.sin(9 * x[:, 1]) + r.normal(0, 0.3, 3000) < 0.6).astype(float)
    f = gbt.fit(x, y, {0: -1}, rounds=30)
    grid = np.repeat(r.uniform(0, 1, (50, 3)), 40, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(f.margin(grid).reshape(50, 40), axis=1) <= 1e-12).all()
    assert ((f.probability(x) >= 0.5) == (y == 1)).mean() > 0.75

    def walk(row):
        total = f.base
        for node in f.root:
            while f.feature[node] >= 0:
                node = f.left[node] if row[f.feature[node]] <= f.cut[node] else f.right[node]
            total += f.value[node]
        return total
    assert np.allclose(f.margin(x[:50]), [walk(row) for row in x[:50]])

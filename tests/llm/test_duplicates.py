import random
import re
from collections import Counter

import pytest
from conftest_llm import ODD, words

from lendspark.llm import minhash, passage_dedup, unit_dedup
from lendspark.llm.components import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(sets, percent=80):
    """Smallest id of each document's component, by comparing all pairs."""
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {i: root(i) for i in ids}


@pytest.fixture(scope="module")
def copies():
    r = random.Random(4)
    rows = [(i, words(i, r.randint(3, 90))) for i in range(40)]
    n = 100
    for i in range(0, 30):
        w = rows[i][1].split()
        for rate in (0.0, 0.01, 0.02, 0.04):
            rows.append((n, " ".join(x if r.random() >= rate else f"q{r.randrange(10**6)}" for x in w).upper()))
            n += 1
    # a chain: each is near the next, the ends are not near each other
    chain = words(77, 60).split()
    for j in range(12):
        rows.append((500 + j, " ".join(chain[j:j + 45])))
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_components_are_those_of_all_pairs(make_docs, copies, k):
    rows = [*copies, *ODD]
    got = minhash.near_duplicates(make_docs(rows, extra=True), k, 80).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    want = groups(sets)
    assert len(set(want.values())) < len(want) - 60
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_an_id_with_two_texts_is_one_document(make_docs):
    a, b = words(1, 50), words(2, 50)
    got = minhash.near_duplicates(make_docs([(1, a), (2, a), (2, b), (3, b), (4, words(3, 50))])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_a_centre_with_two_texts_is_compared_by_each(spark):
    a, b = words(1, 50), words(2, 50)
    pairs = spark.createDataFrame([(1, 2), (3, 2), (4, 2)], "a long, b long")
    texts = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, words(3, 50))], "rep long, text string")
    assert {(r.a, r.b) for r in minhash.similar(pairs, texts, 5, 80).collect()} == {(1, 2), (3, 2)}


def test_keep_one(make_docs, copies):
    docs = make_docs([*copies, *ODD], extra=True)
    kept = minhash.keep_one(docs, 4, 80)
    assert kept.columns == docs.columns
    want = groups({i: shingles(t, 4) for i, t in [*copies, *ODD] if i is not None})
    assert Counter(r.doc_id for r in kept.collect()) == Counter([*set(want.values()), None])
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


def brute_units(rows, unit, least):
    seen, out = set(), {}
    for i, t in sorted(((i, t or "") for i, t in set(rows)), key=lambda x: (x[0] is None, x[0] or 0)):
        lines = t.split("\n")
        blocks, at = [], 0
        while at < len(lines):
            end = at + 1
            while unit == "paragraph" and shingles(lines[at], 1) and end < len(lines) and shingles(lines[end], 1):
                end += 1
            blocks.append((at, end))
            at = end
        kept, removed, pos = [], [], 0
        for a, b in blocks:
            part = "\n".join(lines[a:b])
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(part)))
            if len(w) >= least and w in seen:
                removed.append((pos, pos + len(part)))
            else:
                kept += lines[a:b]
            if len(w) >= least:
                seen.add(w)
            pos += len(part) + 1
        out[i] = ("\n".join(kept), removed)
    return out


@pytest.mark.parametrize("unit", ["line", "paragraph"])
def test_repeated_units(make_docs, unit):
    common, rare = words(1, 60), words(2, 20)
    rows = [(1, f"{common}\n{rare}\n\nshort line"), (2, f"short line\n  {common.upper()} \n\n\n{words(3, 30)}"),
            (3, f"{rare}\n\n{rare}\nend"), (4, f"é{words(4, 15)}\n{common}\n\n{common}"), (5, common), *ODD, (9005, "another text")]
    docs = make_docs(rows, extra=True)
    got = unit_dedup.dedup_units(docs, unit).collect()
    assert len(got) == len(rows)
    want = brute_units([r for r in rows if r != (9005, "another text")], unit, unit_dedup.MIN_WORDS)
    for r in got:
        if (r.doc_id, r.text) == (9005, "another text"):
            continue
        assert (r.text or "", [(s.start, s.end) for s in r["__removed"]]) == want[r.doc_id]
    kept = unit_dedup.keep_first_units(docs, unit)
    assert kept.columns == docs.columns
    rows_kept = kept.collect()
    assert 5 not in {r.doc_id for r in rows_kept}          # nothing of it was left
    assert {9001, 9002, 9003, None} <= {r.doc_id for r in rows_kept}
    assert all(r.n_chars == len(r.text) for r in rows_kept if r.doc_id in (2, 3, 4))
    assert unit_dedup.dedup_units(docs.where("false"), unit).count() == 0


def brute_sentences(rows, least):
    seen, out = set(), {}
    for i, t in sorted(((i, t or "") for i, t in set(rows)), key=lambda x: (x[0] is None, x[0] or 0)):
        parts = [p for line in re.split("(\n)", t) for p in ([line] if line == "\n" else re.split(r"(?<=[.!?])(?=[\x20\x09-\x0D])", line))]
        units, pos = [], 0
        for p in parts:
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", lower(p)))
            if w:
                units.append((pos, pos + len(p), w, w in seen))
                seen.add(w)
            pos += len(p)
        removed, k = [], 0
        while k < len(units):
            e = k
            while e < len(units) and units[e][3]:
                e += 1
            if e > k and sum(len(u[2]) for u in units[k:e]) >= least:
                removed.append((units[k][0], units[e - 1][1]))
            k = max(e, k + 1)
        text, at = "", 0
        for a, b in removed:
            text, at = text + t[at:a], b
        out[i] = (text + t[at:], removed)
    return out


def test_repeated_sentences_go_in_runs(make_docs):
    """A passage of sentences planted inside lines goes from all documents but the first; a short sentence by itself stays."""
    r = random.Random(9)
    prose = [". ".join(words(600 + 10 * i + j, r.randint(3, 14)) for j in range(8)) for i in range(14)]
    passage = f"{words(901, 7)}. {words(902, 9).upper()}! É{words(903, 12)}?\n{words(904, 8)}. {words(905, 20)}."
    short = f"{words(906, 6)}."
    rows = [(i, f"{p[:60]} {passage} {p[60:]}" if i % 3 == 0 else f"{p}. {short}  {short} {p[::-1]}") for i, p in enumerate(prose)]
    rows += [(50, passage), (51, lower(passage).replace("\n", "\n\n \n")), (52, f"{words(905, 20)}. {words(904, 8)}."), (53, "a.b.c . d! ! !? e"),
             (54, f"x. {words(905, 20)}."), *ODD, (9005, "another text")]
    docs = make_docs(rows, extra=True)
    got = unit_dedup.dedup_units(docs, "sentence").collect()
    assert len(got) == len(rows)
    want = brute_sentences([x for x in rows if x != (9005, "another text")], unit_dedup.RUN_WORDS)
    for g in got:
        if (g.doc_id, g.text) != (9005, "another text"):
            assert ((g.text or ""), [(s.start, s.end) for s in g["__removed"]]) == want[g.doc_id]
    assert [i for i in range(14) if want[i][1]] == [3, 6, 9, 12]
    kept = unit_dedup.keep_first_units(docs, "sentence")
    assert kept.columns == docs.columns and 51 not in {g.doc_id for g in kept.collect()}
    assert unit_dedup.dedup_units(docs.where("false"), "sentence").count() == 0


def brute_passages(rows, size):
    seen, out = {}, {}
    for i, t in sorted(((i, t or "") for i, t in set(rows)), key=lambda x: (x[0] is None, x[0] or 0)):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+[ \t]*", t)]
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", lower(t)), set()
        for p in range(len(w) - size + 1):
            j, q = seen.setdefault(tuple(w[p:p + size]), (i, p))
            if (j, q) != (i, p):
                gone |= set(range(max(p, q + size) if j == i else p, p + size))
        left, at = [], 0
        for n, (start, end) in enumerate(spans):        # what stands between two words that go goes with them
            left.append("" if {n - 1, n} <= gone else t[at:start])
            left.append("" if n in gone else t[start:end])
            at = end
        out[i] = ("".join(left) + t[at:], sum(n - 1 not in gone for n in gone))
    return out


def test_passages_inside_lines(make_docs):
    """A passage planted within longer lines goes, exactly, from all documents but the first."""
    a, b = words(801, 60), words(802, 50)
    x = [words(810 + i, 40) for i in range(12)]
    rows = [(1, f"{x[0]} {a} {x[1]}"), (2, f"{x[2]} {a.upper()}\t {x[3]}"), (3, f"{x[4]} {a[:200]}"), (4, f"{b} é{x[5]} {b}\n{x[6]}"),
            (5, f"{x[7]}\n{a} {b}"), (6, a.replace(" ", "\n")), (7, "x " * 200 + b), (8, f"{x[8]} {' '.join(b.split()[:49])} {x[9]}"), *ODD,
            (9005, "another text")]
    docs = make_docs(rows, extra=True)
    got = passage_dedup.dedup_passages(docs).collect()
    assert len(got) == len(rows)
    want = brute_passages([r for r in rows if r != (9005, "another text")], 50)
    for r in got:
        if (r.doc_id, r.text) != (9005, "another text"):
            assert ((r.text or ""), len(r["__removed"])) == want[r.doc_id]
    texts = {r.doc_id: r.text for r in got}
    assert texts[2] == f"{x[2]} {x[3]}" and texts[5] == f"{x[7]}\n" and b.split()[48] in texts[8]
    kept = passage_dedup.keep_first_passages(docs)
    assert kept.columns == docs.columns and 6 not in {r.doc_id for r in kept.collect()}
    assert passage_dedup.dedup_passages(docs.where("false")).count() == 0

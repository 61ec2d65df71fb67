import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, words

from lendspark.llm import collocations


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def brute(rows, top=2000, least=30):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3, 4):
                f.update((lang, *w[i:i + m]) for i in range(len(w) - m + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    inner = Counter()
    for p, a in found.items():
        for b in range(1, len(p)):
            for e in range(b + 2, len(p) + 1):
                if e - b < len(p) - 1:
                    q = (p[0], *p[b:e])
                    inner[q] = max(inner[q], a)
    out = []
    for p, a in found.items():
        if 100 * inner[p] >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[p[:k]] + f[(p[0], *p[k:])]), k, f[p[:k]], f[(p[0], *p[k:])]) for k in range(2, len(p)))
        out.append((p[0], -score, -a, " ".join(p[1:]).encode(), left, right))
    rank, result = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            result.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return result


@pytest.fixture(scope="module")
def prose():
    r = random.Random(3)
    vocabulary = {lang: words(40 + k, 60).split() for k, lang in enumerate(("en", "fr", None))}
    rows = []
    for i in range(150):
        lang = r.choice(["en", "en", "fr", None])
        v = vocabulary[lang]
        text = []
        for _ in range(r.randint(1, 60)):
            s = [v[min(59, int(r.expovariate(0.15)))] for _ in range(r.randint(1, 9))]
            if r.random() < 0.3:
                s[1:1] = v[50:54]
            if r.random() < 0.2:
                s += [v[7].upper(), "Ünïq", v[8]]
            text.append("\t ".join([" ".join(s[:2]), " ".join(s[2:])]) + r.choice([".", ", ", "!?", "\n", "; ", "\r\n", " "]))
        rows.append((i, "".join(text), lang))
    rows += [(500 + i, "na na na na na na", "en") for i in range(20)] + [(7, "same words here again", "de")] * 40
    return rows + [(*o, "en") for o in ODD]


@pytest.mark.parametrize(("block", "top"), [(1 << 20, 2000), (40, 2000), (1 << 20, 5)])
def test_all_phrases(make_docs, prose, monkeypatch, block, top):
    """A small block sends rare words the other way and takes pairs and triples in several passes."""
    monkeypatch.setattr(collocations, "BLOCK", block)
    want = brute(prose, top)
    assert len({r[0] for r in want}) == 4 and (top == 5 or len(want) > 100)
    got = collocations.mine(make_docs(prose, extra=True), top=top)
    assert got.columns == collocations.RESULT
    assert sorted(tuple(r) for r in got.collect()) == want


def test_no_phrases(make_docs):
    assert collocations.mine(make_docs([(1, "a b")]).where("false")).count() == 0
    assert collocations.mine(make_docs([(1, None), (2, ""), (3, " .\n"), (4, "one two")])).count() == 0


@pytest.mark.parametrize("share", [64, 1 << 30])
def test_tiles(monkeypatch, share):
    """Dense tiles and sorted coordinates count alike."""
    monkeypatch.setattr(collocations, "DENSE_SHARE", share)
    r = np.random.default_rng(1)
    left, right = (np.minimum(r.zipf(1.3, 60_000), 5000).astype(np.int64) - 1 for _ in range(2))
    x, y, f = collocations.count_cells(left, right)
    assert dict(zip(zip(x.tolist(), y.tolist()), f.tolist())) == Counter(zip(left.tolist(), right.tolist()))
    assert len(x) == len(set(zip(x.tolist(), y.tolist())))
    assert collocations.count_cells(left[:0], right[:0])[0].size == 0

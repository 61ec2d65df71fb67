import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, words

from lendspark.llm import decontaminate, html_text, license_scan, packing


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- decontamination

def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


ITEMS = [(1, words(50, 25)), (2, words(51, 10)), (3, "Only four words here"), (4, None), (5, ""), (6, "..."), (1, words(50, 25)),
         (7, words(50, 25)), (None, words(52, 12))]


def test_hits_are_those_of_all_windows(make_docs, spark):
    a, b = words(50, 25).split(), words(51, 10).split()
    rows = [(1, words(1, 50)), (2, words(2, 8) + " " + ", ".join(a[3:18]).upper() + " " + words(3, 5)), (3, " ".join(a[:9])),
            (4, "x only-FOUR words, here. y only four words"), (5, " ".join(b) + " " + " ".join(b)),
            (6, " ".join(a[:12]) + " z " + " ".join(a[10:])), (7, words(52, 12)), (8, " ".join(a[:14][::-1])), *ODD]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs(rows, extra=True)
    want = {}
    for i, t in rows:
        w, hit, items = item_words(t), set(), set()
        for item, text in ITEMS:
            v = item_words(text)
            n = min(10, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit |= set(range(p, p + n))
                        items.add(str(item) if item is not None else "null")
        want[i] = (len(w), sorted(hit), sorted(items))
    assert sum(1 for v in want.values() if v[1]) == 5
    for block in (200_000, 7):
        got = decontaminate.decontaminate(docs, bench, windows_per_block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_words, [p for s in r.spans for p in range(s.start, s.end)], r["items"]) == want[r.doc_id]
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in rows if not want[i][1])


def test_containment_below_one(make_docs, spark):
    """A window with one word changed keeps 5 of its 8 three-word shingles at least."""
    a = words(50, 10).split()
    docs = make_docs([(1, " ".join(["q", *a[:5], "changed", *a[6:], "r"])), (2, " ".join(a[:4])), (3, words(9, 30))])
    bench = spark.createDataFrame([(1, " ".join(a))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench, containment=0.6).collect() if r.spans} == {1}
    assert not [r for r in decontaminate.decontaminate(docs, bench).collect() if r.spans]


def test_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "some words")])
    assert [(r.n_words, r.spans, r["items"]) for r in decontaminate.decontaminate(docs, none).collect()] == [(2, [], [])]
    assert decontaminate.drop_contaminated(docs, none).count() == 1
    assert decontaminate.decontaminate(docs.where("false"), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# --- packing

def test_packing_round_trip(make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    rows = [(i, words(i, 30 * i + 1).replace(" ka", ".\nka") + ("  tail\t" if i % 4 == 0 else "")) for i in range(60)] + ODD
    got = packing.pack(make_docs(rows, extra=True)).collect()
    pieces = {}
    for r in got:
        assert len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for j, _ in rows if j == i)
        mine = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.length for r in mine) == copies * len(ids)
        for r in mine:
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[r.start:r.start + r.length]
            assert r.piece == 0 or r.length == 2048
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == np.cumsum([0, *(n for _, n in b)])[:-1].tolist() and sum(b[-1]) <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(bins) <= least + 2
    assert packing.pack(make_docs(rows).where("false")).count() == 0


def test_added_tokens_inside_a_text():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(packing.VOCABULARY)
    tok = Tokenizer.from_file(path)
    added = packing.added_tokens(path)
    assert added
    for t in added:
        for text in (t, f"a {t} b", f"  {t}{t}\n{t[:-1]} {t.upper()} x"):
            ids = tok.encode(text, add_special_tokens=False).ids
            assert added[t] in ids and np.frombuffer(packing.Encoder().encode([text])[0], "<u4").tolist() == ids


def test_added_tokens_without_byte_ranks(monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path(packing.VOCABULARY)
    fast = packing.Encoder(path).encode(["a <|endoftext|> b"])
    monkeypatch.setattr(packing, "byte_ranks", lambda path: None)
    assert packing.Encoder(path).encode(["a <|endoftext|> b"]) == fast


def test_each_place_has_the_smallest_sum_of_squares():
    r = np.random.default_rng(5)
    sizes = r.integers(1, 65, 300)
    bins, offset, used = packing.place(sizes, 64)
    gaps = Counter()
    fill = [0] * used
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if s == 64:
            continue
        options = []
        for g in gaps:
            if gaps[g] and g >= s:
                after = gaps.copy()
                after[g] -= 1
                if g > s:
                    after[g - s] += 1
                options.append((sum(v * v for v in after.values()), g))
        gap = 64 - int(offset[i])
        if options:
            assert (min(options)[0], gap) in options
            gaps[gap] -= 1
        else:
            assert gap == 64
        if gap > s:
            gaps[gap - s] += 1
        fill[bins[i]] += s
    assert max(fill) <= 64


@pytest.mark.parametrize("parts", [1, 16, 64])
def test_packing_does_not_depend_on_the_layout(spark, parts):
    """Part-filled sequences of all tasks are packed again: at most 1 % over the least number possible."""
    r = random.Random(3)
    rows = [(i, words(i, int(min(4000, 40 * 2 ** r.expovariate(0.5))))) for i in range(900)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).select("doc_id", "length", "sequence_id", "offset").collect()
    least = -(-sum(g.length for g in got) // 2048)
    assert least > 100 and len({g.sequence_id for g in got}) <= 1.01 * least + 1
    fill = Counter()
    for g in sorted(got, key=lambda g: (g.sequence_id, g.offset)):
        assert fill[g.sequence_id] == g.offset
        fill[g.sequence_id] += g.length
    assert max(fill.values()) <= 2048


def test_small_pools(make_docs):
    got = packing.pack(make_docs([(i, words(i, 50)) for i in range(40)]), pool_tokens=1000).collect()
    assert len(got) == 40 and len({(r.sequence_id, r.offset) for r in got}) == 40


# --- HTML

PAGES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<script>var a='<p>no</p>'</script>", ""),
    ("<nav><a>x</a></nav><article><h1>T &amp; t</h1><p><b>one<br><p>two \n  three</p><div class='ad'>buy</div></article><footer>f</footer>",
     "T & t\n\none\n\ntwo three"),
    ("<body><div id='side-bar' class='sidebar'>s</div><div><p>" + "long text " * 30 + "</p><p>short</p></div>"
     "<div class='comments'><p>I liked it</p></div></body>", ("long text " * 30).strip() + "\n\nshort"),
    ("<main><p>a b c</p><form><p>form text</p></form><ul><li>i<li>j</ul></main>", "a b c\n\ni\n\nj"),
    ("<p>unfinished &lt;tag&gt; <a href='", "unfinished <tag>"),
]


def test_pages(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(1, "u1", "")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text) and r.url == f"u{r.page_id}"


@pytest.mark.parametrize("begin, end", [("<div class='layout has-sidebar'>", "</div>"), ("<div class='no-sidebar'>", "</div>"),
                                        ("<div id='cookie-overlay-page'>", "</div>"), ("<form action='/page'>", "</form>"),
                                        ("<form><div class='modal'>", "</div></form>")])
def test_marked_wrappers_of_a_page(begin, end):
    body = "<p>" + "long text " * 30 + "</p><div class='ad'>buy this</div><p>short</p>"
    want = ("long text " * 30).strip() + "\n\nshort"
    assert html_text.extract(f"<body><nav>x</nav>{begin}{body}{end}<div class='comments'><p>I liked it</p></div></body>") == want
    many = "<div class='comments'>" + "<p>I liked it very much</p>" * 40 + "</div>"
    for tag in ("article", "main"):
        assert html_text.extract(f"<body>{begin}<{tag}>{body}</{tag}>{end}{many}</body>") == want
        assert html_text.extract(f"<body>{begin}<{tag}>{body}</{tag}>{many}{end}</body>") == want


LONG = "long text " * 30
BROKEN = [("<![foo]>", ""), ("<![x y]>", ""), ("<![ ]>", ""), ("<![1]>", ""), ("<!DOCTYPE html [<!ENTITY x 'y'>]>", ""), ("<!--[if IE]><p>old</p><![endif]-->", ""),
          ("<![if !IE]>", "<![endif]>"), ("<![CDATA[ a > b ]]>", ""), ("<!ELEMENT br EMPTY>", ""), ("<!>", ""), ("<?php echo 1 ?>", ""), ("</>", ""),
          ("</nope>" * 50, ""), ("<!doctype html public '-//W3C//DTD' 'http://x'>", "")]


@pytest.mark.parametrize("begin, end", BROKEN)
def test_declarations_are_markup(begin, end):
    assert html_text.extract(f"<body>{begin}<div><p>{LONG}</p>{begin}<p>short</p>{end}</div>{end}</body>") == f"{LONG.strip()}\n\nshort"


def test_random_markup_through_spark(spark):
    """No page fails the job, whatever its markup; pages that break off anywhere are read as far as they go."""
    r = random.Random(8)
    parts = ["<![", "<!", "<!--", "-->", "]>", "]]>", "<", ">", "</", "<p>", "</p>", "<div class='ad", "'>", "<a href=", "&amp", "&#x", ";", "text ", "<script>", "<!DOCTYPE [",
             "<table><tr><td>", "\x00", "<?", "é", "<svg>", "<![CDATA[", "[if", "\n"]
    rows = [(i, None, "".join(r.choice(parts) for _ in range(r.randint(1, 40)))) for i in range(1500)]
    rows += [(2000 + i, None, f"<!DOCTYPE html [<!ENTITY x 'y'>]><body><p>{LONG}</p><![x]></body>"[:i]) for i in range(120)]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and all(g.n_chars == len(g.text) for g in got)
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("name", ["class='share-price'", "id='notice-of-motion'", "class='reply-brief'", "class='banner-study related-work'"])
def test_a_mark_within_a_name_leaves_content(name):
    page = f"<body><nav><a>x</a></nav><article><p>{LONG}</p><div {name}><p>{LONG}</p></div><p>{LONG}</p></article></body>"
    assert html_text.extract(page) == "\n\n".join([LONG.strip()] * 3)


def test_deep_nesting_is_read_in_linear_time():
    import time
    took = []
    for n in (3000, 12_000):
        page = "<div>" * n + f"<p>{LONG}</p>" + "</div>" * n + "<span></span></b>" * n
        t = time.process_time()
        assert html_text.extract(page) == LONG.strip()
        took.append(time.process_time() - t)
    assert took[1] < 10 * max(took[0], 0.05)


def test_pieces_do_not_change_a_page(monkeypatch):
    html = "<div>" + "".join(f"<p>par {i} &amp; more</p><!-- c -->" for i in range(50)) + "</div>"
    whole = html_text.extract(html)
    monkeypatch.setattr(html_text, "PIECE", 7)
    assert html_text.extract(html) == whole and whole.count("\n\n") == 49


def test_smoothing_keeps_a_constant():
    assert np.allclose(html_text.smooth(np.full(9, 3.0)), 3.0)


# --- licences

@pytest.fixture(scope="module")
def files(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/LICENSE", mit), (2, "a/x.py", "code"), (3, "a/b/y.py", None), (4, "a/b/LICENSE.txt", apache), (5, "a/b/c/z.py", ""),
            (6, "a/w.py", f"# {apache.upper()}\nfoo"), (7, "q/v.py", "nothing about the license of it, but a long line that speaks of many things"),
            (8, None, "x"), (9, "top.py", mit), (10, "a/LICENSE-2", apache), (2, "a/x.py", "code"), (11, "ab/x.py", "code")]
    return spark.createDataFrame(rows, "key long, path string, text string").selectExpr("*", "'mine' AS license", "1 AS score")


def test_licenses(files):
    got = {(r.key, r.license, r.origin, r.license_path) for r in license_scan.scan(files).collect()}
    assert got == {(1, "MIT", "own", "a/LICENSE"), (2, "MIT", "inherited", "a/LICENSE"), (3, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
                   (4, "Apache-2.0", "own", "a/b/LICENSE.txt"), (5, "Apache-2.0", "inherited", "a/b/LICENSE.txt"),
                   (6, "Apache-2.0", "own", "a/w.py"), (7, None, None, None), (8, None, None, None), (9, "MIT", "own", "top.py"),
                   (10, "Apache-2.0", "own", "a/LICENSE-2"), (11, None, None, None)}
    assert license_scan.scan(files).count() == 12
    assert license_scan.scan(files.where("false")).count() == 0


def test_a_license_at_the_top_is_inherited(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "LICENSE", mit), (2, "src/x.py", "code"), (3, "src/a/y.py", "code"), (4, "lib/LICENSE", apache), (5, "lib/a/z.py", "code"),
            (6, "w.py", "code")]
    got = {(r.key, r.license, r.license_path) for r in license_scan.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert got == {(1, "MIT", "LICENSE"), (2, "MIT", "LICENSE"), (3, "MIT", "LICENSE"), (4, "Apache-2.0", "lib/LICENSE"),
                   (5, "Apache-2.0", "lib/LICENSE"), (6, "MIT", "LICENSE")}


def commented(text, sign):
    return "\n".join(f"{sign} {line}".rstrip() for line in text.split("\n"))


def test_real_wording(spark):
    """Bodies, headers, titles and SPDX lines as files carry them; a BSD file is not taken for a proprietary one."""
    body = dict((n, t) for n, t in license_scan.BODIES)
    code = "import os\n\n\ndef main():\n    return os.name\n"
    holder = "Copyright (c) 2019-2021, Example Corp. and others. All rights reserved."
    own = {n: body[n].replace("Copyright (c) year, holder. All rights reserved.", holder).replace("Copyright (c) year holder.", "Copyright (c) 2020 Jane Doe") for n in body}
    rows = [(f"{n}/LICENSE", own[n], n) for n in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense")]
    rows += [(f"x/{n}.c", "/*\n" + commented(own[n], " *") + "\n */\n" + code, n) for n in ("MIT", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "LGPL-2.1")]
    rows += [(f"x/{n}.py", commented(f"Copyright 2020 Someone\n\n{own[n]}", "#") + "\n\n" + code, n) for n in ("Apache-2.0", "GPL-3.0", "MPL-2.0", "AGPL-3.0")]
    rows += [(f"y/{i}.py", f"# SPDX-License-Identifier: {i}\n{code}", want) for i, want in (
        ("MIT", "MIT"), ("Apache-2.0", "Apache-2.0"), ("BSD-3-Clause", "BSD-3-Clause"), ("BSD-2-Clause", "BSD-2-Clause"), ("GPL-3.0-or-later", "GPL-3.0"),
        ("GPL-2.0-only", "GPL-2.0"), ("ISC", "ISC"), ("LicenseRef-Own", None), ("Foo-2.0", None), ("WTFPL", None))]
    terms = "TERMS AND CONDITIONS\n" + "\n".join(f"{i}. {words(i, 30)}" for i in range(40))
    rows += [("g/COPYING", f"                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone may copy it.\n{terms}", "GPL-3.0"),
             ("a/LICENSE.txt", f"\n                                 Apache License\n                           Version 2.0, January 2004\n"
              f"                        http://www.apache.org/licenses/\n\n{terms}", "Apache-2.0"),
             ("p/LICENSE", "Copyright 2020. All rights reserved.", "Proprietary"), ("q/a.py", code, None), ("g/sub/b.py", code, "GPL-3.0"),
             ("r/c.py", "# This line says nothing of it\n# and this one neither\n" + code, None)]
    table = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "key long, path string, text string").repartition(3)
    got = {r.path: r.license for r in license_scan.scan(table).collect()}
    assert got == {p: want for p, _, want in rows}


def test_licenses_use_no_python(files):
    plan = license_scan.scan(files)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

from collections import Counter

import corpus_pipeline
from conftest_llm import ODD, words
from test_duplicates import groups, shingles

from lendspark.llm import quality_rules
from lendspark.llm.scratch import stage


def test_stages(spark, make_docs, tmp_path):
    passage = words(900, 60)
    bench = words(901, 30)
    rows = [(i, words(i, 60) + "\n" + words(i + 1000, 30)) for i in range(60)]
    rows += [(100 + i, words(i, 60) + "\n" + words(i + 1000, 30)) for i in range(8)]                  # copies
    rows += [(200 + i, words(i + 300, 90) + "\n" + passage) for i in range(5)]                          # a shared passage
    rows += [(300 + i, words(i + 400, 50) + " " + bench + " " + words(i + 500, 20)) for i in range(4)]  # benchmark text
    rows += [(400 + i, " ".join(w + "###" for w in words(i, 60).split())) for i in range(20)]           # junk
    rows += ODD
    docs = make_docs(rows)
    spark.createDataFrame([(i, int(i < 400)) for i, _ in rows if i is not None and i < 420], "doc_id long, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, str(tmp_path)))
        if name != "packing":
            assert out.columns == docs.columns
        seen[name], docs = out.collect(), out
    model = quality_rules.train(make_docs(rows), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = Counter(r.doc_id for r in quality_rules.judge(make_docs(rows), model).collect() if r.kept)
    assert Counter(r.doc_id for r in seen["quality_rules"]) == good
    assert not any(i is not None and 400 <= i < 420 for i in good) and set(range(60)) <= set(good)
    texts = {r.doc_id: r.text for r in seen["quality_rules"] if r.doc_id is not None}
    one = set(groups({i: shingles(t, 5) for i, t in texts.items()}).values())
    assert {r.doc_id for r in seen["near_dedup"] if r.doc_id is not None} == one
    assert len(seen["near_dedup"]) == len(one) + good[None]
    after = {r.doc_id: r.text for r in seen["substring_dedup"]}
    assert sum(passage in t for t in after.values()) == 1 and passage in after[200]
    clean = {r.doc_id for r in seen["decontamination"]}
    assert clean == set(after) - set(range(300, 304))
    assert {r.doc_id for r in seen["packing"]} == clean
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.piece, bytes(r.ids)) for r in whole) == sorted((r.doc_id or -1, r.piece, bytes(r.ids)) for r in seen["packing"])


def test_passages_inside_lines_go(spark, make_docs):
    passage = words(950, 60)
    docs = make_docs([(i, f"{words(i + 700, 90)} {passage} {words(i + 800, 90)}") for i in range(5)])
    left = {r.doc_id: r.text for r in corpus_pipeline.without_repeats(spark, docs, "").collect()}
    assert [i for i in sorted(left) if passage in left[i]] == [0] and all(len(left[i].split()) == 180 for i in range(1, 5))

"""Registered queries of the training-data operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendspark.llm.license_scan import CUE, TEMPLATES
from lendspark.session import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm import language_id as L
    docs = read_table(spark, sf_dir, "documents")
    return L.predict(docs, L.train(docs))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.decontaminate import decontaminate
    found = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.html_text import extract_pages
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` has no paths, so it is laid out as files: source / four hundreds of ids / language / id.

    Documents that end with a line on a licence are licence files; English ones
    stand one directory higher, so other languages have two places to inherit from.
    """
    from lendspark.llm.license_scan import scan
    docs = read_table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("long")
    top = F.concat_ws("/", "source", F.floor(number / 400))
    low = F.concat_ws("/", top, "lang")
    path = (F.when(~F.element_at(F.split("text", "\n"), -1).rlike(CUE) | F.col("text").isNull(),
                   F.concat_ws("/", low, F.concat(number, F.lit(".txt"))))
            .otherwise(F.concat_ws("/", F.when(F.col("lang") == "en", top).otherwise(low), F.concat(F.lit("LICENSE."), number))))
    found = scan(docs.select(F.col("doc_id").cast("long").alias("key"), path.alias("path"), "text"))
    return found.select(F.col("key").alias("doc_id"), "path", "license", F.round("score", 6).alias("score"), "origin", "license_path")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.packing import pack
    return (pack(read_table(spark, sf_dir, "documents"))
            .select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.minhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.unit_dedup import dedup_units
    spans = F.array_join(F.transform("__removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return (dedup_units(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "sentence")
            .select("doc_id", F.size("__removed").cast("long").alias("n_removed"), spans.alias("removed"),
                    F.coalesce("text", F.lit("")).alias("text")))


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.passage_dedup import dedup_passages
    spans = F.array_join(F.transform("__removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return (dedup_passages(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
            .select("doc_id", F.size("__removed").cast("long").alias("n_removed"), spans.alias("removed"),
                    F.coalesce("text", F.lit("")).alias("text")))


def op8_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm import quality_fm as Q
    docs = read_table(spark, sf_dir, "documents")
    return Q.score(docs, Q.train(docs, read_table(spark, sf_dir, "labels")))


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.suffix_tree import score
    return score(read_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm import quality_rules as Q
    docs = read_table(spark, sf_dir, "documents")
    model = Q.train(docs, read_table(spark, sf_dir, "labels"))
    return Q.judge(docs, model)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.exact_dedup import dedup
    return dedup(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seventh vector has a wrong label, each fiftieth is an anchor."""
    from lendspark.llm.hard_negatives import mine
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lendspark.llm.collocations import mine
    return mine(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_text": op3_html_text,
    "op4_license_scan": op4_license_scan,
    "op5_packing": op5_packing,
    "op6_minhash": op6_minhash,
    "op7_unit_dedup": op7_unit_dedup,
    "op7_passage_dedup": op7_passage_dedup,
    "op8_quality_fm": op8_quality_fm,
    "op9_suffix_tree": op9_suffix_tree,
    "op10_quality_rules": op10_quality_rules,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    # every window of an item looked up among all runs of as many words in the documents
    "op2_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) AS sizes WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
       coalesce(p.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op11_exact_dedup": r"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM t""",
    # all pairs of anchors and rows, all windows over all negatives
    "op12_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * r.v[i])) AS BIGINT) AS score
      FROM e AS a JOIN e AS r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3""",
    # all phrases of two to four words of all pieces
    "op13_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM t),
g AS (SELECT lang, m, list_slice(w, i, i + m - 1) AS p
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, array_to_string(p, ' ') AS phrase, any_value(p) AS p, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, m, array_to_string(p, ' ')),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 30),
k AS (SELECT lang, phrase, f AS a, k, array_to_string(p[1:k], ' ') AS x, array_to_string(p[k + 1:], ' ') AS y
      FROM (SELECT lang, phrase, p, f, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, a, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score
      FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = k.x JOIN f AS y ON y.lang = k.lang AND y.phrase = k.y
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY 2000000 * a // (x.f + y.f), k) = 1),
i AS (SELECT lang, array_to_string(p[b:b + z - 1], ' ') AS phrase, max(f) AS longer
      FROM (SELECT lang, p, f, z, unnest(range(1, m - z + 2)) AS b FROM c, (VALUES (2), (3)) AS v(z) WHERE z < m)
      GROUP BY lang, array_to_string(p[b:b + z - 1], ' '))
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank, s.phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE i.longer IS NULL OR 100 * i.longer < 80 * a
QUALIFY row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) <= 2000""",
    # sentences that an earlier place has, in runs of at least 20 words
    "op7_unit_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09-\x0D])', '\1' || chr(57344) || '\2', 'g'), chr(10))) AS line,
                  generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?])([\x20\x09-\x0D])', '\1' || chr(57344) || '\2', 'g'), chr(10)), 1) AS n
           FROM documents),
u AS (SELECT doc_id, n, unnest(string_split(line, chr(57344))) AS unit, generate_subscripts(string_split(line, chr(57344)), 1) AS k FROM l),
p AS (SELECT doc_id, n, k, unit, n - 1 + coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY n, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
             regexp_extract_all(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM u),
w AS (SELECT doc_id, start, start + length(unit) AS stop, words, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i FROM p WHERE len(words) > 0),
d AS (SELECT *, row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, i) > 1 AS again FROM w),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM d WHERE again),
g AS (SELECT doc_id, min(start) AS a, max(stop) AS b FROM r GROUP BY doc_id, run HAVING sum(len(words)) >= 20),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM g),
t AS (SELECT e.doc_id, count(*) AS n, string_agg(CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a) AS removed,
             string_agg(substr(text, CAST(z + 1 AS BIGINT), CAST(a - z AS BIGINT)), '' ORDER BY a) || substr(any_value(text), CAST(max(b) + 1 AS BIGINT)) AS text
      FROM e JOIN documents ON documents.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT documents.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS n_removed, coalesce(t.removed, '') AS removed,
       coalesce(t.text, documents.text, '') AS text
FROM documents LEFT JOIN t ON t.doc_id = documents.doc_id""",
    "op4_license_scan": r"""
WITH t(template, license, statement) AS (VALUES
@TEMPLATES@),
tw AS (SELECT template, license, word, count(*) AS tf
       FROM (SELECT template, license, unnest(regexp_extract_all(lower(statement), '[a-z0-9]+(?:\.[0-9]+)*')) AS word FROM t) GROUP BY template, license, word),
v AS (SELECT DISTINCT word FROM tw),
n AS (SELECT count(text) AS n FROM documents),
d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)*'))) AS word FROM documents WHERE text IS NOT NULL),
df AS (SELECT word, count(*) AS df FROM d JOIN v USING (word) GROUP BY word),
idf AS (SELECT v.word, ln((1.0 + n.n) / (1.0 + coalesce(df.df, 0))) + 1.0 AS idf FROM v LEFT JOIN df ON df.word = v.word, n),
tv AS (SELECT template, license, word, tf * idf AS w FROM tw JOIN idf USING (word)),
tn AS (SELECT template, license, word, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS t FROM tv),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line
      FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_matches(s, '^[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)') AS sign, regexp_matches(s, '@CUE@') AS cue FROM l),
r AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM k WHERE sign),
z AS (SELECT doc_id, run, string_agg(s, chr(10) ORDER BY line) AS s, min(line) AS line FROM r GROUP BY doc_id, run HAVING count(*) > 1 AND bool_or(cue)),
named AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND regexp_matches(string_split(text, chr(10))[-1], '@CUE@')),
unit AS (SELECT doc_id, 0 AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS unit, s FROM k WHERE cue
         UNION ALL SELECT doc_id, 1, row_number() OVER (PARTITION BY doc_id ORDER BY line), s FROM z
         UNION ALL SELECT doc_id, 2, 0, text FROM named
         UNION ALL SELECT doc_id, 3, 0, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\r]'))[1:3], chr(10)) FROM named),
c AS (SELECT doc_id, kind, unit, unnest(regexp_extract_all(lower(s), '[a-z0-9]+(?:\.[0-9]+)*')) AS word FROM unit),
cw AS (SELECT doc_id, kind, unit, c.word, count(*) * coalesce(any_value(idf), (SELECT ln(1.0 + n) + 1.0 FROM n)) AS w
       FROM c LEFT JOIN idf USING (word) GROUP BY doc_id, kind, unit, c.word),
cn AS (SELECT doc_id, kind, unit, sqrt(sum(w * w)) AS norm FROM cw GROUP BY doc_id, kind, unit),
s AS (SELECT doc_id, kind, unit, template, license, round(sum(w * t) / any_value(norm), 9) AS score
      FROM cw JOIN cn USING (doc_id, kind, unit) JOIN tn USING (word) GROUP BY doc_id, kind, unit, template, license),
own AS (SELECT doc_id, license, score FROM s WHERE score >= 0.6
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, kind, unit, license) = 1),
p AS (SELECT doc_id, source || '/' || (doc_id // 400) AS top, source || '/' || (doc_id // 400) || '/' || lang AS low, lang,
             regexp_matches(string_split(coalesce(text, ''), chr(10))[-1],
                            '(?i)licen[cs]e|copyright|copyleft|spdx|public domain|all rights reserved|\bgpl|\bwarrant') AS is_licence FROM documents),
f AS (SELECT doc_id, CASE WHEN NOT is_licence THEN low WHEN lang = 'en' THEN top ELSE low END AS dir, is_licence,
             CASE WHEN NOT is_licence THEN low || '/' || doc_id || '.txt'
                  ELSE (CASE WHEN lang = 'en' THEN top ELSE low END) || '/LICENSE.' || doc_id END AS path, top FROM p),
g AS (SELECT dir, license, score, path FROM f JOIN own USING (doc_id) WHERE is_licence
      QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1)
SELECT f.doc_id, f.path, coalesce(own.license, near.license, above.license) AS license,
       round(CASE WHEN own.license IS NOT NULL THEN own.score WHEN near.license IS NOT NULL THEN near.score ELSE above.score END, 6) AS score,
       CASE WHEN own.license IS NOT NULL THEN 'own' WHEN coalesce(near.license, above.license) IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN own.license IS NOT NULL THEN f.path ELSE coalesce(near.path, above.path) END AS license_path
FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN g AS near ON near.dir = f.dir LEFT JOIN g AS above ON above.dir = f.top""".replace(
        "@TEMPLATES@", ",\n".join("({}, '{}', '{}')".format(i, name, statement.replace("'", "''")) for i, (name, statement) in enumerate(TEMPLATES))).replace(
            "@CUE@", CUE),
}

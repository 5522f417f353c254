"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import context_tree, decontaminate, html_text, line_dedup, ngram_join, packing, periodic_runs, piece_codec, quality_rules, suffix_dedup, token_files, tokens, toxicity, whitening
from .common import crc32_of_id, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), capacity=1024, end_id=2)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), least=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, tokens.default_path(), end_id=0)
    return token_files.read(spark, path)


def op7_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"), folds=7, held=2)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), folds=5, held=0)
    return scored.select("doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), width=5, threshold=0.8)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(table(spark, sf_dir, "documents").select("doc_id", "text"), change=periodic_runs.planted)
    best = periodic_runs.longest(F.col("runs"))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return (
        found.withColumn("best", best)
        .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), most=16, scale=64, base=1_000_000)


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.decode(piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_suffix_dedup, op3_quality_rules, op4_html_text, op5_line_dedup, op6_token_files, op7_context_tree, op8_toxicity, op9_decontamination, op10_ngram_join, op11_periodic_runs, op12_whitening, op13_piece_codec)}

#: The rules of op3 with the exact binomial tail summed term by term.
_OP3_GRID = ", ".join(f"('{m}', {c}::DOUBLE)" for m, cs in quality_rules.GRID.items() for c in cs)
_OP3_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, lang, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, sum(least(8, i - before)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) AS before FROM s) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, base_failed, unnest([('symbols_per_word', n_symbols / greatest(n_words, 1)::DOUBLE), ('dup_line_share', n_dup_lines / greatest(n_lines, 1)::DOUBLE),
             ('repeat_share', n_repeat_words / greatest(n_words, 1)::DOUBLE), ('chars_per_word', word_chars / greatest(n_words, 1)::DOUBLE),
             ('capital_share', capitals / greatest(word_chars, 1)::DOUBLE)]) AS x FROM b),
q AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, cut) AS (VALUES {_OP3_GRID}),
c AS (SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (WHERE x[2] > cut) AS k
      FROM v SEMI JOIN q USING (doc_id) JOIN grid ON x[1] = rule WHERE NOT base_failed AND lang IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, count(*) OVER () AS tests FROM c),
a AS (SELECT lang, rule, min(cut) AS cut FROM t
      WHERE k < n * 0.01 AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.01) + (n - j) * ln(0.99)))) <= 0.05 / tests
      GROUP BY 1, 2),
bad AS (SELECT DISTINCT doc_id FROM v JOIN a ON v.lang = a.lang AND x[1] = rule WHERE x[2] > cut)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM b LEFT JOIN bad USING (doc_id)
"""

#: op5 by the same filters on exact document frequencies.
_OP5_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS line_no, ls[i] AS line, list_distinct(list_filter(regexp_split_to_array(ls[i], '[ \t-\r]+'), lambda x: x <> '')) AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
t AS (SELECT doc_id, line_no, unnest(w) AS tok FROM l), f AS (SELECT tok, count(*) AS f FROM t GROUP BY tok),
r AS (SELECT doc_id, line_no, tok, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY f, tok) AS rn, count(*) OVER (PARTITION BY doc_id, line_no) AS n FROM t JOIN f USING (tok)),
x AS (SELECT * FROM r WHERE rn <= n - (n * 800 + 999) // 1000 + 1),
c AS (SELECT DISTINCT a.doc_id, a.line_no, b.doc_id AS d2, b.line_no AS l2 FROM x a JOIN x b ON a.tok = b.tok
      WHERE (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.line_no < a.line_no)) AND a.n * 1000 >= b.n * 800 AND b.n * 1000 >= a.n * 800),
v AS (SELECT DISTINCT c.doc_id, c.line_no FROM c JOIN l p ON p.doc_id = c.doc_id AND p.line_no = c.line_no JOIN l q ON q.doc_id = d2 AND q.line_no = l2
      WHERE 1000 * len(list_intersect(p.w, q.w)) >= 800 * (len(p.w) + len(q.w) - len(list_intersect(p.w, q.w)))),
k AS (SELECT l.doc_id, count(*) FILTER (WHERE len(w) > 0) AS n_lines, count(v.line_no) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (WHERE v.line_no IS NULL), '') AS kept
      FROM l LEFT JOIN v ON v.doc_id = l.doc_id AND v.line_no = l.line_no GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN n_removed > 0 THEN kept ELSE text END AS text FROM d LEFT JOIN k USING (doc_id)
"""

#: op10 by joining all shingles.
_OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 1000 * c >= 800 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(root) AS class_id FROM r GROUP BY id), k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT id AS doc_id, class_id, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN k ON k.a = m.id
"""

ORACLE_SQL: dict[str, str] = {"op3_quality_rules": _OP3_SQL, "op5_line_dedup": _OP5_SQL, "op10_ngram_join": _OP10_SQL}

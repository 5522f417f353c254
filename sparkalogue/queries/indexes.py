"""Searches over stored indexes: vectors by probed lists, texts by words and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sets, text_index, tiers, vector_index
from .registry import Family, read
from .similarity import ORACLE_SQL as SIMILARITY_SQL
from .similarity import _word_sets

family = Family()


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@family.add("embedding_index_topk", SIMILARITY_SQL["embedding_cosine_topk"])
def embedding_index_topk(spark, sf_dir):
    """The neighbours of a full scan from an index: near lists first, then those that may still hold a better row."""
    vectors = _vectors(spark, sf_dir)
    return vector_index.search(vector_index.build(vectors), vectors.where("id % 100 = 0"), k=10, exact=True)


@family.add("embedding_index_probed")
def embedding_index_probed(spark, sf_dir):
    """Neighbours from the near lists only, as many as a sample of exact answers says are needed for a recall of 0.95."""
    vectors = _vectors(spark, sf_dir)
    index = vector_index.build(vectors)
    if index is None:
        return vector_index.search(None, vectors, k=10)
    return vector_index.search(index, vectors.where("id % 100 = 0"), k=10, probes=vector_index.probes_for(index, vectors, k=10, recall=0.95))


@family.add("jaccard_joined_rows")
def jaccard_joined_rows(spark, sf_dir):
    """How far the floors of jaccard_shared_tokens_topk narrow each query: words of which one must be shared, and the rows of their lists against all."""
    return sets.jaccard_topk(*_word_sets(spark, sf_dir), k=10, report=True)


def _index(spark, sf_dir, stems=False):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, text_index.build(docs, "doc_id", "text", stems=stems)


def _sql_hits(*words: str) -> str:
    named = " ".join(f"WHEN '{w}' THEN {n}" for n, w in enumerate(words))
    return f"""
    a AS (SELECT doc_id AS id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
    p AS (SELECT id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM a),
    o AS (SELECT id, CASE word {named} END AS term, pos FROM p WHERE word IN ({", ".join(f"'{w}'" for w in words)})),
    h AS (SELECT o.* FROM o SEMI JOIN (SELECT id FROM o GROUP BY id HAVING count(DISTINCT term) = {len(words)}) k USING (id))"""


def _sql_covers(n: int) -> str:
    latest = ", ".join(f"max(CASE WHEN term = {t} THEN pos END) OVER w AS l{t}" for t in range(n))
    every, least = " AND ".join(f"l{t} IS NOT NULL" for t in range(n)), ", ".join(f"l{t}" for t in range(n))
    return f"""
    e AS (SELECT id, pos, {latest} FROM h WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    c AS (SELECT id, least({least}) AS first, min(pos) AS last FROM e WHERE {every} GROUP BY 1, 2),
    v AS (SELECT c.id, first, last, count(*) AS inside FROM c JOIN h ON h.id = c.id AND h.pos BETWEEN first AND last GROUP BY 1, 2, 3)"""


_SQL_PAIRS = """
    f AS (SELECT x.id, abs(x.pos - y.pos) AS d FROM h x JOIN h y ON x.id = y.id AND x.term < y.term AND abs(x.pos - y.pos) <= 100),
    r AS (SELECT id, 1 - exp(sum(ln(1 - 0.1 * sqrt(1 / (1.005 + 0.05 * exp(d / 1.5 - 2)))))) AS near FROM f GROUP BY id),
    k AS (SELECT h.id, coalesce(near, 1e-20) AS rank FROM (SELECT DISTINCT id FROM h) h LEFT JOIN r USING (id))"""

_SQL_SNIPPETS = """
    b AS (SELECT id, arg_min(first, (last - first) * 10000000 + first) AS first, arg_min(last, (last - first) * 10000000 + first) AS last FROM v GROUP BY id),
    g AS (SELECT id, greatest(first - greatest(0, 25 - (last - first + 1)) // 2, 0) AS start FROM b),
    m AS (SELECT g.id, start, list(DISTINCT pos) AS marked FROM g JOIN h ON h.id = g.id AND pos >= start AND pos < start + 25 GROUP BY 1, 2),
    y AS (SELECT m.id, start, marked, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS u FROM m JOIN a USING (id)),
    s AS (SELECT id, array_to_string(list_transform(range(start, least(start + 25, len(u))), lambda i: CASE WHEN list_contains(marked, i) THEN '[[' || u[i + 1] || ']]' ELSE u[i + 1] END), ' ') AS snippet FROM y)"""


@family.add("fts_pair_rank", f"WITH {_sql_hits('the', 'of')}, {_SQL_PAIRS} SELECT id AS doc_id, round(rank, 6) AS rank FROM k")
def fts_pair_rank(spark, sf_dir):
    """Documents with both words by how near these stand to each other."""
    _, index = _index(spark, sf_dir)
    ranked = text_index.rank_pairs(text_index.hits(spark, index, "the of"), 2)
    return ranked.select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@family.add(
    "fts_cover_rank",
    f"WITH {_sql_hits('the', 'of', 'and')}, {_sql_covers(3)} SELECT id AS doc_id, round(sum(0.1 / (1 + greatest(last - first - (inside - 1), 0))), 6) AS rank FROM v GROUP BY id",
)
def fts_cover_rank(spark, sf_dir):
    """Documents with all three words by cover density."""
    _, index = _index(spark, sf_dir)
    ranked = text_index.rank_covers(text_index.hits(spark, index, "the of and"), 3)
    return ranked.select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


@family.add("fts_snippets", f"WITH {_sql_hits('the', 'of', 'and')}, {_sql_covers(3)}, {_SQL_SNIPPETS} SELECT id AS doc_id, snippet FROM s")
def fts_snippets(spark, sf_dir):
    """The words around the first shortest stretch with all three words."""
    docs, index = _index(spark, sf_dir)
    return text_index.snippets(docs, "doc_id", "text", text_index.hits(spark, index, "the of and"), 3).withColumnRenamed("id", "doc_id")


@family.add("fts_search", f"WITH {_sql_hits('the', 'of')}, {_SQL_PAIRS}, {_sql_covers(2)}, {_SQL_SNIPPETS} SELECT id AS doc_id, round(rank, 6) AS rank, snippet FROM k JOIN s USING (id)")
def fts_search(spark, sf_dir):
    """Rank and snippet in one answer; both words are stop words under the English configuration, so the plain side decides."""
    query = "the of"
    docs, index = _index(spark, sf_dir, stems=bool(text_index.terms(query, english=True)))
    return text_index.search(docs, "doc_id", "text", query, index).withColumnRenamed("id", "doc_id")


@family.add("fts_english_rank")
def fts_english_rank(spark, sf_dir):
    """Documents with words of both stems, by how near these stand; stop words of the query are left out."""
    _, index = _index(spark, sf_dir, stems=True)
    ranked = text_index.rank_pairs(text_index.hits(spark, index, "the erth and the ering", english=True), 2)
    return ranked.select(F.col("id").alias("doc_id"), F.round("rank", 6).alias("rank"))


QUERIES, ORACLE_SQL = family.queries, family.sql

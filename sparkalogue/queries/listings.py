"""Catalogue listings, facets, nested views and searches over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scalars
from ..operators import catalog, search
from .registry import Family, read

family = Family()


@family.add(
    "visibility_filter",
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)""",
)
def visibility_filter(spark, sf_dir):
    """Pending orders are private, and so are those of customers in debt."""
    builds = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_custkey").alias("lot"), (F.col("o_orderstatus") == "P").alias("private"))
    lots = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("lot"))
    return catalog.visible(builds, lots).select("o_orderkey", "o_custkey")


@family.add(
    "listing_page",
    """
    WITH m AS (SELECT o_custkey, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_done, max(o_orderdate) AS latest FROM orders GROUP BY 1)
    SELECT c_custkey, c_name, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(n_done, 0) AS n_done, latest
    FROM customer LEFT JOIN m ON c_custkey = o_custkey WHERE contains(lower(c_name), '1') AND c_mktsegment = 'BUILDING'
    ORDER BY latest DESC NULLS LAST, lower(c_name), c_custkey LIMIT 50 OFFSET 20
    """,
)
def listing_page(spark, sf_dir):
    media = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.max("o_orderdate").alias("latest"))
    chosen = catalog.all_of(scalars.contains_literal(F.col("c_name"), "1"), F.col("c_mktsegment") == "BUILDING", None)
    rows = read(spark, sf_dir, "customer").where(chosen).join(media, F.col("c_custkey") == F.col("o_custkey"), "left")
    shown = rows.select("c_custkey", "c_name", "c_mktsegment", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_done", F.lit(0)).alias("n_done"), "latest")
    return catalog.page(shown, [F.col("latest").desc_nulls_last(), F.lower("c_name"), F.col("c_custkey")], limit=50, offset=20)


@family.add("keyset_page", "SELECT event_id, user_id, event_type FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 25")
def keyset_page(spark, sf_dir):
    return catalog.keyset_page(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 500, 25)


@family.add(
    "capability_matrix",
    """SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label, coalesce(d.text <> '', FALSE) AS has_text, e.vec_id IS NOT NULL AS has_vector
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON e.vec_id = d.doc_id""",
)
def capability_matrix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text") != "", F.lit(False)).alias("has_text"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("l")).distinct()
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("v")).distinct()
    return docs.join(labels, "doc_id", "left").join(vectors, "doc_id", "left").select("doc_id", F.col("l").isNotNull().alias("has_label"), "has_text", F.col("v").isNotNull().alias("has_vector"))


@family.add("facets_distinct", "SELECT DISTINCT 'p_brand' AS facet, p_brand AS value FROM part UNION ALL SELECT DISTINCT 'p_type', p_type FROM part UNION ALL SELECT DISTINCT 'p_size', p_size::VARCHAR FROM part")
def facets_distinct(spark, sf_dir):
    return catalog.facets(read(spark, sf_dir, "part"), "p_brand", "p_type", "p_size")


@family.add(
    "status_counts",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_totalprice > 200000) AS n_large
       FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O') > 0""",
)
def status_counts(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count_if(F.col("o_totalprice") > 200000).alias("n_large")).where("n_open > 0")


@family.add(
    "nested_json_agg",
    """SELECT o_orderkey, coalesce(string_agg(concat(l_linenumber, ':', l_partkey, ':', l_returnflag), ';' ORDER BY l_linenumber, l_partkey, l_returnflag) FILTER (WHERE l_orderkey IS NOT NULL), '') AS items
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def nested_json_agg(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey")
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    rows = catalog.nested(orders, lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"], "items")
    return rows.select("o_orderkey", F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"], x["l_returnflag"])), ";").alias("items"))


@family.add(
    "tag_usage_zero_kept",
    """SELECT n_nationkey, n_name, count(s_suppkey) AS n_uses FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY 1, 2""",
)
def tag_usage_zero_kept(spark, sf_dir):
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    uses = read(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return catalog.usage(nations, uses, "n_nationkey", F.col("s_acctbal") > 5000)


@family.add(
    "top1_lateral",
    """SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderkey LIMIT 1) o ON TRUE""",
)
def top1_lateral(spark, sf_dir):
    best = catalog.first_per(read(spark, sf_dir, "orders"), ["o_custkey"], F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.asc("o_orderkey"))
    return read(spark, sf_dir, "customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@family.add("cover_scalar_subq", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS cover FROM customer")
def cover_scalar_subq(spark, sf_dir):
    covers = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("cover"))
    return read(spark, sf_dir, "customer").join(covers, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "cover")


@family.add(
    "per_kind_cap",
    """SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_name), p_partkey) AS rn FROM part) WHERE rn <= 3""",
)
def per_kind_cap(spark, sf_dir):
    return catalog.top_per(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name"), ["p_brand"], 3, F.lower("p_name"), F.asc("p_partkey"))


@family.add(
    "month_timeline",
    """SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'undated') AS month, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS n_done FROM orders GROUP BY 1""",
)
def month_timeline(spark, sf_dir):
    month = F.coalesce(F.date_format("o_orderdate", "yyyy-MM"), F.lit("undated"))
    return read(spark, sf_dir, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"))


@family.add(
    "unique_assignment",
    """
    WITH o AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45), g AS (SELECT p_partkey, count(l_suppkey) AS n, min(l_suppkey) AS s FROM part LEFT JOIN o ON l_partkey = p_partkey GROUP BY 1)
    SELECT p_partkey, CASE WHEN n = 1 THEN s END AS l_suppkey, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS outcome FROM g
    """,
)
def unique_assignment(spark, sf_dir):
    offers = read(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return catalog.unique_assignment(read(spark, sf_dir, "part"), offers, "p_partkey", "l_suppkey")


@family.add(
    "redirect_resolve",
    """
    WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 1 END AS r FROM orders)
    SELECT p.id, CASE WHEN p.r IS NULL THEN p.id ELSE t.id END AS target FROM p LEFT JOIN p t ON t.id = p.r
    """,
)
def redirect_resolve(spark, sf_dir):
    """Every third order stands for a page that redirects to the next number."""
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") + 1).alias("redirect_to"))
    return catalog.resolve_redirects(pages)


@family.add(
    "structural_features",
    """
    WITH u AS (SELECT url, octet_length(encode(html)) AS size, regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '^https?://[^/]*(.*)$', 1) AS path FROM pages)
    SELECT host, count(*) AS n_files, sum(size)::BIGINT AS total_size, max(len(list_filter(string_split(path, '/'), lambda x: x <> '')))::INTEGER AS max_depth, count(*) FILTER (WHERE lower(path) LIKE '%.html') AS n_html FROM u GROUP BY host
    """,
)
def structural_features(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.octet_length("html").alias("size"), F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_extract("url", "^https?://[^/]*(.*)$", 1).alias("path"))
    return pages.groupBy("host").agg(F.count("*").alias("n_files"), F.sum("size").alias("total_size"), F.max(scalars.depth(F.col("path"))).alias("max_depth"), F.count_if(scalars.extension(F.col("path")) == "html").alias("n_html"))


@family.add("wikilink_edges", r"""SELECT page_id AS id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 2""")
def wikilink_edges(spark, sf_dir):
    return markup.link_edges(read(spark, sf_dir, "pages"), "page_id", markup.hrefs(F.col("html")))


@family.add("backlink_counts", r"""SELECT target, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1""")
def backlink_counts(spark, sf_dir):
    return wikilink_edges(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n_pages"))


_SQL_TRIGRAMS = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@family.add(
    "trigram_name_search",
    f"""
    WITH t AS (SELECT p_partkey, p_name, {_SQL_TRIGRAMS.format("p_name")} AS a, {_SQL_TRIGRAMS.format("'blue rin'")} AS b FROM part),
    s AS (SELECT p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM t)
    SELECT * FROM s WHERE similarity >= 0.3 OR contains(lower(p_name), 'blue rin')
    """,
)
def trigram_name_search(spark, sf_dir):
    return search.fuzzy_names(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "blue rin")


@family.add(
    "best_file_per_build",
    f"""
    WITH t AS (SELECT l_orderkey, p_partkey, p_name, {_SQL_TRIGRAMS.format("p_name")} AS a, {_SQL_TRIGRAMS.format("'red ring'")} AS b FROM lineitem JOIN part ON p_partkey = l_partkey WHERE contains(lower(p_name), 'ring')),
    s AS (SELECT l_orderkey, p_partkey, p_name, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS similarity FROM t)
    SELECT l_orderkey, p_partkey, p_name, similarity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY similarity DESC, p_partkey) AS rn FROM s) WHERE rn = 1
    """,
)
def best_file_per_build(spark, sf_dir):
    parts = read(spark, sf_dir, "part").where(scalars.contains_literal(F.col("p_name"), "ring")).select("p_partkey", "p_name", F.round(scalars.trigram_similarity(F.col("p_name"), F.lit("red ring")), 6).alias("similarity"))
    hits = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey")
    return catalog.first_per(hits, ["l_orderkey"], F.desc("similarity"), F.asc("p_partkey"))


@family.add(
    "merged_search",
    """
    WITH n AS (SELECT c_custkey AS id, 0.9::DOUBLE AS sim, 0 AS arm FROM customer WHERE contains(lower(c_name), '42')),
    f AS (SELECT o_custkey AS id, max(o_totalprice / 500000.0) AS sim, 1 AS arm FROM orders WHERE o_totalprice > 400000 GROUP BY 1)
    SELECT id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, arm) AS rn FROM (SELECT * FROM n UNION ALL SELECT * FROM f)) WHERE rn = 1
    """,
)
def merged_search(spark, sf_dir):
    names = read(spark, sf_dir, "customer").where(scalars.contains_literal(F.col("c_name"), "42")).select(F.col("c_custkey").alias("id"), F.lit(0.9).alias("sim"))
    files = read(spark, sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.col("o_totalprice") / 500000.0).alias("sim"))
    return catalog.merge_ranked(names, files, "id", "sim").select("id", F.round("sim", 6).alias("sim"))


@family.add("fts_simple_and", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['the', 'and', 'of'])")
def fts_simple_and(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(search.has_all(F.col("text"), "The and OF")).select("doc_id")


@family.add(
    "exact_snippet",
    """
    WITH d AS (SELECT doc_id, text, instr(lower(text), 'of the') AS a FROM documents WHERE lang = 'en'),
    e AS (SELECT *, greatest(a - 60, 1) AS s, least(a + 66, length(text) + 1) AS e FROM d WHERE a > 0)
    SELECT doc_id, concat(CASE WHEN s > 1 THEN '…' ELSE '' END, substr(text, s, e - s), CASE WHEN e <= length(text) THEN '…' ELSE '' END) AS snippet FROM e
    """,
)
def exact_snippet(spark, sf_dir):
    found = read(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", search.snippet(F.col("text"), "of the").alias("snippet"))
    return found.where("snippet is not null")


@family.add(
    "hash_lookup_union",
    """
    WITH q AS (SELECT md5(text) AS term FROM documents WHERE doc_id % 100 = 0 UNION SELECT sha1(text) FROM documents WHERE doc_id % 100 = 1 UNION SELECT sha256(text) FROM benchmark),
    h AS (SELECT doc_id AS id, md5(text) AS term FROM documents UNION ALL SELECT doc_id, sha1(text) FROM documents UNION ALL SELECT doc_id, sha256(text) FROM documents)
    SELECT DISTINCT term, id FROM h JOIN q USING (term)
    """,
)
def hash_lookup_union(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"))
    bench = read(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("term"))
    terms = docs.where("doc_id % 100 = 0").select(F.col("md5").alias("term")).union(docs.where("doc_id % 100 = 1").select("sha1")).union(bench)
    return catalog.lookup([(docs, "md5"), (docs, "sha1"), (docs, "sha256")], "doc_id", terms)


QUERIES, ORACLE_SQL = family.queries, family.sql

"""Small functions and lookups over whole tables: cleaned texts, numbers, slugs, regions, prefixes, pages of a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scalars
from ..operators import catalog, history, sets, upsert
from ..streaming import jobs
from .registry import Family, read

family = Family()


@family.add("content_normalized", r"SELECT doc_id, sha256(regexp_replace(text, '\n+$', '') || chr(10)) AS content_sha256 FROM documents WHERE text NOT LIKE '%' || chr(13) || '%'")
def content_normalized(spark, sf_dir):
    """Digests that line ends and blank ends don't change."""
    k = F.col("doc_id") % 3
    ends = F.when(k == 0, "\r\n").when(k == 1, "\r").otherwise("\n")
    written = F.concat(F.replace("text", F.lit("\n"), ends), F.repeat(ends, 2))
    return read(spark, sf_dir, "documents").where(~F.contains("text", F.lit("\r"))).select("doc_id", F.sha2(scalars.normalize_content(written), 256).alias("content_sha256"))


@family.add("parsed_numbers", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey * 1000003 WHEN 1 THEN -1 WHEN 2 THEN -9223372036854775808 + o_orderkey END AS n FROM orders")
def parsed_numbers(spark, sf_dir):
    """Unsigned 64-bit decimals as signed numbers; signs, words and larger ones are none."""
    k, key = F.col("o_orderkey") % 5, F.col("o_orderkey")
    text = F.when(k == 0, (key * 1000003).cast("string")).when(k == 1, "18446744073709551615").when(k == 2, (F.lit("9223372036854775808").cast("decimal(20,0)") + key).cast("string")).when(k == 3, "18446744073709551616").otherwise(F.concat(F.lit("-"), key.cast("string")))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_u64(text).alias("n"))


@family.add("controls_stripped", "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name FROM part")
def controls_stripped(spark, sf_dir):
    k = F.col("p_partkey") % 3
    dirty = F.when(k == 0, F.lit("\x00 \x7f ")).when(k == 1, F.concat(F.lit(" \x07"), "p_name", F.lit("\x1f "))).otherwise(F.replace("p_name", F.lit(" "), F.lit("\x01 ")))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.nullify(dirty).alias("name"))


@family.add("person_slugs", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'p-' || substr(sha256('漢字 ' || repeat('。', (p_partkey % 9)::INT)), 1, 8) ELSE trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM part")
def person_slugs(spark, sf_dir):
    """Slugs of names, and of those without letters that a slug can hold."""
    name = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("漢字 "), F.repeat(F.lit("。"), (F.col("p_partkey") % 9).cast("int")))).otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").select("p_partkey", scalars.slug_or_hash(name).alias("slug"))


@family.add(
    "regions_clamped",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_discount * 10 - 0.25 AS x, l_tax * 20 - 0.5 AS y, l_quantity / 50 AS w, l_quantity / 100 AS h FROM lineitem),
       c AS (SELECT *, greatest(x, 0) AS l, greatest(y, 0) AS t, least(x + w, 1) AS r, least(y + h, 1) AS b FROM r)
       SELECT l_orderkey, l_linenumber, round(sum(r - l), 6) AS width, round(sum(b - t), 6) AS height, count(*) AS n FROM c WHERE r > l AND b > t GROUP BY 1, 2""",
)
def regions_clamped(spark, sf_dir):
    """Regions cut to the unit square; those with nothing left go."""
    region = markup.clamp_region(F.col("l_discount") * 10 - 0.25, F.col("l_tax") * 20 - 0.5, F.col("l_quantity") / 50, F.col("l_quantity") / 100)
    left = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", region.alias("r")).where("r is not null")
    return left.groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum("r.w"), 6).alias("width"), F.round(F.sum("r.h"), 6).alias("height"), F.count("*").alias("n"))


@family.add("texts_cut", "SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 101), lambda k: octet_length(encode(substr(text, 1, k))) <= 100))::INT) AS start FROM documents WHERE text IS NOT NULL")
def texts_cut(spark, sf_dir):
    """The whole characters within a hundred bytes."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", scalars.cut_bytes(F.col("text"), 100).alias("start"))


@family.add("junk_files", "SELECT p_brand, count(*) FILTER (WHERE p_partkey % 4 < 2) AS junk, count(*) AS files FROM part GROUP BY 1")
def junk_files(spark, sf_dir):
    """Files of each brand, and those that the filtered digest passes over."""
    ending = F.when(F.col("p_partkey") % 4 == 0, ".NFO").when(F.col("p_partkey") % 4 == 1, "/file_id.diz").when(F.col("p_partkey") % 4 == 2, ".nfo.bin").otherwise("")
    files = read(spark, sf_dir, "part").select("p_brand", F.concat("p_name", ending).alias("path"))
    return files.groupBy("p_brand").agg(F.count_if(catalog.is_junk(F.col("path"))).alias("junk"), F.count("*").alias("files"))


@family.add("prefix_found", "SELECT sha256 FROM (SELECT DISTINCT sha256(text) AS sha256 FROM documents) WHERE sha256 LIKE 'a%' ORDER BY 1 LIMIT 3")
def prefix_found(spark, sf_dir):
    """Up to three rows by the beginning of a hash: more than one means that it is no name."""
    return catalog.prefix_matches(read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")).distinct(), "sha256", "a")


_SQL_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@family.add("neighbour_jaccard", f"WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents) SELECT a.doc_id, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0)::DOUBLE, 0), 6) AS jaccard FROM d a JOIN d b ON b.doc_id = a.doc_id + 1")
def neighbour_jaccard(spark, sf_dir):
    """Jaccard of each document's words with those of the next."""
    docs = read(spark, sf_dir, "documents").select("doc_id", sets.words(F.col("text")).alias("w"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", F.round(sets.jaccard(F.col("w"), F.col("next")), 6).alias("jaccard"))


@family.add("semantic_documents", "SELECT p_partkey, p_name || '.v1 ' || p_type || CASE WHEN p_size > 9 THEN ' ' || p_size ELSE '' END AS doc FROM part")
def semantic_documents(spark, sf_dir):
    """What a text embedding is made from: the image's name without its extension, and titles of two characters or more."""
    made = sets.semantic_document(F.concat("p_name", F.lit(".v1.iso")), [F.concat(F.lit("\x02"), "p_type"), F.col("p_size").cast("string"), F.lit(None).cast("string")])
    return read(spark, sf_dir, "part").select("p_partkey", made.alias("doc"))


@family.add(
    "automatic_extracts_replaced",
    """WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 'edited' ELSE 'auto' END AS status FROM events WHERE event_id % 2 = 0), i AS (SELECT event_id, user_id, 'auto' AS status FROM events WHERE event_id % 2 = 1 AND user_id % 4 = 0)
       SELECT * FROM s WHERE status <> 'auto' OR user_id NOT IN (SELECT user_id FROM i) UNION ALL SELECT * FROM i""",
)
def automatic_extracts_replaced(spark, sf_dir):
    """New rows replace the automatic ones of their parents; edited ones stay."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id")
    stored = events.where("event_id % 2 = 0").withColumn("status", F.when(F.col("event_id") % 3 == 0, "edited").otherwise("auto"))
    return upsert.replace_status(stored, events.where("event_id % 2 = 1 and user_id % 4 = 0").withColumn("status", F.lit("auto")), ["user_id"])


@family.add("log_slice", "SELECT o_orderkey AS oid, o_orderdate AS at FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5) ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def log_slice(spark, sf_dir):
    """The third page of a log, of those commits that are reachable."""
    reachable = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"))
    commits = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("oid"), F.col("o_orderdate").alias("at"))
    return history.log_page(commits, reachable, "oid", 50, 100)


@family.add("sync_cursor", "SELECT coalesce(min(ts) FILTER (WHERE event_id % 997 = 500), max(ts)) AS cursor FROM events")
def sync_cursor(spark, sf_dir):
    """Up to when all changes went well."""
    return jobs.safe_cursor(read(spark, sf_dir, "events").select("ts", (F.col("event_id") % 997 != 500).alias("ok")))


QUERIES, ORACLE_SQL = family.queries, family.sql

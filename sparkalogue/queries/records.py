"""Records and their parts: titles, sizes, histograms, features, ids, attributes, parent revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scalars
from ..operators import catalog, history, tiers, upsert
from ..plans.objects import Attribute, attribute_errors
from .objects import _SQL_BASE as _SQL_OBJECTS
from .objects import _run as run_objects
from .registry import Family, read

family = Family()


@family.add(
    "size_texts",
    """
    WITH n AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN NULL ELSE CAST(floor(o_totalprice * power(1024, o_orderkey % 4)) AS BIGINT) END AS n FROM orders),
    u AS (SELECT *, CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 WHEN n < 1099511627776 THEN 3 ELSE 4 END AS k FROM n),
    t AS (SELECT *, CAST(floor(n * 10 / power(1024, k) + 0.5) AS BIGINT) AS tenths, CAST(floor(n * 100 / power(1024, 3) + 0.5) AS BIGINT) AS cents FROM u)
    SELECT o_orderkey, coalesce(CASE WHEN k = 0 THEN n || ' B' ELSE (tenths // 10) || '.' || (tenths % 10) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END, '—') AS listed,
           CASE WHEN k = 0 THEN n || ' B' WHEN k < 3 THEN (tenths // 10) || '.' || (tenths % 10) || ' ' || ['KiB', 'MiB'][k] ELSE (cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || ' GiB' END AS field FROM t
    """,
)
def size_texts(spark, sf_dir):
    """Sizes as listings and as page fields show them."""
    n = F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("o_totalprice") * F.pow(F.lit(1024), F.col("o_orderkey") % 4)).cast("bigint"))
    return read(spark, sf_dir, "orders").withColumn("n", n).select("o_orderkey", scalars.listing_size(F.col("n")).alias("listed"), scalars.field_size(F.col("n")).alias("field"))


@family.add(
    "title_namespaces",
    """
    WITH w AS (SELECT p_partkey AS k, p_name AS n, upper(p_name[1]) || p_name[2:] AS c FROM part)
    SELECT k AS p_partkey,
           CASE k % 8 WHEN 0 THEN 'main' WHEN 1 THEN 'user_talk' WHEN 2 THEN 'category' WHEN 3 THEN 'file' WHEN 6 THEN 'main' END AS ns,
           replace(CASE k % 8 WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN c WHEN 6 THEN 'Unknown: ' || n END, ' ', '_') AS slug,
           CASE k % 8 WHEN 0 THEN c WHEN 1 THEN c WHEN 2 THEN c WHEN 3 THEN c WHEN 6 THEN 'Unknown: ' || n END AS title,
           CASE WHEN k % 8 IN (1, 6) THEN n END AS fragment,
           CASE k % 8 WHEN 4 THEN 'illegal-char' WHEN 5 THEN 'relative' WHEN 7 THEN 'empty' END AS error FROM w
    """,
)
def title_namespaces(spark, sf_dir):
    """Written titles in their parts: prefixes, leading colons, fragments, and what can't be a title."""
    k, n = F.col("p_partkey") % 8, F.col("p_name")
    written = (
        F.when(k == 0, F.concat(F.lit("  "), F.replace(n, F.lit(" "), F.lit("__")), F.lit("_"))).when(k == 1, F.concat(F.lit("User_Talk : "), n, F.lit("# "), n)).when(k == 2, F.concat(F.lit(": Category:"), n))
        .when(k == 3, F.concat(F.lit("IMAGE:"), n)).when(k == 4, F.concat(n, F.lit("[x]"))).when(k == 5, F.concat(F.lit("../"), n)).when(k == 6, F.concat(F.lit("unknown: "), n, F.lit("#"), n)).otherwise("help: ")
    )
    return read(spark, sf_dir, "part").select("p_partkey", markup.title_parts(written).alias("t")).select("p_partkey", "t.*")


@family.add(
    "parent_deltas",
    """WITH r AS (SELECT conv_id, turn, conv_id * 1000 + turn AS rev, CASE WHEN turn % 3 <> 0 THEN conv_id * 1000 + turn - 1 WHEN turn > 0 THEN conv_id * 1000 END AS parent, length(text) AS size FROM conversations)
       SELECT r.conv_id, r.turn, r.size, r.size - coalesce(p.size, 0) AS delta FROM r LEFT JOIN r p ON p.rev = r.parent""",
)
def parent_deltas(spark, sf_dir):
    """Changes of size against the revision that each was made from, which needn't be the one before."""
    turn = F.col("turn")
    parent = F.when(turn % 3 != 0, F.col("conv_id") * 1000 + turn - 1).when(turn > 0, F.col("conv_id") * 1000)
    revisions = read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + turn).alias("rev"), parent.alias("parent"), "text")
    return history.parent_deltas(revisions, "rev", "parent", F.length("text")).select("conv_id", "turn", "size", "delta")


@family.add("dsl_groupby_multi", f"{_SQL_OBJECTS} SELECT CAST(to_json(tags) AS VARCHAR) AS tags, count(*) AS n FROM o GROUP BY tags ORDER BY 1 NULLS LAST LIMIT 200")
def dsl_groupby_multi(spark, sf_dir):
    """A field of lists groups by the text of the list."""
    return run_objects(spark, sf_dir, aggs=[{"fn": "count", "as": "n"}], group_by="tags")


@family.add(
    "extension_histogram",
    r"""WITH u AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS host, regexp_extract(url, '[^/]*$') AS name FROM pages), e AS (SELECT host, regexp_extract(lower(name), '^.+\.([^.]+)$', 1) AS ext FROM u)
        SELECT host, ext, count(*) AS n FROM e WHERE ext <> '' GROUP BY ALL""",
)
def extension_histogram(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host"), F.regexp_replace("url", "^https?://", "").alias("path"))
    return catalog.extension_histogram(pages, "host", "path")


@family.add("imphash_classes", "SELECT p_partkey AS id, CASE WHEN h IS NULL THEN p_partkey ELSE min(p_partkey) OVER w END AS class_id, CASE WHEN h IS NULL THEN 1 ELSE count(*) OVER w END AS members FROM (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN md5(p_brand || p_size) END AS h FROM part) WINDOW w AS (PARTITION BY h)")
def imphash_classes(spark, sf_dir):
    """Programs of equal import hash; those without one are alone."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 10 != 0, F.md5(F.concat("p_brand", F.col("p_size").cast("string")))).alias("imphash"))
    return tiers.classes(parts, "imphash")


_SQL_SLUG = "trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') || '--' || trim(regexp_replace(lower(system), '[^a-z0-9]+', '-', 'g'), '-')"


@family.add(
    "games_created",
    f"""
    WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand AS system, CASE WHEN p_partkey % 4 = 0 THEN lower(replace(p_name, ' ', '-')) || '--' || lower(replace(p_brand, '#', '-')) END AS slug FROM part WHERE p_partkey % 3 <> 0),
    n AS (SELECT DISTINCT p_name AS name, p_brand AS system FROM part EXCEPT SELECT name, system FROM s),
    m AS (SELECT (SELECT max(id) FROM s) + 1 + k + 256 * (row_number() OVER (PARTITION BY k ORDER BY name, system) - 1) AS id, name, system, NULL AS slug FROM (SELECT *, ('0x' || substr(md5(name || chr(10) || system), 1, 2))::BIGINT AS k FROM n)),
    a AS (SELECT * FROM s UNION ALL SELECT * FROM m), b AS (SELECT *, {_SQL_SLUG} AS base FROM a),
    f AS (SELECT base, min(id) AS first FROM b WHERE slug IS NULL GROUP BY 1)
    SELECT b.id, name, system, CASE WHEN slug IS NOT NULL THEN slug WHEN b.id = f.first AND base NOT IN (SELECT slug FROM s WHERE slug IS NOT NULL) THEN base ELSE base || '-' || b.id END AS slug FROM b LEFT JOIN f USING (base)
    """,
)
def games_created(spark, sf_dir):
    """Two thirds of the parts are known games, every fourth of these with a slug; all names and systems are asked for."""
    parts = read(spark, sf_dir, "part")
    slug = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit("--"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))))
    stored = parts.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("system"), slug.alias("slug"))
    return upsert.get_or_create(stored, parts.select(F.col("p_name").alias("name"), F.col("p_brand").alias("system")))


FIELDS = {"k": Attribute("number"), "label": Attribute("string"), "day": Attribute("date"), "done": Attribute("boolean"), "tags": Attribute("string", multi=True)}


@family.add(
    "attribute_errors",
    """
    SELECT event_id, list_sort(list_filter([CASE WHEN event_id % 7 = 0 THEN 'unknown: colour' END, CASE WHEN event_id % 3 = 0 THEN 'missing: label' END, CASE WHEN event_id % 4 = 0 THEN 'bad value: k' END,
           CASE WHEN event_id % 5 = 0 THEN 'bad value: day' END, CASE WHEN event_id % 6 = 5 THEN 'bad value: done' END], lambda x: x IS NOT NULL)) AS errors FROM events
    """,
)
def attribute_errors_of_events(spark, sf_dir):
    """What is wrong with written attributes: unknown ones, required ones left empty, values of another type."""
    i, text = F.col("event_id"), lambda c: F.lit(c)
    raw = F.map_filter(
        F.create_map(
            text("k"), F.when(i % 4 == 0, "ten").otherwise(i.cast("string")), text("label"), F.when(i % 3 == 0, "  ").otherwise(F.col("event_type")),
            text("day"), F.when(i % 5 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")), text("done"), F.when(i % 6 == 5, "maybe").when(i % 6 == 4, "No"), text("tags"), text("a, b"), text("colour"), F.when(i % 7 == 0, "red"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return read(spark, sf_dir, "events").select("event_id", attribute_errors(FIELDS, raw, frozenset({"label"})).alias("errors"))


@family.add(
    "query_features",
    """
    WITH f AS (SELECT n_regionkey, list_sort(list(DISTINCT ('0x' || substr(sha1(s_name), 1, 16))::UBIGINT::HUGEINT & 9223372036854775807::HUGEINT)) AS ids FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT r_regionkey AS region, sha256(r_name) AS sha256, r_name AS name, CASE WHEN r_regionkey % 2 = 0 THEN md5(r_name) END AS content_hash, CASE WHEN r_regionkey > 1 THEN md5('i' || r_name) END AS imphash, NULL::VARCHAR AS tlsh,
           CASE WHEN r_regionkey % 3 = 0 THEN 1 ELSE 0 END AS n_tracks, coalesce(list_transform(ids, lambda x: x::BIGINT), []::BIGINT[]) AS fileset FROM region LEFT JOIN f ON n_regionkey = r_regionkey
    """,
)
def query_features(spark, sf_dir):
    """Search features of a record for each region: suppliers are files within directories of their nations."""
    nations, suppliers = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    file = F.struct(F.col("s_name").alias("name"), F.lit("file").alias("type"), F.sha1("s_name").alias("sha1"))
    held = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(file)).alias("children"))
    folders = nations.join(held, "n_nationkey").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list(F.struct(F.col("n_name").alias("name"), F.lit("dir").alias("type"), "children")).alias("contents"))
    k, name = F.col("r_regionkey"), F.col("r_name")
    sound = lambda kind, path, fp: F.struct(F.lit(kind).alias("kind"), F.lit(path).alias("path"), fp.cast("array<bigint>").alias("audio_fp"))
    media = F.array(sound("image", "a", F.array(F.lit(1))), sound("audio", "b", F.array()), sound("audio", "c", F.when(k % 3 == 0, F.array(F.lit(5), F.lit(6)))))
    record = F.struct(
        F.struct(F.sha2("r_name", 256).alias("sha256"), name.alias("name")).alias("image"), F.struct(F.when(k % 2 == 0, F.md5("r_name")).alias("content_hash")).alias("composites"),
        F.when(k > 1, F.struct(F.md5(F.concat(F.lit("i"), name)).alias("imphash"))).alias("exe_fp"), media.alias("media"), "contents",
    )
    records = read(spark, sf_dir, "region").join(folders, "r_regionkey", "left").select(k.alias("region"), F.to_json(record).alias("record"))
    return catalog.query_features(records, "region", "record").select("region", "sha256", "name", "content_hash", "imphash", "tlsh", F.size("tracks").alias("n_tracks"), "fileset")


QUERIES, ORACLE_SQL = family.queries, family.sql

"""Pages and their searches: suggestions, facets, sort whitelists, saves, reverts, content trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scalars
from ..operators import catalog, history, search, upsert
from .listings import _SQL_TRIGRAMS
from .registry import Family, read

family = Family()


def _similar(name: str, term: str) -> str:
    """SQL of the rounded trigram similarity of a column and a term."""
    a, b = _SQL_TRIGRAMS.format(name), _SQL_TRIGRAMS.format(f"'{term}'")
    return f"round(len(list_intersect({a}, {b})) / greatest(len(list_distinct(list_concat({a}, {b}))), 1)::DOUBLE, 6)"


@family.add("media_name_search", f"SELECT s_suppkey, s_name, sim AS similarity FROM (SELECT *, {_similar('s_name', 'supplier 1_')} AS sim FROM supplier) WHERE sim >= 0.3 OR s_name ILIKE '%supplier 1_%' ORDER BY sim DESC, s_name LIMIT 100")
def media_name_search(spark, sf_dir):
    """The best hundred names, wildcards live."""
    return search.media_names(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", "supplier 1_", limit=100)


@family.add(
    "name_or_text_search",
    f"""SELECT p_partkey, sim AS similarity FROM (SELECT *, {_similar('p_name', 'blue ring small')} AS sim FROM part)
        WHERE sim >= 0.3 OR list_has_all(regexp_split_to_array(lower(concat_ws(' ', p_name, p_type, p_brand)), '[^a-z0-9]+'), ['blue', 'ring', 'small']) ORDER BY sim DESC, p_partkey LIMIT 200""",
)
def name_or_text_search(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("doc", F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    return search.name_or_text(parts, "p_name", "doc", "blue ring small", 200, "p_partkey").select("p_partkey", "similarity")


@family.add("game_suggestions", f"SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') ORDER BY {_similar('p_name', 'ring')} DESC, lower(p_name), p_brand, p_partkey LIMIT 50")
def game_suggestions(spark, sf_dir):
    return search.suggestions(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", " ring ", 50, F.asc("p_brand"), F.asc("p_partkey"))


@family.add("game_suggestions_empty", "SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 50")
def game_suggestions_empty(spark, sf_dir):
    return search.suggestions(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "", 50, F.asc("c_custkey"))


@family.add("live_wildcards", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%CUSTOMER%_7%'")
def live_wildcards(spark, sf_dir):
    return read(spark, sf_dir, "customer").where(search.wildcard_like(F.col("c_name"), "CUSTOMER%_7")).select("c_custkey")


@family.add(
    "extract_filters",
    """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1999-12-31'
       AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""",
)
def extract_filters(spark, sf_dir):
    """Date range, an equal facet and rows in two other tables."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    items = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    people = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    span = ("o_orderdate", F.lit("1996-01-01").cast("timestamp"), F.lit("1999-12-31").cast("timestamp"))
    return catalog.filter_extracts(orders, {"o_orderpriority": "1-URGENT", "o_custkey": None}, span, [(items, "o_orderkey"), (people, "o_custkey")]).select("o_orderkey", "o_orderdate")


_SQL_DATED = "SELECT c_custkey, c_name, max(o_orderdate) AS last_order, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL"


def _sorted_page(direction: str, order: str):
    @family.add(f"listing_by_date_{direction}", f"SELECT * FROM ({_SQL_DATED}) ORDER BY last_order {order} NULLS LAST, lower(c_name), c_custkey LIMIT 500")
    def query(spark, sf_dir):
        counted = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_order"), F.count("*").alias("n"))
        rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name").join(counted, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        allowed = {"name": F.lower("c_name"), "build_date": F.col("last_order"), "files": F.col("n")}
        order_by = catalog.ordered(rows, "build_date", direction, allowed, "name", frozenset({"build_date"}), F.lower("c_name"), F.col("c_custkey"))
        return catalog.page(rows, order_by, limit=500)


_sorted_page("asc", "ASC")
_sorted_page("desc", "DESC")


@family.add("pair_lookup", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT p_partkey, 1 + p_partkey % 10 FROM part)")
def pair_lookup(spark, sf_dir):
    pairs = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (1 + F.col("p_partkey") % 10).alias("l_suppkey"))
    return catalog.having_pairs(read(spark, sf_dir, "lineitem"), pairs, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@family.add(
    "first_arm_wins",
    """SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY arm, kind) AS rn FROM (SELECT o_custkey AS id, o_orderpriority AS kind, 0 AS arm FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT c_custkey, c_mktsegment, 1 FROM customer)) WHERE rn = 1""",
)
def first_arm_wins(spark, sf_dir):
    """A customer's own finished orders come before its segment."""
    own = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("kind")).distinct()
    return catalog.first_arm([own, read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind"))], ["id"], F.asc("kind"))


@family.add(
    "category_changes",
    """WITH o AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-16'), n AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-16')
       SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""",
)
def category_changes(spark, sf_dir):
    """What kinds of events users began or ceased to have by the middle of the month."""
    events, cut = read(spark, sf_dir, "events").select("user_id", "event_type", "ts"), F.lit("2024-01-16").cast("timestamp")
    return catalog.two_way_difference(events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut), "user_id", "event_type")


@family.add("distinct_values_default", "SELECT c_custkey, coalesce(list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)), []::VARCHAR[]) AS \"values\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def distinct_values_default(spark, sf_dir):
    return catalog.distinct_values(read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderpriority")


@family.add("incomplete_files", "SELECT l_orderkey, count(*) AS files, count(*) FILTER (WHERE l_quantity > 45) AS incomplete FROM lineitem WHERE l_linenumber < 6 AND l_returnflag <> 'A' GROUP BY 1")
def incomplete_files(spark, sf_dir):
    files = read(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") >= 6).alias("is_dir"), (F.col("l_returnflag") == "A").alias("in_archive"), (F.col("l_quantity") > 45).alias("unreadable"))
    return catalog.incomplete_files(files, "l_orderkey")


@family.add(
    "filtered_composite_hash",
    """SELECT l_orderkey, sha256(unhex(string_agg(d, '' ORDER BY d) FILTER (WHERE l_shipdate < TIMESTAMP '2000-01-01'))) AS content_hash
       FROM (SELECT l_orderkey, l_shipdate, sha1(concat_ws('|', l_partkey, l_suppkey, l_linenumber)) AS d FROM lineitem) GROUP BY l_orderkey""",
)
def filtered_composite_hash(spark, sf_dir):
    """Digests without the files that a rule calls junk; null where nothing is left."""
    files = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", F.sha1(F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber")).alias("d"))
    return catalog.composite_digest(files, "l_orderkey", "d", skip=F.col("l_shipdate") >= F.lit("2000-01-01").cast("timestamp"))


@family.add(
    "asset_guard",
    """SELECT doc_id FROM (SELECT doc_id, source AS path, CASE WHEN doc_id % 3 = 0 THEN md5(text) WHEN doc_id % 3 = 1 THEN upper(sha256(text)) ELSE sha256(text) END AS sha256, CASE WHEN doc_id % 5 <> 0 THEN lang END AS mime FROM documents)
       WHERE path <> '' AND regexp_full_match(sha256, '[0-9a-f]{64}') AND mime IS NOT NULL""",
)
def asset_guard(spark, sf_dir):
    i = F.col("doc_id")
    sha = F.when(i % 3 == 0, F.md5("text")).when(i % 3 == 1, F.upper(F.sha2("text", 256))).otherwise(F.sha2("text", 256))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("path"), sha.alias("sha256"), F.when(i % 5 != 0, F.col("lang")).alias("mime"), F.lit("text").alias("kind"), F.col("n_chars").alias("size"))
    return rows.where(catalog.asset_ok()).select("doc_id")


@family.add(
    "mass_revert_plan",
    """WITH n AS (SELECT conv_id AS page, max(turn) AS bad_rev, arg_max(role, turn) AS author, max(turn) FILTER (WHERE role <> 'assistant') AS good_rev FROM conversations GROUP BY 1)
       SELECT page, bad_rev, good_rev, CASE WHEN good_rev IS NULL THEN 'delete' ELSE 'revert' END AS action FROM n WHERE author = 'assistant' AND bad_rev >= 2""",
)
def mass_revert_plan(spark, sf_dir):
    """What undoing all recent last turns of one role takes."""
    revisions = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("rev"), F.col("role").alias("author"))
    return history.revert_plan(revisions, "assistant", F.col("rev") >= 2)


@family.add(
    "page_save_links",
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS target FROM pages)
        SELECT page_id, target FROM l WHERE page_id % 4 <> 0 UNION ALL SELECT page_id, upper(target) FROM l WHERE page_id % 4 = 0 AND page_id % 8 <> 0""",
)
def page_save_links(spark, sf_dir):
    """Link rows after every fourth page was saved anew, every eighth without links."""
    pages = read(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(markup.hrefs(F.col("html"))).alias("target"))
    saved = pages.where("page_id % 4 = 0")
    return upsert.replace_derived(links, saved, links.where("page_id % 8 != 0").withColumn("target", F.upper("target")), "page_id")


@family.add(
    "moved_pages",
    """WITH p AS (SELECT c_name AS slug, NULL::VARCHAR AS redirect_to, c_nationkey = 3 AS deleted, c_custkey AS id FROM customer),
       m AS (SELECT c_name AS slug, 'moved/' || c_name AS new_slug FROM customer WHERE c_custkey % 10 = 0),
       j AS (SELECT p.*, CASE WHEN NOT deleted THEN new_slug END AS target FROM p LEFT JOIN m USING (slug))
       SELECT coalesce(target, slug) AS slug, redirect_to, deleted, id FROM j UNION ALL SELECT slug, target, false, NULL FROM j WHERE target IS NOT NULL""",
)
def moved_pages(spark, sf_dir):
    people = read(spark, sf_dir, "customer")
    pages = people.select(F.col("c_name").alias("slug"), F.lit(None).cast("string").alias("redirect_to"), (F.col("c_nationkey") == 3).alias("deleted"), F.col("c_custkey").alias("id"))
    moves = people.where("c_custkey % 10 = 0").select(F.col("c_name").alias("slug"), F.concat(F.lit("moved/"), "c_name").alias("new_slug"))
    return upsert.move_pages(pages, moves)


@family.add("automatic_rows_dropped", "SELECT event_id FROM events WHERE NOT (event_type = 'view' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5))")
def automatic_rows_dropped(spark, sf_dir):
    """Automatic rows (here: views) of some owners go; all others stay."""
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", "auto").otherwise("person").alias("source"))
    owners = read(spark, sf_dir, "customer").where("c_nationkey < 5").select(F.col("c_custkey").alias("user_id"))
    return upsert.drop_automatic(rows, owners, "user_id").select("event_id")


def _trees(spark, sf_dir):
    """A JSON tree for each region: nations as directories (one in three an archive with a hash), suppliers as files."""
    file = F.struct(F.col("s_name").alias("name"), F.lit("file").alias("type"), F.col("s_suppkey").alias("size"), F.concat(F.lit("2000-01-"), F.lpad((1 + F.col("s_suppkey") % 28).cast("string"), 2, "0")).alias("date"))
    files = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.to_json(F.sort_array(F.collect_list(file))).alias("children"))
    digest = F.when(F.col("n_nationkey") % 3 == 0, F.md5("n_name"))
    head = F.to_json(F.struct(F.col("n_name").alias("name"), F.lit("dir").alias("type"), digest.alias("md5")))
    held = F.concat(F.expr("left(head, length(head) - 1)"), F.lit(',"children":'), F.coalesce("children", F.lit("[]")), F.lit("}"))
    dirs = read(spark, sf_dir, "nation").join(files, "n_nationkey", "left").withColumn("head", head).withColumn("node", held)
    return dirs.groupBy(F.col("n_regionkey").alias("region")).agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("node")), ","), F.lit("]")).alias("tree"))


_SQL_PATHS = "SELECT n_regionkey AS region, '/' || n_name || '/' || s_name AS path, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey"


@family.add("tree_files", f"SELECT region, path, s_suppkey AS size, NULL::VARCHAR AS md5 FROM ({_SQL_PATHS}) UNION ALL SELECT n_regionkey, '/' || n_name, NULL, md5(n_name) FROM nation WHERE n_nationkey % 3 = 0")
def tree_files(spark, sf_dir):
    """File rows of content trees; archives listed as directories keep a row of their own."""
    return history.tree_files(history.flatten_tree(_trees(spark, sf_dir), "region", "tree")).select("region", "path", "size", "md5")


@family.add("tree_dates", f"SELECT region, path, '2000-01-' || lpad((1 + s_suppkey % 28)::VARCHAR, 2, '0') AS date FROM ({_SQL_PATHS})")
def tree_dates(spark, sf_dir):
    return history.tree_dates(history.flatten_tree(_trees(spark, sf_dir), "region", "tree"), "region")


@family.add("game_slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') || '--' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def game_slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.game_slug(F.col("p_name"), F.col("p_brand")).alias("slug"))


@family.add(
    "build_dates",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'spring ' || year(o_orderdate) END END AS build_date FROM orders""",
)
def build_dates(spark, sf_dir):
    """A volume's date or else the header's, eight digits with hyphens."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    release = F.when(k % 3 == 1, F.when(k % 2 == 0, day).otherwise(F.concat(F.lit("spring "), F.year("o_orderdate").cast("string"))))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.build_date(F.when(k % 3 == 0, day).otherwise(""), release).alias("build_date"))


QUERIES, ORACLE_SQL = family.queries, family.sql

"""Histories, graphs, upserts, incremental work and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scalars
from ..operators import history, upsert
from ..streaming import jobs
from .registry import Family, read

family = Family()


@family.add(
    "run_islands",
    """
    WITH c AS (SELECT user_id, event_type, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS run FROM c)
    SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY 1, 2, 3
    """,
)
def run_islands(spark, sf_dir):
    return history.islands(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@family.add(
    "first_parent_log",
    "SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER w AS b, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n = 1 OR role IS DISTINCT FROM b",
)
def first_parent_log(spark, sf_dir):
    return history.change_log(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")


_SQL_DAYS = "d AS (SELECT user_id, (ts - INTERVAL 60 MINUTE)::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def _days(spark, sf_dir):
    day = history.local_day(F.unix_timestamp("ts"), F.lit(60))
    return read(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.count("*").alias("n"))


@family.add("daily_activity", f"WITH {_SQL_DAYS} SELECT user_id, day, n FROM d")
def daily_activity(spark, sf_dir):
    return _days(spark, sf_dir)


@family.add(
    "quartile_levels",
    f"""
    WITH {_SQL_DAYS}, l AS (SELECT user_id, list(n ORDER BY n) AS a FROM d GROUP BY 1),
    q AS (SELECT user_id, a[1 + floor(0.25 * (len(a) - 1))::INT] AS q1, a[1 + floor(0.5 * (len(a) - 1))::INT] AS q2, a[1 + floor(0.75 * (len(a) - 1))::INT] AS q3 FROM l)
    SELECT user_id, day, n, (CASE WHEN n <= q1 THEN 1 WHEN n <= q2 THEN 2 WHEN n <= q3 THEN 3 ELSE 4 END)::INTEGER AS level FROM d JOIN q USING (user_id)
    """,
)
def quartile_levels(spark, sf_dir):
    return history.quartile_levels(_days(spark, sf_dir), "user_id", "n").select("user_id", "day", "n", "level")


@family.add(
    "recent_changes_delta",
    "SELECT conv_id, turn, length(text)::INTEGER AS size, (length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0))::INTEGER AS delta FROM conversations",
)
def recent_changes_delta(spark, sf_dir):
    return history.deltas(read(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", "size", "delta")


@family.add(
    "ancestor_closure",
    """
    WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'r' || r_regionkey, 'root' FROM region),
    a AS (SELECT 's' || s_suppkey AS start, 's' || s_suppkey AS id FROM supplier UNION SELECT start, parent FROM a JOIN e ON child = id)
    SELECT start, id FROM a
    """,
)
def ancestor_closure(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations, suppliers, regions = (read(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    edges = nations.select(tag("n", "n_nationkey").alias("child"), tag("r", "n_regionkey").alias("parent"))
    edges = edges.union(suppliers.select(tag("s", "s_suppkey"), tag("n", "s_nationkey"))).union(regions.select(tag("r", "r_regionkey"), F.lit("root")))
    return history.ancestors(edges, suppliers.select(tag("s", "s_suppkey").alias("id")))


@family.add(
    "tree_diff",
    """
    WITH o AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'dir' ELSE 'file' END AS type, p_brand AS oid FROM part WHERE p_partkey % 7 <> 0),
    n AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'dir' ELSE 'file' END AS type, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS oid FROM part WHERE p_partkey % 11 <> 0)
    SELECT 'part/' || coalesce(o.p_partkey, n.p_partkey) AS path, coalesce(o.type, n.type) AS type, CASE WHEN o.oid IS NULL THEN 'add' WHEN n.oid IS NULL THEN 'delete' ELSE 'modify' END AS change
    FROM o FULL JOIN n ON o.p_partkey = n.p_partkey AND o.type = n.type WHERE o.oid IS NULL OR n.oid IS NULL OR o.oid <> n.oid
    """,
)
def tree_diff(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("path", F.concat(F.lit("part/"), F.col("p_partkey").cast("string")))
    kind = lambda k: F.when(F.col("p_size") % k == 0, "dir").otherwise("file").alias("type")
    old = part.where("p_partkey % 7 <> 0").select("path", kind(5), F.col("p_brand").alias("oid"))
    new = part.where("p_partkey % 11 <> 0").select("path", kind(4), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_brand")).alias("oid"))
    return history.tree_diff(old, new)


@family.add(
    "tree_rollup",
    """
    WITH u AS (SELECT list_filter(string_split(regexp_extract(url, '^https?://(.*)$', 1), '/'), lambda x: x <> '') AS parts, octet_length(encode(html)) AS size FROM pages),
    d AS (SELECT '/' || array_to_string(parts[1:i], '/') AS dir, size FROM (SELECT parts, size, unnest(range(0, len(parts))) AS i FROM u))
    SELECT dir, count(*) AS file_count, sum(size)::BIGINT AS total_size FROM d GROUP BY dir
    """,
)
def tree_rollup(spark, sf_dir):
    files = read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://(.*)$", 1).alias("path"), F.octet_length("html").alias("size"))
    return history.subtree_totals(files, "path", "size")


@family.add("blame_hunks")
def blame_hunks(spark, sf_dir):
    """Each conversation as a file whose versions are its turns (tested on fixtures)."""
    return history.blame(read(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


_SQL_OLD = "o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0)"
_SQL_NEW = "n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0)"


def _old_new(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = orders.where("o_orderkey % 5 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return orders.where("o_orderkey % 3 <> 0"), new


@family.add("upsert_coalesce", f"WITH {_SQL_OLD}, {_SQL_NEW} SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice FROM o FULL JOIN n USING (o_orderkey)")
def upsert_coalesce(spark, sf_dir):
    return upsert.coalesce_update(*_old_new(spark, sf_dir), ["o_orderkey"])


@family.add("upsert_anti_union", f"WITH {_SQL_OLD}, {_SQL_NEW} SELECT * FROM o ANTI JOIN n USING (o_orderkey) UNION ALL SELECT * FROM n")
def upsert_anti_union(spark, sf_dir):
    return upsert.replace_by_key(*_old_new(spark, sf_dir), ["o_orderkey"])


@family.add("insert_missing", f"WITH {_SQL_OLD}, {_SQL_NEW} SELECT * FROM o UNION ALL SELECT * FROM n ANTI JOIN o USING (o_orderkey)")
def insert_missing(spark, sf_dir):
    return upsert.insert_missing(*_old_new(spark, sf_dir), ["o_orderkey"])


@family.add("changed_only", f"WITH {_SQL_OLD}, {_SQL_NEW} SELECT n.* FROM n LEFT JOIN o USING (o_orderkey) WHERE o.o_orderkey IS NULL OR n.o_orderstatus IS DISTINCT FROM o.o_orderstatus OR n.o_totalprice IS DISTINCT FROM o.o_totalprice")
def changed_only(spark, sf_dir):
    return upsert.changed_only(*_old_new(spark, sf_dir), ["o_orderkey"])


@family.add(
    "guarded_update",
    f"WITH {_SQL_OLD}, {_SQL_NEW} SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NOT NULL THEN n.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, o.o_totalprice, n.o_orderkey IS NOT NULL AND n.o_orderstatus IS DISTINCT FROM o.o_orderstatus AS updated FROM o LEFT JOIN n USING (o_orderkey)",
)
def guarded_update(spark, sf_dir):
    return upsert.guarded_update(*_old_new(spark, sf_dir), ["o_orderkey"], "o_orderstatus")


@family.add(
    "submission_kinds",
    """SELECT c_custkey::VARCHAR AS sha, c_name AS name, CASE WHEN s_suppkey IS NULL THEN 'new' WHEN c_name <> s_name THEN 'duplicate' ELSE 'known' END AS kind FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
)
def submission_kinds(spark, sf_dir):
    submitted = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("sha"), F.col("c_name").alias("name"))
    builds = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("sha"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("alt_name"))
    return upsert.submission_kind(submitted, builds)


@family.add("rate_limit_window", "SELECT user_id, start, n, n - 2 AS rejected FROM (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 2")
def rate_limit_window(spark, sf_dir):
    return jobs.over_limit(jobs.window_counts(read(spark, sf_dir, "events"), "ts", "user_id", "6 hours"), 2)


@family.add(
    "session_counts",
    """
    WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS c FROM events),
    r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM s)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM r GROUP BY user_id, g
    """,
)
def session_counts(spark, sf_dir):
    return jobs.session_counts(read(spark, sf_dir, "events"), "ts", "user_id", "12 hours")


@family.add("latest_per_user", "SELECT user_id AS title, event_id AS rev_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type <> 'error') WHERE rn = 1")
def latest_per_user(spark, sf_dir):
    changes = read(spark, sf_dir, "events").where("event_type <> 'error'").select(F.lit(0).alias("ns"), F.col("user_id").alias("title"), F.col("event_id").alias("rev_id"), "ts")
    return jobs.latest_per_title(changes).select("title", "rev_id")


@family.add(
    "moderation_status",
    """
    WITH e AS (SELECT user_id AS id, event_id, CASE WHEN event_id % 17 = 0 THEN 'reject' WHEN event_id % 5 = 0 THEN 'amend' ELSE 'view' END AS a FROM events)
    SELECT id, CASE WHEN bool_or(a = 'reject') THEN 'rejected' WHEN bool_or(a = 'amend') THEN 'amended' ELSE 'auto' END AS status FROM e GROUP BY id
    """,
)
def moderation_status(spark, sf_dir):
    action = F.when(F.col("event_id") % 17 == 0, "reject").when(F.col("event_id") % 5 == 0, "amend").otherwise("view")
    return jobs.moderate(read(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), action.alias("action")))


@family.add(
    "invalidated_pages",
    "SELECT DISTINCT user_id AS page_id FROM events WHERE event_type || ':' || (event_id % 50) IN (SELECT event_type || ':' || (event_id % 50) FROM events WHERE event_id < 20)",
)
def invalidated_pages(spark, sf_dir):
    from ..plans.objects import invalidated

    tagged = read(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), "event_id", F.concat_ws(":", "event_type", (F.col("event_id") % 50).cast("string")).alias("tag"))
    return invalidated(tagged.where("event_id < 20"), tagged.select("page_id", "tag"))


_SQL_RAW = "r AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 6 WHEN 0 THEN strftime(l_shipdate, '%Y') WHEN 1 THEN strftime(l_shipdate, '%Y-%m') WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 3 THEN strftime(l_shipdate, '%Y-13-%d') WHEN 4 THEN strftime(l_shipdate, '%Y-02-30') ELSE 'n/a' END AS raw FROM lineitem)"


@family.add(
    "partial_date_parse",
    f"""WITH {_SQL_RAW} SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(raw, '^[0-9]{{4}}$') THEN try_cast(raw || '-01-01' AS DATE) WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}$') THEN try_cast(raw || '-01' AS DATE) ELSE try_cast(raw AS DATE) END AS day FROM r""",
)
def partial_date_parse(spark, sf_dir):
    n, d = F.col("l_linenumber") % 6, lambda f: F.date_format("l_shipdate", f)
    raw = F.when(n == 0, d("yyyy")).when(n == 1, d("yyyy-MM")).when(n == 2, d("yyyy-MM-dd")).when(n == 3, F.concat(d("yyyy"), F.lit("-13-"), d("dd"))).when(n == 4, F.concat(d("yyyy"), F.lit("-02-30"))).otherwise("n/a")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", scalars.partial_date(F.col("raw")).alias("day"))


@family.add(
    "guarded_num",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN '-' || o_custkey || '.25' WHEN 2 THEN '+' || o_custkey WHEN 3 THEN o_custkey || 'e3' ELSE ' ' || o_custkey END AS raw FROM orders)
       SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^-?[0-9]+(\\.[0-9]+)?$') THEN raw::DOUBLE END AS num FROM r""".replace("\\\\", "\\"),
)
def guarded_num(spark, sf_dir):
    n, c = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    raw = F.when(n == 0, c).when(n == 1, F.concat(F.lit("-"), c, F.lit(".25"))).when(n == 2, F.concat(F.lit("+"), c)).when(n == 3, F.concat(c, F.lit("e3"))).otherwise(F.concat(F.lit(" "), c))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.strict_num(raw).alias("num"))


@family.add(
    "fuzzy_dates",
    """WITH r AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 4 AS n FROM orders)
       SELECT o_orderkey, CASE n WHEN 3 THEN strftime(d, '%Y-%m') ELSE strftime(d, '%Y-%m-%d') END AS iso FROM r""",
)
def fuzzy_dates(spark, sf_dir):
    """Order dates written out in four ways, read back."""
    n, d = F.col("o_orderkey") % 4, lambda f: F.date_format("o_orderdate", f)
    raw = F.when(n == 0, d("MMMM d, yyyy")).when(n == 1, F.concat(d("d"), F.lit("th "), d("MMM yyyy"), F.lit(" 10:30"))).when(n == 2, d("yyyy/MM/dd")).otherwise(d("MMMM yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalars.fuzzy_date(raw).alias("iso"))


@family.add("name_slugs", "SELECT p_partkey, left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS slug FROM part")
def name_slugs(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalars.slugify(F.col("p_name")).alias("slug"))


@family.add("natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS place FROM part")
def natural_order(spark, sf_dir):
    """Parts in natural order of 'item <key>', which is the order of their keys; ranges are numbered without one global sort task."""
    keyed = read(spark, sf_dir, "part").select("p_partkey", scalars.natural_key(F.concat(F.lit("Item "), F.col("p_partkey").cast("string"))).alias("k"))
    bucket = F.substring("k", -20, 14)  # a hundred thousand... of neighbouring numbers share it
    sizes = keyed.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    starts = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("b").orderBy("k"))
    return keyed.withColumn("b", bucket).join(starts, "b").select("p_partkey", (F.col("before") + place).cast("long").alias("place"))


@family.add(
    "record_errors",
    """SELECT doc_id, CASE WHEN n_chars > 200000 THEN 'too many: n_files' WHEN n_chars > 4096 THEN 'too many: n_slots' END AS error FROM documents""",
)
def record_errors(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("n_files"), F.col("n_chars").alias("n_slots"))
    return rows.select("doc_id", markup.record_error(rows.columns).alias("error"))


@family.add(
    "snapshot_listing",
    """
    SELECT r_name AS path, 'tree' AS type, 'r' || r_regionkey AS oid FROM region
    UNION ALL SELECT r_name || '/' || n_name, 'tree', 'n' || n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey
    UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, 'blob', 's' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)
def snapshot_listing(spark, sf_dir):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nations, suppliers, regions = (read(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    entries = regions.select(F.lit("root").alias("tree"), F.col("r_name").alias("name"), F.lit("tree").alias("type"), tag("r", "r_regionkey").alias("oid"))
    entries = entries.union(nations.select(tag("r", "n_regionkey"), "n_name", F.lit("tree"), tag("n", "n_nationkey"))).union(suppliers.select(tag("n", "s_nationkey"), "s_name", F.lit("blob"), tag("s", "s_suppkey")))
    return history.snapshot(entries, "root")


@family.add(
    "year_grid",
    """
    WITH y AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders), d AS (SELECT year, unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY))::DATE AS day FROM y)
    SELECT year, day, ((dayofyear(day) - 1 + dayofweek(make_date(year, 1, 1))) // 7)::INTEGER AS week, dayofweek(day)::INTEGER AS dow FROM d
    """,
)
def year_grid(spark, sf_dir):
    return history.year_grid(read(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct())


QUERIES, ORACLE_SQL = family.queries, family.sql

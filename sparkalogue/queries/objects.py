"""The object query language over the events table: every event is an object of its type's component."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.objects import Attribute, ObjectQuery, Registry, compile_query, matching
from .registry import Family, read

family = Family()

REGISTRY = Registry({"event": {"k": Attribute("number"), "label": Attribute("string"), "tags": Attribute("string", multi=True), "day": Attribute("date"), "note": Attribute("string")}})

#: The same objects in SQL: some members are missing by event_id, as in schemaless data.
_SQL_BASE = """
    WITH o AS (SELECT event_id AS page_id, 0 AS ordinal, event_type AS component, (props::JSON ->> '$.k') AS k,
                      CASE WHEN event_id % 4 <> 0 THEN event_type || '-' || (event_id % 7) END AS label,
                      CASE WHEN event_id % 5 <> 0 THEN [event_type, 'u' || (user_id % 3)] END AS tags,
                      CASE WHEN event_id % 6 = 0 THEN strftime(ts, '%Y-%m') WHEN event_id % 6 = 1 THEN 'soon' ELSE strftime(ts, '%Y-%m-%d') END AS day,
                      event_id % 3 = 0 AS has_note, event_id, user_id FROM events WHERE user_id % 11 <> 0 AND event_id % 13 <> 0)
"""


def _objects(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    data = F.to_json(F.struct(
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(i % 4 != 0, F.concat(kind, F.lit("-"), (i % 7).cast("string"))).alias("label"),
        F.when(i % 5 != 0, F.array(kind, F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))).alias("tags"),
        F.when(i % 6 == 0, F.date_format("ts", "yyyy-MM")).when(i % 6 == 1, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.when(i % 3 == 0, "").alias("note"),
    ))
    objects = events.select(i.alias("page_id"), F.lit("event").alias("component"), F.lit(0).alias("ordinal"), data.alias("data"))
    pages = events.select(
        i.alias("page_id"), F.lit("main").alias("ns"), F.format_string("%012d", i).alias("slug"), kind.alias("title"), F.col("ts").alias("created"), F.col("ts").alias("modified"),
        F.when(i % 13 == 0, F.col("ts")).alias("deleted_at"), F.lit(False).alias("is_redirect"), F.when(F.col("user_id") % 11 == 0, "hidden").otherwise("public").alias("visibility"),
    )
    return objects, pages


def _run(spark, sf_dir, **query):
    return compile_query(REGISTRY, ObjectQuery(components=["event"], **query), *_objects(spark, sf_dir))


def _rows(name: str, where: dict, condition: str) -> None:
    """Register a condition over all objects; the sorted queries below show the limit and its flag."""

    @family.add(f"dsl_{name}", f"{_SQL_BASE} SELECT page_id FROM o WHERE {condition}")
    def query(spark, sf_dir):
        return matching(REGISTRY, ObjectQuery(components=["event"], where=where), *_objects(spark, sf_dir)).select("page_id")


_DAY = "(CASE WHEN regexp_matches(day, '^[0-9]{4}-[0-9]{2}$') THEN (day || '-01')::DATE WHEN regexp_matches(day, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN day::DATE END)"
_rows("eq", {"label": "click-3"}, "label = 'click-3'")
_rows("eq_multi", {"tags": "u1"}, "list_contains(tags, 'u1')")
_rows("ne", {"label": {"ne": "click-3"}}, "label IS DISTINCT FROM 'click-3'")
_rows("ne_multi", {"tags": {"ne": "u1"}}, "NOT list_contains(tags, 'u1')")
_rows("in", {"label": {"in": ["click-1", "view-2", "purchase-5"]}}, "label IN ('click-1', 'view-2', 'purchase-5')")
_rows("in_multi", {"tags": {"in": ["u0", "u2"]}}, "list_has_any(tags, ['u0', 'u2'])")
_rows("range", {"k": {"gte": 20, "lt": 60}}, "k::DOUBLE >= 20 AND k::DOUBLE < 60")
_rows("date_range", {"day": {"gt": "2024-01-10", "lte": "2024-01-20"}}, f"{_DAY} > DATE '2024-01-10' AND {_DAY} <= DATE '2024-01-20'")
_rows("like", {"label": {"like": "C*K-*"}}, "regexp_matches(lower(label), '^c.*k-.*$')")
_rows("exists", {"note": {"exists": True}}, "has_note")
_rows("not_exists", {"note": {"exists": False}}, "NOT has_note")
_rows("bool", {"or": [{"k": {"gt": 90}}, {"and": [{"label": {"like": "view*"}}, {"not": {"tags": "u0"}}]}]}, "k::DOUBLE > 90 OR (regexp_matches(lower(label), '^view.*$') AND NOT list_contains(tags, 'u0'))")


@family.add("dsl_agg", f"{_SQL_BASE} SELECT count(*) AS n, min(k::DOUBLE) AS min_k, max({_DAY}) AS last_day FROM o")
def dsl_agg(spark, sf_dir):
    return _run(spark, sf_dir, aggs=[{"fn": "count", "as": "n"}, {"fn": "min", "field": "k"}, {"fn": "max", "field": "day", "as": "last_day"}])


@family.add("dsl_groupby", f"{_SQL_BASE} SELECT label, count(*) AS n, max(k::DOUBLE) AS max_k FROM o GROUP BY label ORDER BY label NULLS LAST LIMIT 200")
def dsl_groupby(spark, sf_dir):
    return _run(spark, sf_dir, aggs=[{"fn": "count", "as": "n"}, {"fn": "max", "field": "k"}], group_by="label")


@family.add("dsl_sort_truncated", f"{_SQL_BASE} SELECT page_id, label, count(*) OVER () > 100 AS truncated FROM o WHERE k::DOUBLE > 50 ORDER BY label DESC NULLS LAST, page_id LIMIT 100")
def dsl_sort_truncated(spark, sf_dir):
    rows = _run(spark, sf_dir, where={"k": {"gt": 50}}, select=["label"], sort=[("label", "desc")], limit=100)
    return rows.select("page_id", F.get_json_object("data", "$.label").alias("label"), "truncated")


@family.add("dsl_pseudo_sort", f"{_SQL_BASE} SELECT page_id FROM o JOIN events e ON e.event_id = page_id ORDER BY e.ts DESC, page_id LIMIT 150")
def dsl_pseudo_sort(spark, sf_dir):
    return _run(spark, sf_dir, sort=[("_created", "desc")], limit=150).select("page_id")


QUERIES, ORACLE_SQL = family.queries, family.sql

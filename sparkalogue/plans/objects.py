"""Queries over schemaless objects: a declared registry of components, and a compiler to DataFrames.

An object is a row (page_id, component, ordinal, data) whose data is a JSON object; pages
are rows (page_id, ns, slug, title, created, modified, deleted_at, is_redirect, visibility).
A query names components, a condition tree over declared fields, and either fields to
select or aggregates. It compiles to one DataFrame; the optimizer does the rest.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import partial_date, strict_num

#: Most rows of a query, rows when none are asked for, and depth of a condition tree.
MAX_LIMIT, DEFAULT_LIMIT, MAX_DEPTH = 5000, 200, 64
#: Sort kind of each declared type.
KINDS = {"string": "text", "number": "numeric", "boolean": "text", "date": "date", "enum": "text", "markdown": "text", "media": "text", "page": "text", "json": "text"}
PSEUDO = {"_page_title": "title", "_page_slug": "slug", "_created": "created", "_modified": "modified"}
OPERATORS = ("eq", "ne", "in", "gt", "gte", "lt", "lte", "like", "exists")


class QueryError(ValueError):
    """A query that the registry doesn't allow."""


@dataclass(frozen=True)
class Attribute:
    type: str = "string"
    multi: bool = False

    @property
    def kind(self) -> str:
        return KINDS[self.type]


@dataclass
class Registry:
    """Components by name, each with its attributes by snake-case key."""

    components: dict[str, dict[str, Attribute]]

    def fields(self, names: list[str]) -> dict[str, Attribute]:
        """Union of the components' attributes; the first component wins."""
        out: dict[str, Attribute] = {}
        for n in names:
            if n not in self.components:
                raise QueryError(f"unknown component {n!r}; known: {', '.join(sorted(self.components))}")
            for k, a in self.components[n].items():
                out.setdefault(k, a)
        return out


@dataclass
class ObjectQuery:
    components: list[str]
    where: dict[str, Any] | None = None
    select: list[str] = field(default_factory=list)
    sort: list[tuple[str, str]] = field(default_factory=list)  # (field, asc | desc)
    aggs: list[dict[str, str]] = field(default_factory=list)  # fn, field, as
    group_by: str | None = None
    limit: int | None = None
    offset: int = 0
    page: tuple[str, str] | None = None
    include_hidden: bool = False


def snake_case(name: str) -> str:
    return re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower()


def parse_sort(text: str) -> list[tuple[str, str]]:
    """'a,-b' as ascending a, then descending b."""
    return [(p[1:], "desc") if p.startswith("-") else (p, "asc") for p in map(str.strip, text.split(",")) if p]


def _text(key: str) -> Column:
    """Text of a scalar member as the JSON has it; null if missing or JSON null."""
    return F.get_json_object("data", f"$.{key}")


def _items(key: str) -> Column:
    return F.from_json(_text(key), "array<string>")


def _operand(v: Any) -> str:
    return {True: "true", False: "false"}.get(v, str(v)) if isinstance(v, bool) else str(v)


def _typed(c: Column, kind: str) -> Column:
    return {"numeric": strict_num, "date": partial_date}.get(kind, lambda x: x)(c)


def _lookup(fields: dict[str, Attribute], name: str) -> Attribute:
    if name not in fields:
        raise QueryError(f"unknown field {name!r}; known: {', '.join(sorted(fields))}")
    return fields[name]


def compile_operator(key: str, a: Attribute, op: str, value: Any) -> Column:
    """Condition of one operator. A missing member never equals; `ne` holds for it on a scalar and not on a list."""
    text = _text(key)
    if op == "exists":
        there = F.coalesce(F.array_contains(F.json_object_keys("data"), key), F.lit(False))
        return there if value else ~there
    if op == "eq":
        return F.array_contains(_items(key), _operand(value)) if a.multi else text == _operand(value)
    if op == "ne":
        return ~F.array_contains(_items(key), _operand(value)) if a.multi else ~text.eqNullSafe(F.lit(_operand(value)))
    if op == "in":
        if not isinstance(value, list) or not value:
            raise QueryError("in needs a list of values")
        wanted = [_operand(v) for v in value]
        return F.arrays_overlap(_items(key), F.array(*map(F.lit, wanted))) if a.multi else text.isin(wanted)
    if op == "like":
        if a.multi or a.type not in ("string", "markdown", "page", "enum"):
            raise QueryError(f"like doesn't apply to {key!r}")
        literal = [re.escape(p) for p in str(value).lower().split("*")]
        return F.lower(text).rlike("^(?s)" + ".*".join(literal) + "$")
    if op in ("gt", "gte", "lt", "lte"):
        if a.multi:
            raise QueryError(f"{op} doesn't apply to a list")
        compare = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}[op]
        return compare(_typed(text, a.kind), _typed(F.lit(_operand(value)), a.kind))
    raise QueryError(f"unknown operator {op!r}; known: {', '.join(OPERATORS)}")


def compile_where(tree: dict[str, Any], fields: dict[str, Attribute], level: int = 0) -> Column:
    """Condition of a tree of and / or / not and fields; the members of one object are joined by and."""
    if level > MAX_DEPTH:
        raise QueryError("condition is nested too deeply")
    if not isinstance(tree, dict) or not tree:
        raise QueryError("a condition must be an object with members")
    parts = []
    for name, v in tree.items():
        if name in ("and", "or"):
            if not isinstance(v, list) or not v:
                raise QueryError(f"{name} needs a list of conditions")
            inner = [compile_where(x, fields, level + 1) for x in v]
            parts.append(functools.reduce(operator.and_ if name == "and" else operator.or_, inner))
        elif name == "not":
            parts.append(~compile_where(v, fields, level + 1))
        else:
            a = _lookup(fields, name)
            ops = v if isinstance(v, dict) else {"eq": v}
            if not ops:
                raise QueryError(f"no operator for {name!r}")
            parts += [compile_operator(name, a, op, x) for op, x in ops.items()]
    return functools.reduce(operator.and_, parts)


def _value(name: str, fields: dict[str, Attribute], typed: bool = True) -> Column:
    """A field's value for sorting and aggregating; pseudo fields come from the page."""
    if name in PSEUDO:
        return F.col(PSEUDO[name])
    a = _lookup(fields, name)
    return _typed(_text(name), a.kind) if typed else _text(name)


def matching(registry: Registry, q: ObjectQuery, objects: DataFrame, pages: DataFrame) -> DataFrame:
    """All rows that the query's scope and conditions leave, in no order and without a limit, with their page's columns."""
    fields = registry.fields(q.components)
    scope = (F.col("deleted_at").isNull()) & ~F.col("is_redirect")
    if not q.include_hidden:
        scope = scope & (F.col("visibility") == "public")
    if q.page:
        scope = scope & (F.col("ns") == q.page[0]) & (F.col("slug") == q.page[1])
    rows = objects.where(F.col("component").isin(q.components)).join(pages.where(scope), "page_id")
    return rows if q.where is None else rows.where(compile_where(q.where, fields))


def compile_query(registry: Registry, q: ObjectQuery, objects: DataFrame, pages: DataFrame) -> DataFrame:
    """The query's rows: (page_id, ordinal, data, truncated), or the groups of an aggregate.

    A row query fetches one row beyond its limit; `truncated` on every row tells whether there
    was one. Sorting puts nulls last in both directions and ends with slug and ordinal.
    """
    fields = registry.fields(q.components)
    rows = matching(registry, q, objects, pages)
    limit = min(MAX_LIMIT, max(1, q.limit or DEFAULT_LIMIT))
    if q.aggs:
        made = []
        for a in q.aggs:
            fn, name = a["fn"], a.get("field")
            if fn not in ("count", "min", "max"):
                raise QueryError(f"unknown aggregate {fn!r}")
            if fn != "count" and not name:
                raise QueryError(f"{fn} needs a field")
            alias = re.sub(r"[^A-Za-z0-9_]", "_", a.get("as") or "_".join(filter(None, (fn, name))))
            made.append((F.count("*") if fn == "count" else getattr(F, fn)(_value(name, fields))).alias(alias))
        if not q.group_by:
            return rows.agg(*made)
        key = _value(q.group_by, fields, typed=False).alias(q.group_by)
        return rows.groupBy(key).agg(*made).orderBy(F.col(q.group_by).asc_nulls_last()).limit(limit)
    order = [(_value(n, fields).desc_nulls_last() if way == "desc" else _value(n, fields).asc_nulls_last()) for n, way in q.sort]
    order += [F.col("slug").asc_nulls_last(), F.col("ordinal").asc_nulls_last()]
    if q.select:
        for n in q.select:
            if n not in PSEUDO:
                _lookup(fields, n)
        # lists keep their JSON text; pseudo fields project null
        shown = F.to_json(F.struct(*[(F.lit(None).cast("string") if n in PSEUDO else _items(n) if fields[n].multi else _text(n)).alias(n) for n in q.select]), {"ignoreNullFields": "false"})
    else:
        shown = F.col("data")
    fetched = rows.orderBy(*order).offset(max(0, q.offset)).limit(limit + 1)
    from pyspark.sql import Window

    numbered = fetched.select("page_id", "ordinal", shown.alias("data"), F.row_number().over(Window.orderBy(*order)).alias("_n"))
    held = numbered.withColumn("truncated", F.max("_n").over(Window.partitionBy(F.lit(1))) > limit)
    return held.where(F.col("_n") <= limit).drop("_n")


def from_tag(attrs: dict[str, str]) -> ObjectQuery:
    """Query of a page's query tag: formats count, earliest and latest become aggregates."""
    form = attrs.get("format", "table")
    q = ObjectQuery(components=[c.strip() for c in attrs["from"].split(",")])
    q.where = {k[2:]: v for k, v in attrs.items() if k.startswith("w:")} or None
    q.sort = parse_sort(attrs.get("sort", ""))
    q.limit = int(attrs["limit"]) if attrs.get("limit") else None
    if form == "count":
        q.aggs = [{"fn": "count", "as": "count"}]
    elif form in ("earliest", "latest"):
        if not attrs.get("of"):
            raise QueryError(f"{form} needs 'of'")
        q.aggs = [{"fn": "min" if form == "earliest" else "max", "field": attrs["of"], "as": form}]
    elif form not in ("table", "ul", "inline", "render"):
        raise QueryError(f"unknown format {form!r}")
    if attrs.get("select"):
        q.select = [s.strip() for s in attrs["select"].split(",")]
    return q


def invalidated(tags: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Distinct pages whose saved queries depend on a changed tag; tags (tag), dependencies (page_id, tag)."""
    return dependencies.join(tags.select("tag").distinct(), "tag", "left_semi").select("page_id").distinct()


def normalize_attribute(a: Attribute, raw: Column, default: Any = None) -> Column:
    """A written attribute as stored text; null where it doesn't fit its type. Lists split at commas."""
    text = F.coalesce(F.trim(raw), F.lit(default).cast("string"))
    if a.multi:
        return F.to_json(F.filter(F.transform(F.split(text, ","), F.trim), lambda x: x != ""))
    if a.type == "number":
        return F.when(strict_num(text).isNotNull(), text)
    if a.type == "date":
        return F.when(partial_date(text).isNotNull(), text)
    if a.type == "boolean":
        return F.when(F.lower(text).isin("true", "yes", "1"), "true").when(F.lower(text).isin("false", "no", "0"), "false")
    return F.when(text != "", text)


def attribute_errors(fields: dict[str, Attribute], raw: Column, required: frozenset[str] = frozenset()) -> Column:
    """What is wrong with a map of written attributes, as a sorted array: unknown names, required ones without a value, values that don't fit their type."""
    names = sorted(fields)
    written = F.map_keys(F.coalesce(raw, F.create_map().cast("map<string,string>")))
    unknown = F.transform(F.array_except(written, F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")), lambda n: F.concat(F.lit("unknown: "), n))
    value = lambda n: F.element_at(raw, F.lit(n))
    empty = lambda n: F.coalesce(F.trim(value(n)), F.lit("")) == ""
    checks = [F.when(empty(n), F.lit(f"missing: {n}")) for n in names if n in required]
    checks += [F.when(~empty(n) & normalize_attribute(fields[n], value(n)).isNull(), F.lit(f"bad value: {n}")) for n in names if not fields[n].multi]
    return F.array_sort(F.concat(unknown, F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")))

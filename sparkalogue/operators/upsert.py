"""Upserts as functions from (stored, incoming) to the new table; there is no table format with transactions here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replace_by_key(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows replace stored rows of their keys."""
    return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def replace_derived(stored: DataFrame, saved: DataFrame, derived: DataFrame, key: str) -> DataFrame:
    """A page save's derived rows: those of the saved keys go, the new ones come; a key saved without any keeps none."""
    return stored.join(saved.select(key).distinct(), key, "left_anti").unionByName(derived.join(saved.select(key).distinct(), key, "left_semi"))


def save_pages(stored: dict[str, DataFrame], saved: DataFrame, derived: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """All derived tables (objects, categories, links, ...) after one save: each as by replace_derived, those without new rows too."""
    return {name: replace_derived(table, saved, derived[name] if name in derived else table.where("false"), key) for name, table in stored.items()}


def delete_pages(pages: DataFrame, tables: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Pages (key, deleted, ...) with those of `gone` marked as deleted, and the derived tables without their rows; unknown and deleted ones change nothing."""
    live = pages.where("not coalesce(deleted, false)").select(key).join(gone.select(key).distinct(), key, "left_semi").withColumn("_gone", F.lit(True))
    marked = pages.join(live, key, "left").withColumn("deleted", F.coalesce("_gone", "deleted")).select(*pages.columns)
    return marked, {name: table.join(live, key, "left_anti") for name, table in tables.items()}


def move_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """pages (slug, redirect_to, deleted, ...) after moves (slug, new_slug): the page under its new slug, a redirect under the old one.

    Deleted pages and unknown slugs don't move, nor does a page onto the slug of a live page, moving
    or not. Of the moves left, a page's first by new slug counts, and of several onto one slug that
    of the first page by slug.
    """
    live = pages.where("not coalesce(deleted, false)").select("slug").distinct()
    valid = moves.where("new_slug is not null").join(live, "slug", "left_semi").join(live.withColumnRenamed("slug", "new_slug"), "new_slug", "left_anti")
    chosen = valid.groupBy("slug").agg(F.min("new_slug").alias("new_slug")).groupBy("new_slug").agg(F.min("slug").alias("slug"))
    marked = pages.join(chosen, "slug", "left").withColumn("moves", F.col("new_slug").isNotNull() & ~F.coalesce("deleted", F.lit(False)))
    stay = marked.select(*[F.when(F.col("moves"), F.col("new_slug")).otherwise(F.col(c)).alias(c) if c == "slug" else F.col(c) for c in pages.columns])
    held = {"slug": F.col("slug"), "redirect_to": F.col("new_slug"), "deleted": F.lit(False)}
    left = marked.where("moves").select(*[held[c].cast(pages.schema[c].dataType).alias(c) if c in held else F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in pages.columns])
    return stay.unionByName(left)


def drop_automatic(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows without the automatic ones (source = 'auto') of the given keys; rows that a person made or changed stay."""
    gone = F.coalesce(F.col("source") == "auto", F.lit(False))
    return rows.where(~gone).unionByName(rows.where(gone).join(keys.select(key).distinct(), key, "left_anti"))


def coalesce_update(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming values where they are given, else the stored ones; unknown keys are inserted."""
    values = [c for c in stored.columns if c not in keys]
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values if c in incoming.columns])
    joined = stored.join(new, keys, "full")
    pick = [F.coalesce(f"_new_{c}", c).alias(c) if c in incoming.columns else F.col(c) for c in values]
    return joined.select(*keys, *pick)


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows and the incoming rows of keys not there yet."""
    return stored.unionByName(incoming.join(stored.select(*keys).distinct(), keys, "left_anti").dropDuplicates(keys))


def changed_only(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows that are new or differ from the stored row in some column (nulls compare equal)."""
    values = [c for c in incoming.columns if c not in keys]
    same = F.lit(True)
    for c in values:
        same = same & F.col(f"i.{c}").eqNullSafe(F.col(f"s.{c}"))
    s = stored.withColumn("_there", F.lit(True)).alias("s")
    on = [F.col(f"i.{k}") == F.col(f"s.{k}") for k in keys]
    joined = incoming.alias("i").join(s, on, "left")
    return joined.where(F.col("s._there").isNull() | ~same).select("i.*")


def guarded_update(stored: DataFrame, changes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """One column set from changes, with `updated`: whether it became another value."""
    new = changes.select(*keys, F.col(column).alias("_v"), F.lit(True).alias("_hit"))
    joined = stored.join(new, keys, "left")
    differs = F.col("_hit").isNotNull() & ~F.col("_v").eqNullSafe(F.col(column))
    return joined.withColumn("updated", F.coalesce(differs, F.lit(False))).withColumn(column, F.when(F.col("updated"), F.col("_v")).otherwise(F.col(column))).drop("_v", "_hit")


#: Number series for new ids; each counts on its own, so no window holds all new rows.
ID_SERIES = 256


def get_or_create(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """stored (id, name, system, slug) with a row for each wanted (name, system), and a slug for every row.

    New ids lie above all stored ones, not gapless. A row without a slug takes that of its name and
    system, or with its id behind it where another row has that slug or, of several rows that need
    it, a smaller id.
    """
    from ..functions.scalars import game_slug

    new = wanted.select("name", F.coalesce("system", F.lit("")).alias("system")).where("name is not null").distinct().join(stored.select("name", "system"), ["name", "system"], "left_anti")
    series = F.conv(F.substring(F.md5(F.concat_ws("\n", "name", "system")), 1, 2), 16, 10).cast("long")
    place = F.row_number().over(Window.partitionBy("series").orderBy("name", "system"))
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top"))
    # the one row of the largest id goes to every new row
    made = new.withColumn("series", series).withColumn("n", place).crossJoin(F.broadcast(top)).select((F.col("top") + 1 + F.col("series") + ID_SERIES * (F.col("n") - 1)).alias("id"), "name", "system", F.lit(None).cast("string").alias("slug"))
    every = stored.select(F.col("id").cast("long").alias("id"), "name", "system", "slug").unionByName(made)
    open_rows = every.where("slug is null").withColumn("base", game_slug(F.col("name"), F.col("system")))
    held = every.where("slug is not null").select(F.col("slug").alias("base")).distinct().withColumn("held", F.lit(True))
    first = open_rows.groupBy("base").agg(F.min("id").alias("first"))
    filled = open_rows.join(first, "base").join(held, "base", "left")
    slug = F.when(F.col("held").isNull() & (F.col("id") == F.col("first")), F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("id").cast("string")))
    return every.where("slug is not null").unionByName(filled.select("id", "name", "system", slug.alias("slug")))


def replace_status(stored: DataFrame, incoming: DataFrame, keys: list[str], status: str = "status", only: str = "auto") -> DataFrame:
    """Incoming rows replace stored rows of the same parent keys only where those have the given status; others stay."""
    touched = incoming.select(*keys).distinct()
    stays = stored.where(F.col(status) != only).unionByName(stored.where(F.col(status) == only).join(touched, keys, "left_anti"))
    return stays.unionByName(incoming)


def submission_kind(submitted: DataFrame, builds: DataFrame) -> DataFrame:
    """Kind of each submission (sha, name): new, duplicate (known sha, other name) or known."""
    known = builds.select("sha", F.col("name").alias("_n"), F.col("alt_name").alias("_a"))
    other = (F.col("name") != F.col("_n")) & ~F.col("name").eqNullSafe(F.col("_a"))
    kind = F.when(F.col("_n").isNull(), "new").when(other, "duplicate").otherwise("known")
    return submitted.join(known, "sha", "left").select("sha", "name", kind.alias("kind"))


def unique_slugs(rows: DataFrame, slug: Column, id_col: str) -> DataFrame:
    """Rows with a slug; all but the first of equal slugs get their id added."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("_slug").orderBy(id_col))
    return rows.withColumn("_slug", slug).withColumn("slug", F.when(n == 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", F.col(id_col).cast("string")))).drop("_slug")


def field_changes(old: Column, new: Column) -> Column:
    """Map of the fields of two maps that differ, to [old, new]."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.array(a, b))
    return F.map_filter(both, lambda k, v: ~F.get(v, F.lit(0)).eqNullSafe(F.get(v, F.lit(1))))

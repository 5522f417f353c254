"""Catalogue queries: visibility, listings, facets, top one per key, lookups, nested views."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(builds: DataFrame, private_lots: DataFrame) -> DataFrame:
    """Rows neither private nor of a private lot; a null lot is public. builds (private, lot, ...), private_lots (lot)."""
    return builds.where(~F.coalesce("private", F.lit(False))).join(private_lots.select("lot").distinct(), "lot", "left_anti")


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of those conditions that are given."""
    return functools.reduce(operator.and_, [c for c in conditions if c is not None], F.lit(True))


def page(df: DataFrame, order: list[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """One page: limit within 1 .. 500, offset 0 at least; `order` must be total."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(500, max(1, limit)))


def keyset_page(df: DataFrame, key: str, before: int | None, limit: int) -> DataFrame:
    """Rows below the key given, newest first."""
    return (df if before is None else df.where(F.col(key) < before)).orderBy(F.desc(key)).limit(limit)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return top_per(df, keys, 1, *order)


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")


def merge_ranked(first: DataFrame, second: DataFrame, key: str, score: str) -> DataFrame:
    """Best row of each key of two ranked lists; equal scores go to the first list."""
    both = first.withColumn("arm", F.lit(0)).unionByName(second.withColumn("arm", F.lit(1)), allowMissingColumns=True)
    return first_per(both, [key], F.desc(score), F.asc("arm")).drop("arm")


def facets(df: DataFrame, *columns: str) -> DataFrame:
    """(facet, value) of the distinct non-null values of each column, from one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def is_hash(term: str) -> bool:
    """Whether a search term is to be looked up as a hash."""
    return re.fullmatch(r"[0-9a-fA-F]{8,}", term) is not None


def lookup(arms: list[tuple[DataFrame, str]], id_col: str, terms: DataFrame) -> DataFrame:
    """Distinct (term, id) over several (table, hash column) arms; terms (term). Prefixes match in full only."""
    wanted = terms.select(F.lower("term").alias("term")).distinct()
    out = None
    for df, column in arms:
        hit = df.select(F.col(id_col).alias("id"), F.lower(F.col(column)).alias("term")).join(wanted, "term").select("term", "id")
        out = hit if out is None else out.union(hit)
    return out.distinct()


def prefix_matches(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Up to three rows by hash prefix: one means unique. Pushed down to the scan."""
    return df.where(F.col(column).startswith(prefix)).orderBy(column).limit(3)


def nested(parent: DataFrame, child: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Parent rows with an ordered array of their children's fields; an empty array without children."""
    inner = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    kind = inner.schema[name].dataType.simpleString()
    return parent.join(inner, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def usage(labels: DataFrame, uses: DataFrame, key: str, counts_if: Column) -> DataFrame:
    """All labels with the number of uses that count; labels without any keep 0."""
    n = uses.where(counts_if).groupBy(key).agg(F.count("*").alias("n_uses"))
    return labels.join(n, key, "left").withColumn("n_uses", F.coalesce("n_uses", F.lit(0)))


def unique_assignment(items: DataFrame, offers: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, outcome): the value if exactly one is offered, else null; outcome matched, ambiguous or unmatched."""
    seen = items.select(key).distinct().join(offers.select(key, value).distinct(), key, "left").groupBy(key)
    got = seen.agg(F.count(value).alias("n"), F.min(value).alias("one"))
    outcome = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return got.select(key, F.when(F.col("n") == 1, F.col("one")).alias(value), outcome.alias("outcome"))


def resolve_redirects(pages: DataFrame) -> DataFrame:
    """(id, target): a page's own id, or where it redirects in one step if that page exists; else null. pages (id, redirect_to)."""
    there = pages.select(F.col("id").alias("redirect_to"), F.col("id").alias("found"))
    got = pages.join(there, "redirect_to", "left")
    return got.select("id", F.when(F.col("redirect_to").isNull(), F.col("id")).otherwise(F.col("found")).alias("target"))


def composite_digest(files: DataFrame, key: str, digest: str, skip: Column | None = None) -> DataFrame:
    """(key, content_hash): sha256 over the sorted 20-byte digests of a key's files, repeats kept; null without any.

    skip: files left out, as junk is from the filtered digest.
    """
    ok = F.lower(F.col(digest)).rlike("^[0-9a-f]{40}$")
    if skip is not None:
        ok = ok & ~F.coalesce(skip, F.lit(False))
    parts = files.groupBy(key).agg(F.sort_array(F.collect_list(F.when(ok, F.lower(F.col(digest))))).alias("d"))
    return parts.select(key, F.when(F.size("d") > 0, F.sha2(F.unhex(F.array_join("d", "")), 256)).alias("content_hash"))


def extension_histogram(files: DataFrame, key: str, path: str) -> DataFrame:
    """(key, ext, n): files of each extension, in lower case; files without one don't count."""
    from ..functions.scalars import extension

    return files.select(key, extension(F.col(path)).alias("ext")).where("ext is not null").groupBy(key, "ext").agg(F.count("*").alias("n"))


def query_features(records: DataFrame, key: str, record: str) -> DataFrame:
    """What a similarity search needs of a JSON record: hashes, digests, tracks, and the 63-bit ids of its files' sha1, from any depth of its contents.

    Missing parts are null or empty; ids are distinct and ascending.
    """
    from ..functions.scalars import hex_to_id63
    from .history import flatten_tree, tree_files

    form = "struct<image: struct<sha256: string, name: string>, composites: struct<content_hash: string>, exe_fp: struct<imphash: string, tlsh: string>, media: array<struct<kind: string, path: string, audio_fp: array<bigint>>>>"
    parsed = records.select(key, F.from_json(record, form).alias("r"))
    track = lambda m: F.struct(m["path"].alias("track"), m["audio_fp"].alias("subfp"))
    sound = F.transform(F.filter(F.coalesce("r.media", F.array()), lambda m: (m["kind"] == "audio") & (F.size(m["audio_fp"]) > 0)), track)
    heads = parsed.select(key, "r.image.sha256", "r.image.name", "r.composites.content_hash", "r.exe_fp.imphash", "r.exe_fp.tlsh", sound.alias("tracks"))
    files = tree_files(flatten_tree(records.select(key, F.get_json_object(record, "$.contents").alias("contents")), key, "contents"))
    ids = files.select(key, hex_to_id63(F.col("sha1")).alias("i")).where("i is not null").groupBy(key).agg(F.sort_array(F.collect_set("i")).alias("fileset"))
    return heads.join(ids, key, "left").withColumn("fileset", F.coalesce("fileset", F.array().cast("array<bigint>")))


def is_junk(path: Column) -> Column:
    return F.lower(path).rlike("\\.(nfo|diz)$")


def is_crawl_image(path: Column) -> Column:
    """Importable files by extension: everything but texts, pictures and checksums."""
    return ~F.lower(path).rlike("\\.(txt|nfo|diz|jpg|jpeg|png|gif|pdf|md5|sfv|sha1|cue|log)$")


def ordered(df: DataFrame, sort: str | None, direction: str, allowed: dict[str, Column], default: str, nulls_last: frozenset[str], *ties: Column) -> list[Column]:
    """A total order from a whitelist: an unknown sort key is the default, any direction but "desc" ascending.

    Keys of nulls_last have their nulls last in both directions; the others have nulls last ascending and first
    descending, as a row store has. The ties are ascending.
    """
    key = sort if sort in allowed else default
    column, down = allowed[key], direction == "desc"
    if key in nulls_last:
        first = column.desc_nulls_last() if down else column.asc_nulls_last()
    else:
        first = column.desc_nulls_first() if down else column.asc_nulls_last()
    return [first, *[t.asc_nulls_last() for t in ties]]


def having_pairs(df: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, taken together, are among the pairs."""
    return df.join(pairs.select(*keys).distinct(), keys, "left_semi")


def first_arm(arms: list[DataFrame], keys: list[str], *order: Column) -> DataFrame:
    """For each key the first row of the earliest arm that has it."""
    both = None
    for k, arm in enumerate(arms):
        part = arm.withColumn("_arm", F.lit(k))
        both = part if both is None else both.unionByName(part, allowMissingColumns=True)
    return first_per(both, keys, F.asc("_arm"), *order).drop("_arm")


def two_way_difference(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, change): members that were added to or removed from each key's set."""
    o, n = (t.select(key, value).distinct().withColumn(c, F.lit(True)) for t, c in ((old, "_old"), (new, "_new")))
    both = o.join(n, [key, value], "full").where("_old is null or _new is null")
    return both.select(key, value, F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))


def distinct_values(owners: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): the sorted distinct values of every owner, an empty array where it has none."""
    found = rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("values"))
    kind = found.schema["values"].dataType.simpleString()
    return owners.select(key).distinct().join(found, key, "left").withColumn("values", F.coalesce("values", F.array().cast(kind)))


def incomplete_files(files: DataFrame, key: str) -> DataFrame:
    """(key, files, incomplete): files of their own (no directories, no archive members) and those that couldn't be read whole."""
    own = files.where(~F.coalesce("is_dir", F.lit(False)) & ~F.coalesce("in_archive", F.lit(False)))
    return own.groupBy(key).agg(F.count("*").alias("files"), F.count_if(F.coalesce("unreadable", F.lit(False))).alias("incomplete"))


def asset_ok() -> Column:
    """Whether an asset row (path, sha256, mime, kind, size) may be stored: a path, 64 lower-case hex digits, a type, a kind, a finite size."""
    size = F.col("size").cast("double")
    finite = size.isNotNull() & ~F.isnan(size) & (F.abs(size) != float("inf"))
    present = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("path",)] + [F.col(c).isNotNull() for c in ("mime", "kind")]
    return all_of(*present, F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), finite)


def filter_extracts(extracts: DataFrame, equal: dict[str, object] | None = None, span: tuple[str, object, object] | None = None, having: list[tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Extracts by facets: equal columns (None: any), a column from .. to (None: open), and rows in each of the tables of `having` by key."""
    for column, value in (equal or {}).items():
        extracts = extracts if value is None else extracts.where(F.col(column) == value)
    if span:
        column, low, high = span
        extracts = extracts if low is None else extracts.where(F.col(column) >= low)
        extracts = extracts if high is None else extracts.where(F.col(column) <= high)
    for table, key in having or []:
        extracts = extracts.join(table.select(key).distinct(), key, "left_semi")
    return extracts

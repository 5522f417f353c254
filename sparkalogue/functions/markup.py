"""Wiki markup and file records: links, titles, hex dumps, validation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hrefs(html: Column) -> Column:
    """Targets of the links of a page, in order."""
    return F.regexp_extract_all(html, F.lit('<a\\s+href="([^"]*)"'), F.lit(1))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]], labels and fragments dropped."""
    inner = F.regexp_extract_all(text, F.lit("\\[\\[([^\\]|#]+)"), F.lit(1))
    return F.filter(F.transform(inner, F.trim), lambda x: x != "")


def link_edges(pages: DataFrame, id_col: str, links: Column) -> DataFrame:
    """(id, target, n) of the distinct links of each page."""
    return pages.select(F.col(id_col).alias("id"), F.explode(links).alias("target")).groupBy("id", "target").agg(F.count("*").alias("n"))


def template_calls(text: str | None) -> list[tuple[str, dict[str, str]]]:
    """(name, arguments) of the outermost {{calls}} of a text; nested braces and links stay inside an argument."""
    out, depth, start, src = [], 0, 0, text or ""
    for m in re.finditer(r"\{\{|\}\}", src):
        if m[0] == "{{":
            if depth == 0:
                start = m.end()
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                parts, held, level = [], "", 0
                for piece in re.split(r"(\{\{|\}\}|\[\[|\]\]|\|)", src[start : m.start()]):
                    level += (piece in ("{{", "[[")) - (piece in ("}}", "]]"))
                    if piece == "|" and level == 0:
                        parts.append(held)
                        held = ""
                    else:
                        held += piece
                name, *args = [*parts, held]
                named = {}
                for k, a in enumerate(args, 1):
                    key, eq, value = a.partition("=")
                    named[key.strip() if eq else str(k)] = (value if eq else a).strip()
                out.append((name.strip(), named))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType()))])))
def template_calls_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"name": n, "args": a} for n, a in template_calls(t)])


#: Prefixes of titles and their namespaces.
NAMESPACES = {
    "talk": "talk", "user": "user", "user talk": "user_talk", "file": "file", "image": "file", "media": "file", "file talk": "talk", "category": "category", "category talk": "talk",
    "help": "help", "help talk": "talk", "project": "project", "project talk": "talk", "archive": "archive",
}
#: White space of a title, beside what a regex calls so.
_BLANKS = "\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def title_parts(title: Column) -> Column:
    """struct(ns, slug, title, fragment, error) of a written title; error is empty, illegal-char, relative or too-long, and then the rest is null.

    What follows the first # is the fragment; a known prefix before a colon is the namespace, main
    without one, and leading colons are dropped; blanks and underscores are one, and a first letter with an
    upper-case form of one letter gets it.
    """
    trimmed = lambda c: F.regexp_replace(c, f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")
    whole = F.coalesce(title, F.lit(""))
    fragment = trimmed(F.regexp_extract(whole, "(?s)^[^#]*#(.*)$", 1))
    text = F.trim(F.regexp_replace(F.regexp_extract(whole, "^([^#]*)", 1), f"[_{_BLANKS}]+", " "))
    text = F.regexp_replace(text, "^:+ *", "")
    names = F.create_map(*[F.lit(x) for pair in NAMESPACES.items() for x in pair])
    known = F.get(F.transform(F.array(text), lambda t: F.element_at(names, F.lower(F.trim(F.regexp_extract(t, "^([^:]+):", 1))))), 0)
    rest = F.when(known.isNotNull(), F.trim(F.regexp_replace(text, "^[^:]+:", ""))).otherwise(text)
    relative = rest.isin(".", "..") | rest.rlike("^\\.\\.?/|/\\.\\.?/|/\\.\\.?$")
    first = F.upper(F.substring(rest, 1, 1))
    shown = F.when(F.length(first) == 1, F.concat(first, F.expr("''"), F.substr(rest, F.lit(2), F.length(rest)))).otherwise(rest)
    error = F.when(rest == "", "empty").when(rest.rlike("[#<>\\[\\]{}|\\x00-\\x1f\\x7f]"), "illegal-char").when(relative, "relative").when(F.octet_length(shown) > 255, "too-long")
    fine = lambda c: F.when(error.isNull(), c)
    return F.struct(fine(F.coalesce(known, F.lit("main"))).alias("ns"), fine(F.replace(shown, F.lit(" "), F.lit("_"))).alias("slug"), fine(shown).alias("title"), fine(F.when(fragment != "", fragment)).alias("fragment"), error.alias("error"))


def normalize_title(title: Column) -> Column:
    """Wiki title: blanks for underscores, runs of blanks as one, first letter upper-case; null when empty or illegal."""
    t = F.trim(F.regexp_replace(F.regexp_replace(title, "_", " "), "\\s+", " "))
    ok = (t != "") & ~t.rlike("[#<>\\[\\]|{}]") & (F.octet_length(t) <= 255)
    return F.when(ok, F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2), F.length(t))))


def parse_hexdump(text: Column) -> Column:
    """Bytes of a dump of lines 'offset  hex hex ...  |ascii|'."""
    line = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_extract(x, "^[0-9a-fA-F]{4,}:?\\s+((?:[0-9a-fA-F]{2}\\s?)+)", 1), "\\s", ""))
    return F.unhex(F.array_join(line, ""))


#: Bounds of a record, as (column, most).
BOUNDS = {"n_files": 200_000, "n_slots": 4096, "n_media": 4096, "n_audio": 200_000, "n_assets": 100_000}


def record_error(columns: list[str]) -> Column:
    """First thing wrong with a record row (sha256 and counts), or null."""
    error = F.when(F.col("sha256").isNull() | ~F.col("sha256").rlike("^[0-9a-f]{64}$"), "bad sha256")
    for c, most in BOUNDS.items():
        if c in columns:
            error = error.when(F.col(c) > most, f"too many: {c}")
    return error


def clamp_region(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Region within the unit square; null if nothing is left of it."""
    left, top = F.greatest(x, F.lit(0.0)), F.greatest(y, F.lit(0.0))
    right, bottom = F.least(x + w, F.lit(1.0)), F.least(y + h, F.lit(1.0))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))

"""Scalar functions as native Column expressions (plus one pandas UDF where Unicode decomposition is needed)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hex_to_id63(h: Column) -> Column:
    """First 16 hex digits as a number of 63 bits; null for null, empty or non-hex input."""
    head = F.substring(h, 1, 16)
    bits = F.conv(head, 16, -10).cast("bigint").bitwiseAND(F.lit(2**63 - 1))
    return F.when(head.rlike("^[0-9a-fA-F]+$"), bits)


def parse_u64(s: Column) -> Column:
    """Decimal text of an unsigned 64-bit number as the signed number with the same bits; else null."""
    big = s.try_cast("decimal(38,0)")
    ok = s.rlike("^[0-9]{1,20}$") & (big < F.lit("18446744073709551616").cast("decimal(38,0)"))
    return F.when(ok, F.conv(s, 10, -10).cast("bigint"))


def strict_num(s: Column) -> Column:
    """A plain decimal number; signs other than minus, exponents and blanks give null."""
    return F.when(s.rlike("^-?[0-9]+(\\.[0-9]+)?$"), s.try_cast("double"))


def partial_date(s: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD as the first day it names; null for any other text or no such day."""
    full = F.when(s.rlike("^[0-9]{4}$"), F.concat(s, F.lit("-01-01"))).when(s.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$"), F.concat(s, F.lit("-01"))).when(s.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$"), s)
    return F.try_to_date(full, "yyyy-MM-dd")


_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _month_number(name: Column) -> Column:
    """Two digits of an English month name or abbreviation ('Sept' too)."""
    low = F.lower(F.substring(name, 1, 3))
    out = F.lit(None).cast("string")
    for k, m in enumerate(_MONTHS, 1):
        out = F.when(low == m, f"{k:02d}").otherwise(out)
    return out


def fuzzy_date(s: Column) -> Column:
    """Partial ISO date of free text: ISO, YYYY/MM/DD, 'Month D, YYYY', 'D Month YYYY', 'Month YYYY', 'YYYY'.

    Ordinal endings and a time of day after the date are dropped; days are checked against the calendar.
    """
    t = F.trim(F.regexp_replace(F.regexp_replace(s, "\\s+\\d{1,2}:\\d{2}(:\\d{2})?\\s*([aApP][mM])?\\s*$", ""), "(?i)(\\d)(st|nd|rd|th)\\b", "$1"))
    name = "(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\\.?"
    day = lambda y, m, d: F.concat_ws("-", y, m, F.lpad(d, 2, "0"))
    part = lambda p, g: F.regexp_extract(t, p, g)
    iso, slash = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$", "^(\\d{4})/(\\d{1,2})/(\\d{1,2})$"
    mdy, dmy, my = f"(?i)^{name}\\s+(\\d{{1,2}}),?\\s+(\\d{{4}})$", f"(?i)^(\\d{{1,2}})\\s+{name},?\\s+(\\d{{4}})$", f"(?i)^{name},?\\s+(\\d{{4}})$"
    whole = (
        F.when(t.rlike(iso), day(part(iso, 1), F.lpad(part(iso, 2), 2, "0"), part(iso, 3)))
        .when(t.rlike(slash), day(part(slash, 1), F.lpad(part(slash, 2), 2, "0"), part(slash, 3)))
        .when(t.rlike(mdy), day(part(mdy, 3), _month_number(part(mdy, 1)), part(mdy, 2)))
        .when(t.rlike(dmy), day(part(dmy, 3), _month_number(part(dmy, 2)), part(dmy, 1)))
    )
    checked = F.when(partial_date(whole).isNotNull(), whole)
    month = F.when(t.rlike("^\\d{4}-(0[1-9]|1[0-2])$"), t).when(t.rlike(my), F.concat_ws("-", part(my, 2), _month_number(part(my, 1))))
    return F.coalesce(checked, month, F.when(t.rlike("^\\d{4}$"), t))


def extension(path: Column) -> Column:
    """Lower-case extension of the last path part; null where there is none (dot files too)."""
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.regexp_extract(name, "^.+\\.([^.]+)$", 1))
    return F.when(ext != "", ext)


def depth(path: Column) -> Column:
    """Number of non-empty path parts."""
    return F.size(F.filter(F.split(path, "/"), lambda p: p != ""))


def human_size(n: Column, units: tuple[str, ...] = ("B", "KiB", "MiB", "GiB", "TiB"), digits: int = 1) -> Column:
    """Bytes in the largest unit of 1024s, plain bytes without decimals."""
    out = F.concat(n.cast("string"), F.lit(f" {units[0]}"))
    for k, u in enumerate(units[1:], 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string(f"%.{digits}f", n / float(1024**k)), F.lit(f" {u}"))).otherwise(out)
    return out


def listing_size(n: Column) -> Column:
    """Size as listings show it: units without an i, a dash for null."""
    return F.coalesce(human_size(n, ("B", "KB", "MB", "GB", "TB")), F.lit("—"))


def field_size(n: Column) -> Column:
    """Size as page fields show it: two decimals from GiB on, which is the largest unit; null for null."""
    return F.when(n < 1024**3, human_size(n)).when(n.isNotNull(), F.concat(F.format_string("%.2f", n / float(1024**3)), F.lit(" GiB")))


def strip_controls(s: Column) -> Column:
    return F.regexp_replace(s, "[\\x00-\\x1f\\x7f]", "")


def nullify(s: Column) -> Column:
    """Text without control characters and outer blanks; null when nothing is left."""
    t = F.trim(strip_controls(s))
    return F.when(t != "", t)


def normalize_content(s: Column) -> Column:
    """CRLF to LF and exactly one newline at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(s, "\\r\\n?", "\n"), "\\n+\\z", ""), F.lit("\n"))


def natural_key(s: Column) -> Column:
    """Sort key under which runs of digits compare as numbers (up to 20 digits), case aside."""
    padded = F.regexp_replace(F.lower(s), "(\\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "0+(\\d{20})(?!\\d)", "$1")


def slug_ascii(s: Column) -> Column:
    """Lower-case runs of letters and digits joined by hyphens, 80 characters at most; null when empty."""
    cut = F.substring(F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 80)
    t = F.regexp_replace(cut, "-+$", "")
    return F.when(t != "", t)


@F.pandas_udf(T.StringType())
def decompose(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks (Spark has no function for it)."""
    return s.str.normalize("NFKD").str.replace("[̀-ͯ]", "", regex=True)


def slugify(s: Column) -> Column:
    return slug_ascii(decompose(F.lower(s)))


def slug_or_hash(s: Column, prefix: str = "p-") -> Column:
    """The slug, or for text without letters a prefix and 8 hex digits of its sha256."""
    return F.coalesce(slug_ascii(s), F.concat(F.lit(prefix), F.substring(F.sha2(s, 256), 1, 8)))


def trigrams(s: Column) -> Column:
    """Distinct 3-grams of the lower-case alphanumeric words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams; 0 when neither has one."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def contains_literal(c: Column, term: str) -> Column:
    """Case-insensitive substring, wildcards taken literally."""
    return F.contains(F.lower(c), F.lit(term.lower()))


def cut_bytes(s: Column, most: int) -> Column:
    """Longest prefix of whole characters within so many UTF-8 bytes."""
    return F.when(F.octet_length(s) <= most, s).otherwise(F.regexp_replace(F.make_valid_utf8(F.substring(s.cast("binary"), 1, most).cast("string")), "�+$", ""))


def normalize_language(s: Column) -> Column:
    """Language tag of 2-3 letters with an optional region, lower-case; else null."""
    t = F.lower(F.trim(s))
    return F.when(t.rlike("^[a-z]{2,3}(-[a-z0-9]{2,8})?$"), t)


def hexdump_line(bytes_: Column, offset: Column) -> Column:
    """Offset and bytes in hex, blank separated."""
    return F.concat(F.lpad(F.lower(F.hex(offset)), 8, "0"), F.lit("  "), F.trim(F.regexp_replace(F.lower(F.hex(bytes_)), "(..)", "$1 ")))


def game_slug(name: Column, system: Column) -> Column:
    """Slugs of a name and a system with "--" between; the name's alone without a system."""
    n, s = (F.coalesce(slug_ascii(c), F.lit("")) for c in (name, system))
    return F.when(s != "", F.concat(n, F.lit("--"), s)).otherwise(n)


def build_date(creation: Column, release: Column) -> Column:
    """The first of two dates that is given; eight digits are written with hyphens, all else stays."""
    raw = F.coalesce(F.when(creation != "", creation), F.when(release != "", release))
    return F.regexp_replace(raw, "^(\\d{4})(\\d{2})(\\d{2})$", "$1-$2-$3")

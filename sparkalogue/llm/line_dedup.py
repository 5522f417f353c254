"""Removing lines that resemble an earlier line, by an exact set-similarity join in Spark SQL functions.

A line is a piece of text between newlines; its tokens are its different words (runs of
other than ASCII white space). A line goes if the token sets of it and of any earlier line,
in order of doc_id and place in the text, have a Jaccard similarity of `threshold` or more;
the earlier line counts whether or not it goes itself. Lines without a word stay.

Tokens are ordered by rarity: counts of all words of the corpus, summed over RARITY_SLOTS
hash slots (an array of bounded size), lead each token's key, so a sorted key array has the
rarest first; any order gives the same lines, a truer one fewer candidates. Lines with equal
token sets are one set, numbered by the place of its earliest line. The first common token of
two sets at the threshold lies in both prefixes, the n - ceil(t n) + 1 rarest tokens of each.
Sets meet under each prefix token, within bands of sizes, the length and positional filters, and where the
parity bitmaps of their tokens (64 bits, 128 of wide sets) differ in no more bits than their sets may in tokens.
A token that over HOT prefixes hold is hot: under it sets meet by the token and each later one
of the prefix, one token longer, that may be their second in common. The larger a corpus, the more
tokens are hot, and such pairs are many but few sets pass the filters under one: they meet in rounds,
a share of the hot tokens each, and only sets with another one within the filters are kept. Of these
every set first tries the earliest set alone, and only those without a match anywhere meet the others.
Candidates are verified on their whole token sets, which one more reading of the texts brings.
What stays is the earliest line of each set that nothing matched; no other line is stored.

Null text has no line and stays null; a text all of whose lines go becomes empty. Rows of one
doc_id follow each other in order of a hash of the text, equal rows in any order: of these all
but the first lose all lines with a word. A null doc_id comes first. Extra columns stay,
whatever their names; text is replaced, and so are n_lines and n_removed. An empty table gives
no rows. Texts and lines of any length are taken whole.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, session_conf, write_table

RARITY_SLOTS = 1 << 16
HOT = 700
#: Bounds: tokens that are hot at most, those that most prefixes hold; pairs of tokens of a round, as a multiple of the tokens of all prefixes.
HOT_TOKENS, ROUND = 1 << 18, 1
#: Tokens from which a set has a second bitmap, of half its tokens.
WIDE = 64
_HASH_BITS = 43
_LOW32 = (1 << 32) - 1


def spaced(text: Column) -> Column:
    """The text with a space for each other white space but newlines."""
    other = functools.reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in "\t\x0b\f\r"])
    return F.when(other, F.regexp_replace(text, "[\\t\\x0B\\f\\r]", " ")).otherwise(text)


def words(line: Column) -> Column:
    """Words of a spaced text without newlines, with empty ones between them where spaces are doubled."""
    return F.split(line, " ")


def rarity(docs: DataFrame) -> Column:
    """An array column of constant value: occurrences of the words of each hash slot, 20 bits at most."""
    each = docs.select(F.explode(words(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")))).alias("w")).where("w != ''")
    slots = each.groupBy(F.xxhash64("w").bitwiseAND(F.lit(RARITY_SLOTS - 1)).alias("slot")).agg(F.count("*").alias("n"))
    counts = [0] * RARITY_SLOTS
    for r in slots.collect():
        counts[r["slot"]] = min(r["n"], (1 << 20) - 1)
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")


def token_keys(line: Column, counts: Column) -> Column:
    """Sorted different keys of a line's words: rarity above, hash below. Empty where the line has no word."""
    hashes = F.array_remove(F.array_distinct(F.transform(words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # a count is never null; said so, keys are sorted as plain numbers
    count = lambda h: F.coalesce(F.get(counts, h.bitwiseAND(F.lit(RARITY_SLOTS - 1)).cast("int")), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(count(h), _HASH_BITS).bitwiseOR(F.shiftrightunsigned(h, 64 - _HASH_BITS))))


def parity(keys: Column, half: bool = False) -> Column:
    """64 bits, each the parity of the number of keys that fall on it: of all keys, or of the half with the bit above set."""

    def flip(bits: Column, k: Column) -> Column:
        one = F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1)) if half else F.lit(1).cast("long")
        return bits.bitwiseXOR(F.call_function("shiftleft", one, k.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(keys, F.lit(0).cast("long"), flip)


def _within(t: int, mine: str = "m_") -> Column:
    """Length, positional and bitmap filter of (m_at, m_bits, m_half) and (o_at, o_bits, o_half); at packs size and position.

    An overlap of o needs o (1000 + t) >= t (n + m), so at most (1000 - t) / (1000 + t) of n + m tokens differ.
    Two wide sets differ in the bits of either half, those of the other half being what half leaves of all bits.
    """
    n = [F.shiftright(c, 32) for c in (f"{mine}at", "o_at")]
    pos = [F.col(c).bitwiseAND(F.lit(_LOW32)) for c in (f"{mine}at", "o_at")]
    every, half = (F.col(f"{mine}{c}").bitwiseXOR(F.col(f"o_{c}")) for c in ("bits", "half"))
    length = (n[0] * 1000 >= n[1] * t) & (n[1] * 1000 >= n[0] * t)
    differ = F.when(F.least(n[0], n[1]) < WIDE, F.bit_count(every)).otherwise(F.bit_count(half) + F.bit_count(every.bitwiseXOR(half)))
    positional = F.least(n[0] - pos[0], n[1] - pos[1]) * (1000 + t) >= (n[0] + n[1]) * t
    return length & positional & (differ * (1000 + t) <= (n[0] + n[1]) * (1000 - t))


def bands(t: int) -> Column:
    """The one or two bands of sizes, a band for each bit length, in which a set of n tokens meets others.

    They are that of n and that of the smallest size within the threshold, which is the same or the one below;
    so any two sets within it have a band in common.
    """
    own, low = F.length(F.bin("n")), F.length(F.bin(F.expr(f"(n * {t}L + 999) div 1000")))
    return F.when(own == low, F.array(own)).otherwise(F.array(own, low))


def _sides(rows: DataFrame, key: str) -> list[DataFrame]:
    """The rows (key, id, at, bits, half) as both sides of a join: each gives new names to all its columns, only then do both read one shuffle."""
    return [rows.select(F.col(key).alias(f"{p}key"), *[F.col(c).alias(f"{p}{c}") for c in ("id", "at", "bits", "half")]) for p in ("m_", "o_")]


def near(rows: DataFrame, key: str, t: int) -> DataFrame:
    """Those of the rows (key, id, at, bits, half) that their key brings together with another one, the filters passed."""
    one, two = _sides(rows, key)
    some = one.join(two, (F.col("m_key") == F.col("o_key")) & (F.col("m_id") != F.col("o_id")) & _within(t), "left_semi")
    return some.select(F.col("m_key").alias(key), *[F.col(f"m_{c}").alias(c) for c in ("id", "at", "bits", "half")])


def met(rows: DataFrame, key: str, t: int) -> DataFrame:
    """(id, other) of the rows (key, id, at, bits, half) that a key brings together, the filters passed, other the earlier."""
    one, two = _sides(rows, key)
    return one.join(two, F.col("m_key") == F.col("o_key")).where("m_id > o_id").where(_within(t)).select(F.col("m_id").alias("id"), F.col("o_id").alias("other"))


def _keyed(docs: DataFrame) -> list[Column]:
    """doc and row: what tells different rows apart, never null; a null doc_id comes before all others."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(-(1 << 63)).cast("long")).alias("doc"), F.xxhash64(doc_id.isNull(), "text").alias("row")]


def ordered(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with a number `id` that rises with doc, row and line_no: stretches of doc, of about as many docs each, are sorted apart."""
    parts = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256)
    ends = docs.agg(F.percentile_approx("doc", [k / parts for k in range(1, parts)], 10 * parts).alias("ends")).first()["ends"] if parts > 1 else None
    part = functools.reduce(Column.__add__, [(F.col("doc") > e).cast("int") for e in sorted(set(ends or []))], F.lit(0))
    return rows.repartitionById(parts, part).sortWithinPartitions("doc", "row", "line_no").select(F.monotonically_increasing_id().alias("id"), "*")


def kept_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc, row, line_no) of the lines with a word that stay; equal rows count as one."""
    t = round(1000 * threshold)
    if not 500 < t <= 1000:
        raise ValueError("the threshold must be over 0.5, and 1 at most")
    source = docs.select(*_keyed(docs), "text")
    counts = rarity(source)
    split = source.select("doc", "row", F.posexplode(F.split(spaced(F.col("text")), "\n")).alias("line_no", "line"))

    n = F.size("keys")
    # one token more than the filter needs; it serves hot tokens only
    prefix = F.slice("keys", F.lit(1), (n - F.expr(f"(size(keys) * {t} + 999) div 1000") + 2).cast("int"))
    keyed = split.where(F.trim("line") != "").withColumn("keys", token_keys(F.col("line"), counts))
    bits = [parity(F.col("keys")).alias("bits"), F.when(n >= WIDE, parity(F.col("keys"), half=True)).otherwise(F.lit(0).cast("long")).alias("half")]
    lines = keyed.select("doc", "row", "line_no", F.xxhash64("keys").alias("sig"), F.xxhash64(F.lit(1), "keys").alias("sig2"), n.alias("n"), *bits, prefix.alias("prefix"))
    first = lines.groupBy("sig", "sig2").agg(F.min(F.struct("doc", "row", "line_no", "n", "bits", "half", "prefix")).alias("first"))
    sets = write_table(ordered(first.select("first.*"), source), "line-sets")

    # a narrow row for each prefix token; a set of one token has no other set within the threshold
    sized = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long"))
    short = F.slice("prefix", F.lit(1), F.size("prefix") - 1)
    placed = sets.where("n > 1").select("id", "n", "bits", "half", "prefix", bands(t).alias("bands"), F.posexplode(short).alias("pos", "tok"))
    after = F.sum(F.size("prefix") - F.col("pos") - 1).alias("after")
    hot_tokens = placed.groupBy("tok").agg(F.count("*").alias("held"), after).where(F.col("held") > HOT).orderBy(F.desc("held")).limit(HOT_TOKENS)
    hot_tokens = write_table(hot_tokens.select("tok", "after"), "hot-tokens")
    n_pairs = hot_tokens.agg(F.sum("after")).first()[0] or 0
    any_hot, listed = n_pairs > 0, F.broadcast(hot_tokens.select("tok"))

    # both sides of this join are one shuffle; under a token few sets meet, apart by bands of sizes
    cold = placed.join(listed, "tok", "left_anti") if any_hot else placed
    cold = cold.withColumn("band", F.explode("bands")).select(F.xxhash64("tok", "band").alias("key"), "id", sized.alias("at"), "bits", "half")
    pairs = write_table(met(cold, "key", t).distinct(), "line-pairs")
    members = pairs.select("id").union(pairs.select("other"))
    if any_hot:
        # the place of two tokens is that of the later less one: as many may be missing if they are the first two in common
        later = F.slice("prefix", F.col("pos") + 2, F.size("prefix"))
        rounds = 1 if n_pairs <= ROUND * sets.count() else math.ceil(n_pairs / (ROUND * sets.agg(F.sum(F.size("prefix"))).first()[0]))
        rows = []
        for r in range(rounds):
            share = placed.where(F.pmod(F.xxhash64("tok"), F.lit(rounds)) == r) if rounds > 1 else placed
            by_two = share.join(listed, "tok").select("tok", "id", sized.alias("at"), "bits", "half", F.posexplode(later).alias("more", "second"))
            by_two = by_two.select(F.xxhash64("tok", "second").alias("tok"), "id", (F.col("at") + F.col("more")).alias("at"), "bits", "half")
            # moved below what makes a side's columns, the semi-join would shuffle each side for itself
            with session_conf(docs.sparkSession, spark__sql__optimizer__excludedRules="org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"):
                rows.append(write_table(near(by_two, "tok", t), "hot-prefixes"))
        hot = functools.reduce(DataFrame.union, rows)
        low = hot.groupBy("tok").agg(F.min("id").alias("other"), *[F.min_by(c, "id").alias(f"o_{c}") for c in ("at", "bits", "half")])
        members = members.union(hot.select("id"))

    def earlier(rows: DataFrame) -> DataFrame:
        return rows.select("tok", F.col("id").alias("other"), *[F.col(c).alias(f"o_{c}") for c in ("at", "bits", "half")])

    # the token sets of all candidates, from one more reading of the texts
    wanted = sets.join(members.distinct(), "id").groupBy("doc", "row").agg(F.collect_list(F.struct("id", "line_no")).alias("wanted"))
    whole = source.join(wanted, ["doc", "row"]).select("wanted", F.split(spaced(F.col("text")), "\n").alias("lines"))
    of_text = whole.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.get("lines", w["line_no"]).alias("line")))).alias("w")).select("w.*")
    found = write_table(of_text.dropDuplicates(["id"]).select("id", token_keys(F.col("line"), counts).alias("keys")), "line-keys")

    def reach(some: DataFrame) -> DataFrame:
        """id of the pairs that reach the threshold."""
        both = some.join(found, "id").join(found.select(F.col("id").alias("other"), F.col("keys").alias("other_keys")), "other")
        common = F.size(F.array_intersect("keys", "other_keys"))
        return write_table(both.where(common * 1000 >= (F.size("keys") + F.size("other_keys") - common) * t).select("id").distinct(), "gone")

    def verified(pairs: DataFrame) -> DataFrame:
        """id of the sets of which a pair (id, other) reaches the threshold: the earliest other is tried first."""
        nearest = pairs.groupBy("id").agg(F.min("other").alias("other"))
        at_once = reach(nearest)
        left = write_table(pairs.join(at_once, "id", "left_anti").join(nearest, ["id", "other"], "left_anti"), "line-pairs")
        return at_once if left.isEmpty() else at_once.union(reach(left))

    gone = verified(pairs)
    if any_hot:
        hubs = write_table(hot.join(gone, "id", "left_anti").join(low, "tok").where("id > other").where(_within(t, "")).select("id", "other").distinct(), "line-pairs")
        gone = gone.union(verified(hubs)).distinct()
        # written before those that were tried are left out: an anti-join would be moved to where a pair stands for each of its tokens
        rest = write_table(hot.join(gone, "id", "left_anti").join(earlier(hot), "tok").where("id > other").where(_within(t, "")).select("id", "other").distinct(), "line-pairs")
        gone = gone.union(verified(write_table(rest.join(hubs, ["id", "other"], "left_anti"), "line-pairs"))).distinct()
        discard(*rows, rest)
    discard(found)
    return sets.select("id", "doc", "row", "line_no").join(gone, "id", "left_anti").drop("id")


def dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with the lines gone from text, and n_lines, n_removed (long): lines with a word, and those that went."""
    by_row = kept_lines(docs, threshold).groupBy("doc", "row").agg(F.collect_list("line_no").alias("kept"))
    again = write_table(docs.select(*_keyed(docs)).groupBy("doc", "row").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated-rows")
    held = docs.select(F.struct(*docs.columns).alias("d"), *_keyed(docs)).join(by_row, ["doc", "row"], "left")
    copy = F.lit(1)
    if not again.isEmpty():
        # equal rows: the first one is whichever comes first
        held, copy = held.withColumn("copy", F.row_number().over(Window.partitionBy("doc", "row").orderBy("row"))), F.col("copy")
    none = F.array().cast("array<int>")
    split = F.split("d.text", "\n")
    wordy = F.array_compact(F.transform(split, lambda x, i: F.when(x.rlike("[^ \\t-\\r]"), i)))
    held = held.select("d", F.coalesce(wordy, none).alias("wordy"), F.coalesce("kept", none).alias("kept"), copy.alias("copy"))
    held = held.select("d", F.size("wordy").alias("n_lines"), F.when(F.col("copy") > 1, F.col("wordy")).otherwise(F.array_except("wordy", "kept")).alias("gone"))
    text = F.when(F.size("gone") == 0, F.col("d.text")).otherwise(F.array_join(_without(split, F.col("gone")), "\n"))
    # the columns of docs come in last, lest their names stand for others here
    made = held.select("d", F.struct(text.alias("text"), F.col("n_lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed")).alias("made"))
    new = ("text", "n_lines", "n_removed")
    return made.select(*[F.col("d").getField(c).alias(c) for c in docs.columns if c not in new], *[F.col("made").getField(c).alias(c) for c in new])


def _without(items: Column, places: Column) -> Column:
    """The items that don't stand at the places, in time linear in both."""
    return F.get(F.transform(F.array(items), lambda all_items: F.transform(F.array_except(F.sequence(F.lit(0), F.size(all_items) - 1), places), lambda i: F.get(all_items, i))), F.lit(0))

"""Quality rules whose cutoffs are chosen with exact risk control, in Spark SQL functions only.

Each rule rejects a document whose measure exceeds a cutoff. For every stratum (language),
rule and cutoff of a fixed grid, the labelled good documents that pass the base rules are
the holdout: n of them, of which the cutoff rejects k. A cutoff is admitted if the chance of
k or fewer rejections under a false-rejection rate of `risk` / rules is at most
`delta` / tests, the exact binomial (Clopper-Pearson) bound with Bonferroni's correction over
all strata, rules and cutoffs tested. So with probability 1 - delta no stratum loses more
than `risk` of its good documents. The smallest admitted cutoff of each rule applies; a
stratum with too few labels admits none and its rule rejects nothing.

Words are runs of other than ASCII white space. Repeated windows are found by 64-bit hash and
compared word by word. Of more than TAIL_TERMS rejections the tail's last terms are bounded, not
summed, which can only withhold a cutoff. Null or empty texts have no word and fail the base rules. A null language is a stratum without labels. Repeated labels count once
(the smallest quality); repeated rows are judged each. Extra columns are ignored. Empty tables
give no rows; without labels no rule rejects. Texts of any length are measured whole.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import write_table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Cutoffs tried for each measure; a document is rejected above its cutoff.
GRID = {
    "symbols_per_word": (0.0, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0, 2.0),
    "dup_line_share": (0.0, 0.05, 0.1, 0.2, 0.3, 0.5),
    "repeat_share": (0.0, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25),
    "chars_per_word": (6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0),
    "capital_share": (0.05, 0.1, 0.2, 0.3, 0.5, 0.7),
}
#: Terms of the binomial tail that are summed one by one; a geometric bound covers the rest.
TAIL_TERMS = 4000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def repeat_words(tokens: Column) -> Column:
    """Words inside windows of WINDOW words that stand twice or more in the text."""

    def window(at: Column) -> Column:
        return F.slice(tokens, (at + 1).cast("int"), WINDOW)

    # sorting brings equal windows together, in order of place
    hashed = F.transform(F.sequence(F.lit(0), F.size(tokens) - WINDOW), lambda i: F.struct(F.xxhash64(window(i)).alias("h"), i.cast("long").alias("at")))

    def starts(order: Column) -> Column:
        def same(j: Column) -> Column:
            a, b = F.get(order, j), F.get(order, j + 1)
            return (a["h"] == b["h"]) & (window(a["at"]) == window(b["at"]))

        near = F.filter(F.sequence(F.lit(0), F.size(order) - 2), same)
        return F.sort_array(F.array_distinct(F.flatten(F.transform(near, lambda j: F.array(F.get(order, j)["at"], F.get(order, j + 1)["at"])))))

    def step(acc: Column, start: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(WINDOW).cast("long"), start - acc["last"])).alias("n"), start.alias("last"))

    def total(at: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).cast("long").alias("last"))
        # each start adds the words since the one before, and the last one's window is added by moving all by one window
        return F.aggregate(at, zero, step)["n"]

    return F.when(F.size(tokens) > WINDOW, let(F.sort_array(hashed), lambda order: total(starts(order)))).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the measures of GRID."""
    text = F.coalesce("text", F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    row = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", row.alias("w"), dup.alias("d"),
        without(" \t\n\x0b\x0c\r").cast("long").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.length(text) - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("capitals"),
    )
    n_words, per_word = F.col("w.n_words"), lambda c: c / F.greatest(F.col("w.n_words"), F.lit(1))
    failed = (n_words < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEAT_PERCENT * n_words)
    return df.select(
        "doc_id", "lang", n_words.alias("n_words"), "word_chars", "n_symbols", F.col("d.n_dup_lines").alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"), failed.alias("base_failed"),
        per_word(F.col("n_symbols")).alias("symbols_per_word"), (F.col("d.n_dup_lines") / F.greatest("d.n_lines", F.lit(1))).alias("dup_line_share"),
        per_word(F.col("w.n_repeat_words")).alias("repeat_share"), per_word(F.col("word_chars")).alias("chars_per_word"),
        (F.col("capitals") / F.greatest("word_chars", F.lit(1))).alias("capital_share"),
    )


def log_gamma(x: Column) -> Column:
    """Stirling's series, moved up by 8."""
    y = x + 8
    below = functools.reduce(operator.add, [F.log(x + k) for k in range(8)])
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) - below


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """Upper bound, exact up to rounding, of the chance of k or fewer among n at rate p; 1 where k >= n p."""
    n, k = n.cast("double"), k.cast("double")
    at_k = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    ratio = lambda j: (k - j) * (1 - p) / ((n - k + j + 1) * p)
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))
    steps = F.sequence(F.lit(0), F.least(k, F.lit(float(TAIL_TERMS))).cast("int"))
    done = F.aggregate(steps, zero, lambda a, j: F.struct((a["sum"] + a["term"] * ratio(j)).alias("sum"), (a["term"] * ratio(j)).alias("term")))
    rest = done["term"] * ratio(F.lit(TAIL_TERMS)) / (1 - ratio(F.lit(TAIL_TERMS)))
    total = done["sum"] + F.when(k > TAIL_TERMS, rest).otherwise(0.0)
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(at_k) * total))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """lang and a column cut_<measure> for each rule: its smallest admitted cutoff, null if none."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
    holdout = measured.where("not base_failed and lang is not null").join(good, "doc_id", "left_semi")
    rejected = [F.count_if(F.col(m) > c).alias(f"k_{m}_{i}") for m, cs in GRID.items() for i, c in enumerate(cs)]
    counted = holdout.groupBy("lang").agg(F.count("*").alias("n"), *rejected)
    counted = write_table(counted, "holdout")
    tests = counted.count() * sum(map(len, GRID.values()))
    limit, p = delta / max(1, tests), risk / len(GRID)

    tried = F.array(*[F.struct(F.lit(m).alias("rule"), F.lit(c).alias("cut"), F.col(f"k_{m}_{i}").alias("k")) for m, cs in GRID.items() for i, c in enumerate(cs)])
    admitted = counted.select("lang", "n", F.explode(tried).alias("t")).select("lang", "n", "t.*").where(binomial_tail(F.col("n"), F.col("k"), p) <= limit)
    return write_table(admitted.groupBy("lang").agg(*[F.min(F.when(F.col("rule") == m, F.col("cut"))).alias(f"cut_{m}") for m in GRID]), "cutoffs")


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and the measures."""
    measured = write_table(measure(docs), "measured")
    cuts = cutoffs(measured, labels, risk, delta)
    fine = [F.coalesce(F.col(m) <= F.col(f"cut_{m}"), F.lit(True)) for m in GRID]
    kept = ~F.col("base_failed") & functools.reduce(operator.and_, fine)
    # one row a language: small, and left to the planner, whose broadcast checks the size
    return measured.join(cuts, "lang", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), *GRID)

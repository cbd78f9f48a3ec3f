"""Quality rules with risk-controlled thresholds.

Every document gets counts over its whole text and five scores that are higher for worse text (symbols per word,
share of repeated lines, share of words in repeated three-word windows, characters per word, and words per character).
A rule rejects a document whose score is over the cutoff of its stratum (its language).

Cutoffs come from labelled documents that pass the base rules.  For each stratum and rule a fixed row of cutoffs is
tested from lenient to strict: with k of n good documents rejected, the exact binomial probability
P(Bin(n, alpha_rule) <= k) must be at most delta over the number of (stratum, rule) pairs; the row ends at the first
cutoff that fails (fixed-sequence testing, Bonferroni over the pairs).  So with probability 1 - delta every cutoff left
rejects at most alpha_rule of the good documents of its stratum, and all rules of a stratum together at most alpha.
Among these, the cutoff that best separates bad from good labelled documents is taken, if it gains `least_gain`;
a stratum or rule without enough labels gets no cutoff and rejects nothing.

All labelled rows are counted, in one row per (stratum, rule, score bin); the selection works on those counts in Spark.

Nulls: a null text has no words, a null language is a stratum of its own without a name.  A document with several labels
is good only if all say so; labels without a document count nothing.  Repeated rows are rows of their own where they
are judged, but a labelled id counts once for the cutoffs, or repeats would feign a larger holdout (of rows of one id
that differ, the first by stratum and counts is taken).  An empty table of labels gives no cutoffs, an empty table of documents an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from gapline.llm.common import add_struct, free_name

FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_lines bigint"
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: White space, and the bytes of a code point after its first.
NOT_COUNTED = SPACE + bytes(range(128, 192))

#: Rule: (score, step between cutoffs). Cutoff number j (0 is the strictest) is j * step; there are BINS of them.
BINS = 100
RULES = {
    "symbols": (lambda m: F.try_divide(m["n_symbols"], m["n_words"]), 0.02),
    "dup_lines": (lambda m: F.try_divide(m["n_dup_lines"], m["n_lines"]), 0.01),
    "repeats": (lambda m: F.try_divide(m["n_repeat_words"], m["n_words"]), 0.01),
    "long_words": (lambda m: F.try_divide(m["word_chars"], m["n_words"]), 0.25),
    "short_words": (lambda m: F.try_divide(m["n_words"], m["word_chars"]), 0.01),
}


def counts(texts: list[bytes]) -> list[list[int]]:
    out: list[list[int]] = [[], [], [], [], [], []]
    for text in texts:
        words = text.split()
        code_points = len(text.translate(None, NOT_COUNTED))
        grams = list(zip(words, words[1:], words[2:]))
        seen = Counter(grams)
        repeated = 0
        if len(seen) < len(grams):
            upto = 0  # words before this one are counted
            for i, g in enumerate(grams):
                if seen[g] > 1:
                    repeated += i + 3 - max(i, upto)
                    upto = i + 3
        lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
        for column, value in zip(out, (
            len(words), code_points, len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated, len(lines),
        ), strict=True):
            column.append(value)
    return out


def measure(docs: DataFrame, name: str) -> DataFrame:
    return add_struct(docs, "text", name, FIELDS, counts)


def base_failed(m: Column) -> Column:
    """Fixed rules of the contract."""
    return (m["n_words"] < 50) | (m["n_repeat_words"] * 100 > m["n_words"] * 50)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), as the regularised incomplete beta I_{1-p}(n - k, k + 1) by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = float(n - k), k + 1.0, 1.0 - p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _fraction(a, b, x) / a)
    return max(0.0, 1.0 - front * _fraction(b, a, 1.0 - x) / b)


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-12:
            break
    return h


@F.pandas_udf(T.DoubleType())
def _tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p)], dtype="float64")


def cutoffs(
    measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, least_gain: float = 0.01
) -> DataFrame:
    """stratum, rule, cutoff, n_good, good_rejected, n_bad, bad_rejected, tail: one row per chosen cutoff.

    `measured` has doc_id, stratum and the struct m.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = measured.where(~base_failed(F.col("m"))).join(good, "doc_id")
    held = held.groupBy("doc_id").agg(F.min(F.struct("stratum", "m", "good")).alias("one")).select("one.*")
    # the strictest cutoff that still keeps the document: bin b is kept by cutoffs b and above
    bins = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.least(F.ceil(F.coalesce(score(F.col("m")), F.lit(0.0)) / step), F.lit(BINS)).cast("int").alias("bin"))
        for rule, (score, step) in RULES.items()
    ])
    per = held.select("stratum", "good", F.inline(bins)).groupBy("stratum", "rule", "bin").agg(
        F.sum(F.when(F.col("good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("good") == 1, 0).otherwise(1)).alias("bad")
    )
    every = per.select("stratum", "rule").distinct().select("stratum", "rule", F.explode(F.sequence(F.lit(0), F.lit(BINS))).alias("bin"))
    per = every.join(per, ["stratum", "rule", "bin"], "left").fillna(0, ["good", "bad"])
    whole = Window.partitionBy("stratum", "rule")
    over = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    rows = per.select(
        "stratum", "rule", "bin",
        F.coalesce(F.sum("good").over(over), F.lit(0)).alias("good_rejected"), F.sum("good").over(whole).alias("n_good"),
        F.coalesce(F.sum("bad").over(over), F.lit(0)).alias("bad_rejected"), F.sum("bad").over(whole).alias("n_bad"),
    ).where(F.col("bin") < BINS)
    pairs = every.agg(F.countDistinct("stratum", "rule")).scalar()
    tested = rows.withColumn("tail", _tail("good_rejected", "n_good", F.lit(alpha / len(RULES)))).withColumn("passes", F.col("tail") <= F.lit(delta) / pairs)
    upto = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    safe = tested.withColumn("safe", F.min(F.col("passes").cast("int")).over(upto)).where("safe = 1")
    gain = F.coalesce(F.try_divide("bad_rejected", "n_bad"), F.lit(0.0)) - F.try_divide("good_rejected", "n_good")
    best = safe.withColumn("gain", gain).where(F.col("gain") >= least_gain).withColumn(
        "nth", F.row_number().over(whole.orderBy(F.desc("gain"), F.desc("bin")))
    ).where("nth = 1")
    step = F.element_at(F.create_map(*[F.lit(x) for rule, (_, s) in RULES.items() for x in (rule, s)]), F.col("rule"))
    return best.select("stratum", "rule", (F.col("bin") * step).alias("cutoff"), "n_good", "good_rejected", "n_bad", "bad_rejected", "tail")


def judge(rows: DataFrame, limits: DataFrame, stratum: Column, m: Column, out: str) -> DataFrame:
    """Add the array of rules that reject a row: empty where it is kept.  `limits` is one row per stratum and rule
    and is spread to one row per stratum."""
    limit, name = free_name(rows, "_limits"), free_name(rows, "_stratum")
    wide = limits.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias(limit))
    joined = rows.join(wide.withColumnRenamed("stratum", name), stratum == F.col(name), "left")
    broken = [F.when(score(m) > F.col(limit)[rule], F.lit(rule)) for rule, (score, _) in RULES.items()]
    rules = F.when(base_failed(m), F.array(F.lit("base"))).otherwise(F.array_compact(F.array(*broken)))
    return joined.withColumn(out, rules).drop(name, limit)


def stratum_of(docs: DataFrame, column: str = "lang") -> Column:
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def stage(steps, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Columns of `docs`; documents that a rule rejects go.  Texts are measured twice and never shuffled."""
    m, out = free_name(docs, "m"), free_name(docs, "rules")
    slim = docs.select("doc_id", "text", stratum_of(docs).alias("stratum"))
    limits = steps.store(cutoffs(steps.store(measure(slim, "m").select("doc_id", "stratum", "m")), labels))
    rows = judge(measure(docs, m), limits, F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col(m), out)
    return rows.where(F.size(out) == 0).select(*docs.columns)

"""Scores against labels: curves, areas, threshold metrics, histograms.

Rows are first counted per distinct score; running totals over scores are taken in
score-range blocks, never in one global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.operators.blocks import neighbours, range_block, running_sum
from gapline.operators.matrix import long_features


def score_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"), F.sum((F.col(label) == 0).cast("long")).alias("neg")
    )


def cumulative_counts(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest: `tp`, `fp` so far and the totals."""
    counts = score_counts(df, label, score, keys).withColumn("_down", -F.col("score"))
    blocked = range_block(counts, "_down")
    sums = running_sum(blocked, keys, "_block", "_down", {"tp": "pos", "fp": "neg"}, total=True)
    return sums.drop("_down", "_block")


def bends(counts: DataFrame, keys: Sequence[str], rule: str = "steps") -> DataFrame:
    """Points of a curve where it changes, from `score_counts`; a key's first and last point stay.

    `steps`: the step to the next point is another one than the step to this (the usual rule of curve drawing, which
    keeps points of a straight stretch with uneven steps).  `slopes`: the direction changes, compared by a product of
    whole numbers, so only corners stay.  Neighbours come from score ranges and their edges, never from one window.
    """
    if rule not in ("steps", "slopes"):
        raise ValueError(f"unknown rule {rule}")
    blocked = range_block(counts.withColumn("_down", -F.col("score")), "_down")
    rows = neighbours(blocked, keys, "_block", "_down", ["pos", "neg"])
    if rule == "steps":
        same = (F.col("pos") == F.col("_next.pos")) & (F.col("neg") == F.col("_next.neg"))
    else:
        wide = [F.col(c).cast("decimal(19,0)") for c in ("pos", "_next.neg", "neg", "_next.pos")]
        same = wide[0] * wide[1] == wide[2] * wide[3]
    edge = F.col("_prev").isNull() | F.col("_next").isNull()
    return rows.filter(edge | ~same).select(*keys, "score")


def roc_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), simplify: str | None = None) -> DataFrame:
    """False and true positive rate per threshold, with the (0, 0) point at an infinite one.

    `simplify` names a rule of `bends`; all distinct thresholds stay without it.
    """
    c = cumulative_counts(df, label, score, keys)
    if simplify:
        c = c.join(bends(c.select(*keys, "score", "pos", "neg"), keys, simplify), [*keys, "score"])
    points = c.select(
        *keys, F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.col("fp_total")).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp_total")).alias("tpr"),
    )
    origin = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    zero = origin.select(*keys, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(zero)


def pr_points(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """Precision and recall per threshold, with the closing (1, 0) point."""
    c = cumulative_counts(df, label, score, keys)
    points = c.select(
        *keys, F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp_total")).alias("recall"),
    )
    origin = points.select(*keys).distinct() if keys else points.sparkSession.range(1).select()
    end = origin.select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def ranking_metrics(df: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC area (ties averaged) and average precision; null when a class is missing."""
    c = cumulative_counts(df, label, score, keys)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    agg = c.groupBy(*keys).agg(
        area.alias("_a"), steps.alias("_s"), F.max("tp_total").cast("double").alias("_p"),
        F.max("fp_total").cast("double").alias("_n"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return agg.select(
        *keys, F.when(both, F.try_divide(F.col("_a"), F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.col("_s"), F.col("_p"))).alias("average_precision"),
    )


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and the rates built from them, one aggregation."""
    hit = F.col(score) >= threshold
    true = F.col(label) == 1

    def total(cond):
        return F.sum(cond.cast("long"))

    c = df.groupBy(*keys).agg(
        total(~hit & ~true).alias("tn"), total(hit & ~true).alias("fp"),
        total(~hit & true).alias("fn"), total(hit & true).alias("tp"),
    )

    def rate(a, b, default):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(default).cast("double"))

    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        *keys, "tn", "fp", "fn", "tp",
        rate(tp, tp + fp, 0.0).alias("precision"), rate(tp, tp + fn, 0.0).alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"), rate(tn, tn + fp, None).alias("specificity"),
        rate(tp, tp + fn, None).alias("sensitivity"),
    )


def confusion_table(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    return df.groupBy(
        F.col(label).cast("int").alias("y"), (F.col(score) >= threshold).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("n"))


def histogram_by_label(df: DataFrame, features: Sequence[str], label: str, bins: int = 40) -> DataFrame:
    """Equal-width counts per feature, label and bin over the pooled range, empty bins included.

    The last bin is closed; a constant feature gets half a unit to both sides.
    """
    long = long_features(df, features, [label]).filter(F.col("value").isNotNull())
    ends = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(
        "feature",
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("low"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("high"),
    )
    # one row per feature
    at = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins)
    binned = long.join(F.broadcast(ends), "feature").withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy("feature", label, "bin").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("feature", label).agg(F.sum("n").alias("_all"))
    frame = totals.join(ends, "feature").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    joined = frame.join(counts, ["feature", label, "bin"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    width = (F.col("high") - F.col("low")) / bins
    return joined.select(
        "feature", label, "bin", (F.col("low") + F.col("bin") * width).alias("bin_start"), n.alias("n"),
        (n / F.greatest(F.col("_all"), F.lit(1)) * 100.0).alias("pct"),
    )


def mean_score(df: DataFrame, keys: Sequence[str], score: str, out: str = "mean_score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias(out))


def align_scores(static_scores: DataFrame, sequence_scores: DataFrame, labels: DataFrame, entity: str,
                 static: str = "static_score", sequence: str = "sequence_score") -> DataFrame:
    """Entities with a static score, the mean of their sequence scores, and a label."""
    means = mean_score(sequence_scores, [entity], sequence, sequence)
    return static_scores.select(entity, static).join(means, entity).join(labels, entity)


def top_features(importance: DataFrame, n: int, by: str = "importance") -> DataFrame:
    """The n most important features (the report's limit)."""
    return importance.orderBy(F.desc(by), "feature").limit(n)

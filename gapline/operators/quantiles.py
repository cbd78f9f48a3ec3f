"""Exact quantiles of all columns of a table in two scans.

The first scan keeps a mergeable quantile sketch, the count and the moments of every column.  The sketch brackets the
wanted ranks: a narrow range of values around each.  The second scan counts the values below every bracket and the
distinct values inside, which are about two percent of the rows; the ranks are then found in these counts.  A bracket that
misses a rank is noticed by its counts and widened, so the result is exact whatever the sketch does.

With a `fold` column, each fold gets the result of all rows outside it.  Sketches, counts and moments are kept per fold and
merged for the folds that count, so more folds cost no further scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gapline.operators.blocks import CELLS_PER_BLOCK, running_sum

#: Size of a sketch; its rank error is about 1.5 / SKETCH.
SKETCH = 2_000
#: Half width of a bracket, as a share of all ranks.
MARGIN = 0.005


def _number(name: str) -> Column:
    """A column as double; NaN counts as missing."""
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def _sketched(df: DataFrame, columns: Sequence[str], fold: Column, margins: Sequence[float], leave_out: bool) -> list:
    """Per fold: brackets at the given quantiles, and (n, mean, variance) of each part that counts for it."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = _number(c)
        aggs += [
            F.kll_sketch_agg_double(x, F.lit(SKETCH)).alias(f"k{i}"),
            F.struct(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).alias(f"s{i}"),
        ]
    parts = df.groupBy(fold.alias("part")).agg(*aggs)
    names = [c for c in parts.columns if c != "part"]
    # one row with one entry per fold
    all_parts = parts.agg(F.collect_list(F.struct("part", *names)).alias("parts"))
    each = all_parts.select("parts", F.explode("parts.part").alias("fold")).select("fold", F.explode("parts").alias("p")).select("fold", "p.*")
    if leave_out:
        each = each.where(F.col("part") != F.col("fold"))
    merged = [F.sum("rows").alias("rows")]
    for i in range(len(columns)):
        known = F.when(F.col(f"s{i}.n") > 0, F.col(f"k{i}"))
        merged += [F.kll_merge_agg_double(known).alias(f"k{i}"), F.collect_list(f"s{i}").alias(f"s{i}"), F.sum(f"s{i}.n").alias(f"n{i}")]
    at = F.array(*[F.lit(float(m)) for m in margins])
    brackets = [F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"k{i}", at)).alias(f"b{i}") for i in range(len(columns))]
    return each.groupBy("fold").agg(*merged).select("fold", "rows", *[f"s{i}" for i in range(len(columns))], *brackets).collect()


def _counted(df: DataFrame, columns: Sequence[str], fold: Column, ranges: dict[int, tuple[float, float]]) -> DataFrame:
    """(part, i, v, n, below): counts of the values inside the ranges; rows with null i count the values below them."""
    pair = "struct<i:int,v:double>"
    entries = [F.when(_number(columns[i]).between(lo, hi), F.struct(F.lit(i).alias("i"), _number(columns[i]).alias("v"))).cast(pair) for i, (lo, hi) in ranges.items()]
    marker = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast("double").alias("v")))
    below = F.array(*[(_number(columns[i]) < lo).cast("int") for i, (lo, _) in ranges.items()])
    rows = df.select(fold.alias("part"), below.alias("below"), F.explode(F.concat(F.array_compact(F.array(*entries)), marker)).alias("p"))
    sums = [F.sum(F.when(F.col("i").isNull(), F.col("below")[k])).alias(f"b{i}") for k, i in enumerate(ranges)]
    return rows.select("part", "p.*", "below").groupBy("part", "i", "v").agg(F.count(F.lit(1)).alias("n"), *sums)


def column_statistics(df: DataFrame, columns: Sequence[str], q: float = 0.5, fold: str | None = None, work=None) -> list[dict]:
    """One dict per (fold, column): fold, column, rows, n, mean, variance and the exact interpolated quantile (None without values).

    Two scans of `df`; what comes to the driver are some numbers per fold and column.  With `fold`, the numbers of a fold
    are those of all other folds.  `work(table)` may store the counts of the second scan, which are read twice.
    """
    if not columns:
        return []
    spark = df.sparkSession
    part = F.col(fold) if fold else F.lit(0)
    out, margin = [], MARGIN
    sketched = _sketched(df, columns, part, [max(0.0, q - margin), min(1.0, q + margin)], fold is not None)
    for row in sketched:
        for i, c in enumerate(columns):
            seen = [s for s in row[f"s{i}"] if s["n"]]
            n = sum(s["n"] for s in seen)
            mean = sum(s["n"] * s["m"] for s in seen) / n if n else None
            variance = sum(s["n"] * (s["v"] + (s["m"] - mean) ** 2) for s in seen) / n if n else None
            at = (n - 1) * q
            out.append({
                "fold": row["fold"], "column": c, "i": i, "rows": row["rows"], "n": n, "mean": mean, "variance": variance, "quantile": None,
                "low": int(at) + 1, "high": int(at) + 1 + (at > int(at)), "share": at - int(at), "bracket": row[f"b{i}"],
            })
    open_ = [s for s in out if s["n"]]
    while open_:
        ranges = {i: (min(s["bracket"][0] for s in own), max(s["bracket"][1] for s in own)) for i in sorted({s["i"] for s in open_}) if (own := [s for s in open_ if s["i"] == i])}
        counts = _counted(df, columns, part, ranges)
        counts = work(counts) if work else counts.persist()
        try:
            below = {r["part"]: r for r in counts.where("i IS NULL").collect()}
            folds = sorted(below, key=lambda x: (x is None, x))
            lows = F.create_map(*[F.lit(v) for i, (lo, _) in ranges.items() for v in (i, float(lo))])[F.col("i")]
            highs = F.create_map(*[F.lit(v) for i, (_, hi) in ranges.items() for v in (i, float(hi))])[F.col("i")]
            per = counts.where("i IS NOT NULL").groupBy("i", "v").agg(*[F.sum(F.when(F.col("part").eqNullSafe(F.lit(f)), F.col("n")).otherwise(0)).alias(f"n{k}") for k, f in enumerate(folds)])
            place = F.try_divide(F.col("v") - lows, highs - lows) * CELLS_PER_BLOCK
            per = per.withColumn("_block", F.coalesce(F.floor(place), F.lit(0)))
            run = running_sum(per, ["i"], "_block", "v", {f"c{k}": f"n{k}" for k in range(len(folds))})
            wanted = []
            for s in open_:
                counted = [k for k, f in enumerate(folds) if fold is None or f != s["fold"]]
                under = sum(below[folds[k]][f"b{s['i']}"] or 0 for k in counted)
                wanted.append((s["i"], out.index(s), [k in counted for k in range(len(folds))], s["low"] - under, s["high"] - under))
            asked = spark.createDataFrame(wanted, "i int, at int, counted array<boolean>, low long, high long")
            upto = F.lit(0)
            for k in range(len(folds)):
                upto = upto + F.when(F.col("counted")[k], F.col(f"c{k}")).otherwise(0)
            met = run.join(asked, "i").withColumn("upto", upto)
            found = met.groupBy("at").agg(
                F.min(F.when(F.col("upto") >= F.col("low"), F.col("v"))).alias("first"), F.min(F.when(F.col("upto") >= F.col("high"), F.col("v"))).alias("second"),
                F.max("low").alias("low"),
            ).collect()
        finally:
            if not work:
                counts.unpersist()
        for r in found:
            if r["low"] >= 1 and r["second"] is not None:
                out[r["at"]]["quantile"] = r["first"] + out[r["at"]]["share"] * (r["second"] - r["first"])
        open_ = [s for s in open_ if s["quantile"] is None]
        if open_:  # the sketch missed a rank: a wider bracket, in the end the whole range
            margin = min(1.0, margin * 8)
            wider = _sketched(df, columns, part, [max(0.0, q - margin), min(1.0, q + margin)], fold is not None)
            by = {row["fold"]: row for row in wider}
            for s in open_:
                s["bracket"] = by[s["fold"]][f"b{s['i']}"]
    return [{k: s[k] for k in ("fold", "column", "rows", "n", "mean", "variance", "quantile")} for s in out]

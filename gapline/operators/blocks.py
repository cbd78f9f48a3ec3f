"""Ordered work that never sorts a whole key in one task.

A key (an entity, a class label, or the whole table) may own a large share of all
rows, so `Window.partitionBy(key)` over rows is avoided here.  Rows of a key are cut
into *blocks* that follow the sort order (time slices, hash prefixes, value ranges).
Each block is reduced to one summary row by an aggregation with map-side combine, the
summaries are scanned per key (their number is bounded by the block count, not by the
row count), and the carried state is joined back to the rows of the block.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapline.functions.clock import cell, micros

CELLS_PER_BLOCK = 4096
DAY_US = 86_400_000_000


def _cols(order) -> list[Column]:
    order = [order] if isinstance(order, (str, Column)) else list(order)
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _over(keys: Sequence[str], *order) -> "Window":
    part = list(keys) if keys else [F.lit(0)]
    return Window.partitionBy(*part).orderBy(*order)


def hash_block(rank_text, digits: int = 4) -> Column:
    """Block of a hexadecimal hash text: its leading digits (16**digits blocks)."""
    rank_text = F.col(rank_text) if isinstance(rank_text, str) else rank_text
    return F.substring(rank_text, 1, digits)


def one_row(df: DataFrame) -> Column:
    """The single row of an aggregate as a struct column (a scalar subquery)."""
    return df.select(F.struct(*[F.col(c) for c in df.columns])).scalar()


#: Ranges of an ordered table; each is one task of a running sum.
RANGES = 256
#: Values that choose the range boundaries of a text or mixed column.
BOUNDARY_SAMPLE = 4096


def range_block(df: DataFrame, value: str, blocks: int = RANGES, out: str = "_block") -> DataFrame:
    """Blocks that follow the order of a numeric column and hold like numbers of rows, whatever its distribution.

    Boundaries are approximate percentiles (a bounded sketch); nulls are in the first block.
    """
    x = F.col(value).cast("double")
    cuts = F.percentile_approx(x, F.array(*[F.lit(i / blocks) for i in range(1, blocks)]), F.lit(10_000))
    rows = df.withColumn("_cuts", one_row(df.agg(cuts.alias("at")))["at"])
    block = F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<double>")), lambda c: c <= x))
    return rows.withColumn(out, block).drop("_cuts")


def sampled_block(df: DataFrame, value: str, blocks: int = RANGES, out: str = "_block", sample: int = BOUNDARY_SAMPLE) -> DataFrame:
    """Blocks that follow the order of any sortable column; the table has one row per value or few.

    Boundaries come from the `sample` values with the smallest hashes, which are a random sample whatever the values
    look like.  Nulls are in the first block.
    """
    x = F.col(value)
    chosen = df.filter(x.isNotNull()).select(x.alias("v")).orderBy(F.xxhash64("v")).limit(sample).collect()
    values = sorted({r["v"] for r in chosen})
    cuts = sorted({values[len(values) * i // blocks] for i in range(1, blocks)}) if values else []
    if not cuts:
        return df.withColumn(out, F.lit(0))
    bounds = F.array(*[F.lit(c) for c in cuts])
    return df.withColumn(out, F.size(F.filter(bounds, lambda c: c <= x)))


def running_sum(
    df: DataFrame, keys: Sequence[str], block: str, order, sums: Mapping[str, str], total: bool = False
) -> DataFrame:
    """Add running sums (inclusive) per key in (block, order); with `total`, add `<out>_total` as well.

    `order` must be unique inside a block.
    """
    per = df.groupBy(*keys, block).agg(*[F.sum(col).alias(f"_b_{out}") for out, col in sums.items()])
    w = _over(keys, block)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*(list(keys) if keys else [F.lit(0)]))
    carry = [F.coalesce(F.sum(f"_b_{out}").over(before), F.lit(0)).alias(f"_c_{out}") for out in sums]
    if total:
        carry += [F.sum(f"_b_{out}").over(whole).alias(f"{out}_total") for out in sums]
    per = per.select(*keys, block, *carry)
    local = _over([*keys, block], *_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(per, [*keys, block])
    for out, col in sums.items():
        joined = joined.withColumn(out, F.sum(col).over(local) + F.col(f"_c_{out}"))
    return joined.drop(*[f"_c_{out}" for out in sums])


def block_rank(
    df: DataFrame, keys: Sequence[str], block: str, order, out: str = "rank", total: str | None = None
) -> DataFrame:
    """1-based row number per key in (block, order); with `total`, also the row count of the key."""
    per = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = _over(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    carry = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c")]
    if total:
        carry.append(F.sum("_n").over(Window.partitionBy(*(list(keys) if keys else [F.lit(0)]))).alias(total))
    per = per.select(*keys, block, *carry)
    local = _over([*keys, block], *_cols(order))
    return df.join(per, [*keys, block]).withColumn(out, F.row_number().over(local) + F.col("_c")).drop("_c")


def first_in_blocks(df: DataFrame, keys: Sequence[str], block: str, order, n) -> DataFrame:
    """The first n rows per key in (block, order); n is a number or a column that is the same for all rows of a key.

    Blocks behind the n-th row are left out by their counts, so only about n rows of a key are ranked.
    """
    per = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_n"))
    before = _over(keys, block).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, block, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    limit = F.lit(n) if isinstance(n, int) else n
    needed = df.join(per.filter(F.col("_c") < limit), [*keys, block])
    local = _over([*keys, block], *_cols(order))
    ranked = needed.withColumn("_rank", F.row_number().over(local) + F.col("_c"))
    return ranked.filter(F.col("_rank") <= limit).drop("_rank", "_c")


def neighbours(df: DataFrame, keys: Sequence[str], block: str, order: str, payload: Sequence[str]) -> DataFrame:
    """Add `_prev` and `_next`: the payload structs of the rows right before and after, also across blocks."""
    row = F.struct(*payload)
    edge = df.groupBy(*keys, block).agg(
        F.min_by(row, F.col(order)).alias("_first"), F.max_by(row, F.col(order)).alias("_last")
    )
    w = _over(keys, block)
    edge = edge.select(
        *keys, block, F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after")
    )
    local = _over([*keys, block], order)
    return (
        df.join(edge, [*keys, block])
        .withColumn("_row", row)
        .withColumn("_prev", F.coalesce(F.lag("_row").over(local), F.col("_before")))
        .withColumn("_next", F.coalesce(F.lead("_row").over(local), F.col("_after")))
        .drop("_row", "_before", "_after")
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_us: str,
    right_us: str,
    payload: Sequence[str],
    out: str = "_match",
    slice_us: int | None = None,
    forward: bool = False,
    strict: bool = False,
) -> DataFrame:
    """Left rows with the payload struct of the nearest right row at or before them.

    `forward` looks at or after instead; `strict` excludes equal times.  Times are
    microsecond columns; rows of a key are cut into time slices, and the last right row
    of earlier slices is carried in, so a task sees one slice of one key at most.  The
    slice width is measured unless it is given.  Right rows with equal times are ordered
    by their payload.
    """
    if slice_us is None:
        slice_us = min(measured_slice(left, keys, left_us), measured_slice(right, keys, right_us))
    sign = F.lit(-1 if forward else 1)
    keys = list(keys)
    left = left.filter(F.col(left_us).isNotNull()) if left_us in left.columns else left
    lhs = left.select(*keys, F.struct(*left.columns).alias("_l"), (F.col(left_us) * sign).alias("_t"))
    rhs = right.filter(F.col(right_us).isNotNull()).select(
        *keys, F.struct(*payload).alias("_p"), (F.col(right_us) * sign).alias("_t")
    )
    lhs = lhs.withColumn("_s", cell("_t", slice_us))
    rhs = rhs.withColumn("_s", cell("_t", slice_us))
    newest = rhs.groupBy(*keys, "_s").agg(F.max_by("_p", F.struct("_t", "_p")).alias("_p"))
    touched = lhs.select(*keys, "_s").distinct().withColumn("_p", F.lit(None).cast(newest.schema["_p"].dataType))
    per_slice = newest.unionByName(touched).groupBy(*keys, "_s").agg(F.max("_p").alias("_p"))
    earlier = _over(keys, "_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_slice.select(*keys, "_s", F.last("_p", ignorenulls=True).over(earlier).alias("_p")).filter(
        F.col("_p").isNotNull()
    )
    none_l = F.lit(None).cast(lhs.schema["_l"].dataType)
    none_p = F.lit(None).cast(newest.schema["_p"].dataType)
    # at equal times a right row sorts before (inclusive) or after (strict) the left row
    right_tag = 2 if strict else 0
    both = (
        lhs.select(*keys, "_s", "_t", F.lit(1).alias("_tag"), "_l", none_p.alias("_p"))
        .unionByName(rhs.select(*keys, "_s", "_t", F.lit(right_tag).alias("_tag"), none_l.alias("_l"), "_p"))
        .unionByName(
            carried.select(
                *keys, "_s", (F.col("_s") * slice_us).alias("_t"), F.lit(-1).alias("_tag"), none_l.alias("_l"), "_p"
            )
        )
    )
    running = _over([*keys, "_s"], "_t", "_tag", "_p").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_p", F.last("_p", ignorenulls=True).over(running))
        .filter(F.col("_tag") == 1)
        .select("_l.*", F.col("_p").alias(out))
    )


def gap_cells(df: DataFrame, keys: Sequence[str], ts: str, gap_us: int, at_equal: bool = False) -> DataFrame:
    """Gap clusters of a timeline as a small table: keys, `_cell`, `lo`, `hi`, `idx` (1-based).

    A new cluster starts where the distance to the previous row is above the gap (or
    equal to it, with `at_equal`).  Rows that share a time cell of one gap width are
    always in the same cluster, so rows are first reduced to their cells.
    """
    keys = list(keys)
    us = micros(ts)
    # a row without a key belongs to no entity: it is left out, as one without a time is
    known = F.col(ts).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    cells = (
        df.filter(known)
        .select(*keys, us.alias("_us"))
        .withColumn("_cell", cell("_us", gap_us))
        .groupBy(*keys, "_cell")
        .agg(F.min("_us").alias("lo"), F.max("_us").alias("hi"))
    )
    gap = F.lit(gap_us)

    def breaks(before: Column, after: Column) -> Column:
        wide = (after - before >= gap) if at_equal else (after - before > gap)
        return F.when(before.isNull() | wide, 1).otherwise(0)

    if gap_us >= DAY_US:
        # at most one cell per day and entity
        w = _over(keys, "_cell")
        flagged = cells.withColumn("_new", breaks(F.lag("hi").over(w), F.col("lo")))
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        return flagged.withColumn("idx", F.sum("_new").over(running).cast("int")).drop("_new")
    # at most CELLS_PER_BLOCK cells per block
    cells = cells.withColumn("_block", cell("_cell", CELLS_PER_BLOCK))
    w = _over([*keys, "_block"], "_cell")
    inner = cells.withColumn("_prev", F.lag("hi").over(w)).withColumn(
        "_new", F.when(F.col("_prev").isNull(), 0).otherwise(breaks(F.col("_prev"), F.col("lo")))
    )
    per = inner.groupBy(*keys, "_block").agg(
        F.sum("_new").alias("_inner"), F.min("lo").alias("_lo"), F.max("hi").alias("_hi")
    )
    wb = _over(keys, "_block")
    per = per.withColumn("_first", breaks(F.lag("_hi").over(wb), F.col("_lo")))
    before = wb.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *keys,
        "_block",
        (F.col("_first") + F.coalesce(F.sum(F.col("_inner") + F.col("_first")).over(before), F.lit(0))).alias("_c"),
    )
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        inner.join(per, [*keys, "_block"])
        .withColumn("idx", (F.sum("_new").over(running) + F.col("_c")).cast("int"))
        .select(*keys, "_cell", "lo", "hi", "idx")
    )


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float = 0.5,
    out: str = "quantile",
    buckets: int = CELLS_PER_BLOCK,
    levels: int = 2,
) -> DataFrame:
    """Exact interpolated quantile per key, for a few keys that hold far more rows than a task.

    Every level counts values in equal-width buckets (map-side combine), keeps the at
    most two buckets that hold the wanted ranks, and the next level looks inside those
    only; the last step counts the distinct values left.  `percentile` would hold all
    distinct values of a key in the memory of one task.  The keys are few (the features
    of a matrix), and so are the buckets sent to every task: two per key.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    at = (F.col("_n") - 1) * F.lit(q)
    bounds = (
        rows.groupBy(*keys)
        .agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_lo",
            "_hi",
            (F.floor(at) + 1).alias("_r1"),
            (F.ceil(at) + 1).alias("_r2"),
            (at - F.floor(at)).alias("_frac"),
            F.lit(0).cast("long").alias("_base"),
        )
    )
    path = list(keys)
    kept = ["_lo", "_hi", "_r1", "_r2", "_frac", "_base"]

    def holds(rank: str) -> Column:
        return (F.col("_base") < F.col(rank)) & (F.col(rank) <= F.col("_base") + F.col("_n"))

    for level in range(levels):
        b = f"_b{level}"
        spread = F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * buckets
        rows = (
            rows.join(F.broadcast(bounds), path)
            .withColumn(b, F.coalesce(F.least(F.floor(spread), F.lit(buckets - 1)), F.lit(0)))
        )
        counts = rows.groupBy(*path, b, "_r1", "_r2", "_frac", "_base").agg(
            F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
        )
        before = _over(path, b).rowsBetween(Window.unboundedPreceding, -1)
        bounds = (
            counts.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .filter(holds("_r1") | holds("_r2"))
            .drop("_n")
        )
        rows = rows.drop(*kept)
        path = [*path, b]
    left = rows.join(F.broadcast(bounds), path).groupBy(*path, "_v", "_r1", "_r2", "_frac", "_base").agg(F.count(F.lit(1)).alias("_n"))
    before = _over(path, "_v").rowsBetween(Window.unboundedPreceding, -1)
    left = left.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_n").over(before), F.lit(0)))
    low = F.max(F.when(holds("_r1"), F.col("_v")))
    high = F.max(F.when(holds("_r2"), F.col("_v")))
    result = left.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"), F.max("_frac").alias("_frac"))
    result = result.select(*keys, (F.col("_low") + F.col("_frac") * (F.col("_high") - F.col("_low"))).alias(out))
    return result.drop("_all")


def measured_slice(
    df: DataFrame, keys: Sequence[str], us: str, start_us: int = DAY_US, target_rows: int = 4_000_000
) -> int:
    """A slice width that leaves no (key, slice) above the target row count.

    One counting job with map-side combine per try; the width shrinks in proportion to
    the fullest slice until it fits or one second is reached.
    """
    width = start_us
    while True:
        counts = df.groupBy(*keys, cell(us, width).alias("_s")).agg(F.count(F.lit(1)).alias("n"))
        fullest = counts.agg(F.max("n")).first()[0]
        if fullest is None or fullest <= target_rows or width <= 1_000_000:
            return width
        width = max(1_000_000, min(width // 2, width * target_rows // fullest))

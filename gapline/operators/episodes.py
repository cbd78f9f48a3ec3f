"""Episodes of a timeline: gap splits, bounds, indexes and birth alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from gapline.functions.clock import cell, day_us, from_micros, micros, seconds_between
from gapline.functions.scalar import signed_hms
from gapline.operators.blocks import asof, block_rank, gap_cells, measured_slice, running_sum, sampled_block


def gap_episodes(
    df: DataFrame, keys: Sequence[str], ts: str, gap_us: int = 183 * day_us, at_equal: bool = False,
    out: str = "episode_idx",
) -> DataFrame:
    """Rows with the 1-based number of their gap episode; rows without a key or a time are dropped."""
    keys = list(keys)
    cells = gap_cells(df, keys, ts, gap_us, at_equal).select(*keys, "_cell", F.col("idx").alias(out))
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_cell", cell(micros(ts), gap_us))
    return rows.join(cells, [*keys, "_cell"]).drop("_cell")


def gap_episode_bounds(
    df: DataFrame, keys: Sequence[str], ts: str, gap_us: int = 183 * day_us, at_equal: bool = False,
    out: str = "episode_idx",
) -> DataFrame:
    """First and last time of every gap episode, straight from the cells; rows without a key or a time count nowhere."""
    cells = gap_cells(df, keys, ts, gap_us, at_equal)
    return (
        cells.groupBy(*keys, F.col("idx").alias(out))
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .select(*keys, out, from_micros("lo").alias("ep_start"), from_micros("hi").alias("ep_end"))
    )


def episode_rows_with_bounds(
    df: DataFrame, keys: Sequence[str], ts: str, gap_us: int = 183 * day_us, out: str = "episode_idx"
) -> DataFrame:
    """Rows with episode number, `ep_start_us` and `ep_end_us`; the rows move once.  Rows without a key or a time are
    dropped."""
    keys = list(keys)
    cells = gap_cells(df, keys, ts, gap_us)
    # an episode has at most one cell per gap width of its life
    whole = Window.partitionBy(*keys, "idx")
    cells = cells.select(
        *keys, "_cell", F.col("idx").alias(out),
        F.min("lo").over(whole).alias("ep_start_us"), F.max("hi").over(whole).alias("ep_end_us"),
    )
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_cell", cell(micros(ts), gap_us))
    return rows.join(cells, [*keys, "_cell"]).drop("_cell")


def episode_bounds(df: DataFrame, keys: Sequence[str], ts: str, episode: str = "episode_idx") -> DataFrame:
    return df.groupBy(*keys, episode).agg(F.min(ts).alias("ep_start"), F.max(ts).alias("ep_end"))


def first_event(df: DataFrame, keys: Sequence[str], ts: str, out: str = "anchor") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias(out))


def pregnancy_index(bounds: DataFrame, keys: Sequence[str], start: str = "ep_start", out: str = "pregnancy_index") -> DataFrame:
    """Episodes numbered by start; an entity has at most one episode per gap width."""
    order = Window.partitionBy(*keys).orderBy(start)
    return bounds.withColumn(out, F.row_number().over(order))


def birth_index(
    births: DataFrame, keys: Sequence[str], ts: str, tie: Sequence[str] = (), slice_us: int | None = None,
    out: str = "pregnancy_index",
) -> DataFrame:
    """Births numbered by time per entity; every child row counts.  Rows without a key or a time are dropped."""
    rows = births.dropna(subset=[*keys, ts]).withColumn("_us", micros(ts))
    rows = rows.withColumn("_block", cell("_us", slice_us or measured_slice(rows, keys, "_us", 365 * day_us)))
    return block_rank(rows, keys, "_block", [ts, *tie], out).drop("_block", "_us")


def static_index(
    mothers: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str, out: str = "pregnancy_index"
) -> DataFrame:
    """Static rows numbered per entity by the order columns (nulls last), then by input order.

    Rows without a key are dropped.  Blocks are the order values plus a stretch of the input order.
    """
    last = F.lit(float("inf"))
    levels = [F.coalesce(F.col(c).cast("double"), last).alias(f"o{i}") for i, c in enumerate(order)]
    block = F.struct(*levels, cell(F.col(seq).cast("long"), 1 << 20).alias("part"))
    return block_rank(mothers.dropna(subset=list(keys)).withColumn("_block", block), keys, "_block", seq, out).drop("_block")


def delivery_episodes(
    df: DataFrame, keys: Sequence[str], delivery: str, gap_us: int = 183 * day_us, out: str = "episode_idx"
) -> DataFrame:
    """Episodes by delivery time, numbered from 0 over the whole table in key order.

    Within an entity a new number starts where the next delivery is at least one gap
    after the previous one.  Rows without a delivery time stay in the entity's last
    episode (its only one when no row has a delivery time).  Rows without a key are dropped.
    """
    keys = list(keys)
    df = df.dropna(subset=keys)
    cells = gap_cells(df, keys, delivery, gap_us, at_equal=True).select(*keys, "_cell", F.col("idx").alias("_local"))
    entities = df.select(*keys).distinct()
    counts = cells.groupBy(*keys).agg(F.max("_local").alias("_n"))
    counts = entities.join(counts, keys, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    counts = _global_offsets(counts, keys)
    rows = df.withColumn("_cell", cell(micros(delivery), gap_us))
    joined = rows.join(cells, [*keys, "_cell"], "left").join(counts, keys)
    return joined.withColumn(
        out, (F.col("_offset") + F.coalesce(F.col("_local"), F.col("_n")) - 1).cast("long")
    ).drop("_cell", "_local", "_n", "_offset")


def _global_offsets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Episodes of all entities before each one, in key order.

    Entities are cut into ranges of like size; range totals are scanned, not the entities.
    """
    summed = running_sum(sampled_block(counts, keys[0]), [], "_block", list(keys), {"_upto": "_n"})
    return summed.withColumn("_offset", F.col("_upto") - F.col("_n")).drop("_upto", "_block")


def match_births(
    bounds: DataFrame, births: DataFrame, keys: Sequence[str], birth: str = "birth_datetime",
    start: str = "ep_start", end: str = "ep_end", slice_us: int | None = None,
) -> DataFrame:
    """Each episode with its birth: the first one inside, else the one nearest to the start (ties: the later)."""
    own = births.filter(F.col(birth).isNotNull()).select(*keys, micros(birth).alias("_b"))
    rows = bounds.withColumn("_s", micros(start)).withColumn("_e", micros(end))
    # episodes of an entity are few, births decide the width
    slice_us = slice_us or measured_slice(own, keys, "_b", 30 * day_us)
    rows = asof(rows, own, keys, "_s", "_b", ["_b"], "_after", slice_us, forward=True)
    rows = asof(rows, own, keys, "_s", "_b", ["_b"], "_before", slice_us, strict=True)
    after, before = F.col("_after._b"), F.col("_before._b")
    chosen = (
        F.when(after <= F.col("_e"), after)
        .when(before.isNull(), after)
        .when(after.isNull(), before)
        .when(after - F.col("_s") <= F.col("_s") - before, after)
        .otherwise(before)
    )
    return rows.withColumn(birth, from_micros(chosen)).drop("_s", "_e", "_after", "_before")


def attach_birth(rows: DataFrame, bounds: DataFrame, keys: Sequence[str], ts: str, episode: str = "episode_idx",
                 birth: str = "birth_datetime") -> DataFrame:
    """Timeline rows with the birth of their episode and the signed distance to it."""
    own = bounds.select(*keys, episode, birth)
    return add_birth_distance(rows.join(own, [*keys, episode], "left"), ts, birth)


def add_birth_distance(rows: DataFrame, ts: str, birth: str = "birth_datetime") -> DataFrame:
    return rows.withColumn("t_from_birth_sec", seconds_between(ts, birth)).withColumn(
        "t_from_birth_str", signed_hms("t_from_birth_sec")
    )


def contain_in_episode(
    rows: DataFrame, bounds: DataFrame, keys: Sequence[str], ts: str, payload: Sequence[str],
    start: str = "ep_start", end: str = "ep_end", slice_us: int | None = None,
) -> DataFrame:
    """Rows with the payload of the episode whose closed interval holds them, else nulls."""
    spans = bounds.withColumn("_start", micros(start)).withColumn("_end", micros(end))
    timed = rows.withColumn("_t", micros(ts))
    found = asof(timed, spans, keys, "_t", "_start", ["_end", *payload], "_ep", slice_us)
    inside = F.col("_t") <= F.col("_ep._end")
    for name in payload:
        found = found.withColumn(name, F.when(inside, F.col(f"_ep.{name}")))
    return found.drop("_t", "_ep")


def prune_around_birth(rows: DataFrame, before_h: float | None, after_h: float | None) -> DataFrame:
    """Rows whose distance to birth lies in [-before, after] hours; an open side is unlimited."""
    if before_h is None and after_h is None:
        return rows
    t = F.col("t_from_birth_sec")
    keep = t.isNotNull()
    if before_h is not None:
        keep = keep & (t >= -3600.0 * before_h)
    if after_h is not None:
        keep = keep & (t <= 3600.0 * after_h)
    return rows.filter(keep)


def minutes_from_start(rows: DataFrame, keys: Sequence[str], ts: str, out: str = "mins_postpartum") -> DataFrame:
    """Minutes since the first row of the episode."""
    starts = rows.groupBy(*keys).agg(F.min(ts).alias("episode_start"))
    joined = rows.join(starts, list(keys))
    return joined.withColumn(out, (micros(ts) - micros("episode_start")) / F.lit(6e7))

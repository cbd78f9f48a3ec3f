"""Snapshot features after delivery: vitals, sparse labs, interventions and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gapline.functions.clock import from_micros, micros
from gapline.functions.scalar import clip
from gapline.operators.grids import baseline, grid_last, grid_windows, last_open_point, open_grid

VITAL_STATS = (
    "measured", "last_abs", "mean_abs", "std_abs", "min_abs", "max_abs", "slope_abs", "recency_s", "baseline",
    "delta_last", "pct_last", "delta_mean",
)
LAB_STATS = ("measured", "last", "recency_s", "baseline", "delta_last")


def after_delivery(df: DataFrame, ts: str = "ts", delivery: str = "delivery_time") -> DataFrame:
    return df.filter(F.col(ts) >= F.col(delivery))


def delivery_spans(df: DataFrame, keys: Sequence[str], ts: str, delivery: str, longest_us: int) -> DataFrame:
    """Grid origin (delivery) and end per key: the last time, at most the longest stretch after delivery."""
    spans = df.groupBy(*keys).agg(
        F.min(micros(delivery)).alias("start_us"), F.max(micros(ts)).alias("_last")
    )
    return spans.select(*keys, "start_us", F.least(F.col("_last"), F.col("start_us") + longest_us).alias("end_us"))


def delivery_offsets(long: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, step_us: int) -> DataFrame:
    joined = long.join(spans, list(keys))
    return joined.withColumn("offset_us", micros(ts) - F.col("start_us")).withColumn(
        "last_point", last_open_point("start_us", "end_us", step_us)
    )


def vital_features(
    samples: DataFrame, keys: Sequence[str], step_us: int, lookback_us: int, baseline_us: int, age_cap_s: float,
    signal: str = "signal", seq: str | None = None,
) -> DataFrame:
    """Look-back statistics, newest value and age, slope and baseline distances per (keys, signal, point)."""
    width = lookback_us // step_us
    if width * step_us != lookback_us:
        raise ValueError("the look-back must be a whole number of steps")
    stats = grid_windows(
        samples, keys, step_us, {"w": width}, signal, closed=True, history=True, medians=False, min_samples=1, seq=seq,
        as_float=False,
    )
    base = baseline(samples, keys, baseline_us, signal, seq=seq)
    rows = stats.join(base, [*keys, signal], "left")
    point_us = F.col("i") * step_us
    last, b = F.col("history_last"), F.col("baseline")
    span = (point_us - F.col("w_first_offset_us")) / F.lit(1e6)
    some = F.col("w_n") > 0
    mean = F.when(some, F.col("_mean"))
    rows = rows.withColumn("_mean", F.coalesce(F.col("w_mean"), F.col("w_last"))).withColumn(
        "_std", F.coalesce(F.col("w_std"), F.lit(0.0))
    )
    return rows.select(
        *keys, signal, "i",
        F.lit(1).alias("measured"),
        last.alias("last_abs"),
        mean.alias("mean_abs"),
        F.when(some, F.col("_std")).alias("std_abs"),
        F.col("w_min").alias("min_abs"),
        F.col("w_max").alias("max_abs"),
        F.when(some & (span > 0), (last - F.col("w_first")) / span).alias("slope_abs"),
        clip((point_us - F.col("history_offset_us")) / F.lit(1e6), 0, age_cap_s).alias("recency_s"),
        "baseline",
        (last - b).alias("delta_last"),
        F.when(b != 0, (last - b) / b * 100.0).alias("pct_last"),
        (mean - b).alias("delta_mean"),
    )


def lab_features(
    samples: DataFrame, keys: Sequence[str], step_us: int, baseline_us: int, age_cap_s: float,
    signal: str = "signal", seq: str | None = None,
) -> DataFrame:
    """Newest value and age, baseline and distance per (keys, signal, point)."""
    last = grid_last(samples, keys, step_us, signal, seq=seq, as_float=False)
    rows = last.join(baseline(samples, keys, baseline_us, signal, seq=seq), [*keys, signal], "left")
    age = (F.col("i") * step_us - F.col("last_offset_us")) / F.lit(1e6)
    return rows.select(
        *keys, signal, "i", F.lit(1).alias("measured"), F.col("last_value").alias("last"),
        clip(age, 0, age_cap_s).alias("recency_s"), "baseline",
        (F.col("last_value") - F.col("baseline")).alias("delta_last"),
    )


def intervention_features(
    samples: DataFrame, keys: Sequence[str], step_us: int, age_cap_min: float, signal: str = "signal"
) -> DataFrame:
    """Given flag and minutes since the newest administration; `samples` hold given rows only."""
    last = grid_last(samples, keys, step_us, signal)
    age = (F.col("i") * step_us - F.col("last_offset_us")) / F.lit(6e7)
    return last.select(*keys, signal, "i", F.lit(1).alias("given"), clip(age, 0, age_cap_min).alias("minutes"))


def assemble(
    grid: DataFrame, keys: Sequence[str], step_us: int, vitals: DataFrame, vital_names: Sequence[str],
    labs: DataFrame, lab_names: Sequence[str], drugs: DataFrame, drug_names: Sequence[str], settings,
    vital_base: DataFrame | None = None, signal: str = "signal",
) -> DataFrame:
    """Wide snapshot rows: all grid points, with the defaults of signals not seen yet.

    Baselines exist from the first snapshot on, so they join per key, not per point.
    """
    keys = list(keys)

    def long(df: DataFrame, kind: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (*keys, signal, "i", "baseline")]
        return df.select(*keys, "i", F.lit(kind).alias("_kind"), signal, *[F.col(c).cast("double").alias(f"{kind}_{c}") for c in rest])

    both = grid.select(*keys, "i").unionByName(long(vitals, "v"), allowMissingColumns=True)
    both = both.unionByName(long(labs, "l"), allowMissingColumns=True)
    both = both.unionByName(long(drugs, "d"), allowMissingColumns=True)

    def pick(kind: str, name: str, col: str) -> Column:
        return F.max(F.when((F.col("_kind") == kind) & (F.col(signal) == name), F.col(f"{kind}_{col}")))

    cells = []
    for v in vital_names:
        for stat in VITAL_STATS:
            if stat == "baseline":
                continue
            x = pick("v", v, stat)
            if stat == "measured":
                x = F.coalesce(x, F.lit(0.0)).cast("int")
            if stat == "recency_s":
                x = F.coalesce(x, F.lit(settings.vital_age_cap_s))
            cells.append(x.alias(f"{v}_{stat}"))
    for name in lab_names:
        for stat in LAB_STATS:
            if stat == "baseline":
                continue
            x = pick("l", name, stat)
            if stat == "measured":
                x = F.coalesce(x, F.lit(0.0)).cast("int")
            if stat == "recency_s":
                x = F.coalesce(x, F.lit(settings.lab_age_cap_s))
            cells.append(x.alias(f"{name.lower()}_{stat}"))
    for name in drug_names:
        cells.append(F.coalesce(pick("d", name, "given"), F.lit(0.0)).cast("int").alias(f"{name.lower()}_given"))
        minutes = F.coalesce(pick("d", name, "minutes"), F.lit(float("inf")))
        cells.append(minutes.alias(f"time_since_{name.lower()}_min"))
    wide = both.groupBy(*keys, "i").agg(*cells)
    if vital_base is not None:
        names = [*vital_names, *lab_names]
        base = vital_base.groupBy(*keys).agg(
            *[F.max(F.when(F.col(signal) == n, F.col("baseline"))).alias(
                f"{n}_baseline" if n in vital_names else f"{n.lower()}_baseline") for n in names]
        )
        wide = wide.join(base, keys, "left")
    return wide


def sequences(
    samples: DataFrame, spans: DataFrame, keys: Sequence[str], step_us: int, channels: Sequence[str],
    baseline_us: int, cap: int, signal: str = "signal", seq: str | None = None,
) -> DataFrame:
    """One row per episode: `T_used` and `x`, the first `cap` grid points of [values, values - baselines].

    Only points below the cap are gathered, so a sequence holds at most `cap` steps.
    """
    keys = list(keys)
    grid = open_grid(spans, keys, "start_us", "end_us", step_us).filter(F.col("i") < cap)
    last = grid_last(samples, keys, step_us, signal, seq=seq).filter(F.col("i") < cap)
    base = baseline(samples, keys, baseline_us, signal, seq=seq)
    both = grid.select(*keys, "i").unionByName(
        last.select(*keys, "i", signal, F.col("last_value").alias("_v")), allowMissingColumns=True
    )
    names = {c: f"_{k}" for k, c in enumerate(channels)}
    wide = both.groupBy(*keys, "i").agg(
        *[F.max(F.when(F.col(signal) == c, F.col("_v"))).alias(n) for c, n in names.items()]
    )
    own = base.groupBy(*keys).agg(
        *[F.max(F.when(F.col(signal) == c, F.col("baseline"))).cast("float").alias(f"{n}b") for c, n in names.items()]
    )
    wide = wide.join(own, keys, "left")
    values = [F.col(n).cast("float") for n in names.values()]
    deltas = [(F.col(n).cast("float") - F.col(f"{n}b")).cast("float") for n in names.values()]
    step = F.struct("i", F.array(*values, *deltas).alias("x"))
    gathered = wide.groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    return gathered.select(*keys, F.size("_steps").alias("T_used"), F.transform("_steps", lambda s: s["x"]).alias("x"))


def snapshot_column(wide: DataFrame, spans: DataFrame, keys: Sequence[str], step_us: int) -> DataFrame:
    own = spans.select(*keys, "start_us")
    return wide.join(own, list(keys)).withColumn(
        "snapshot_time", from_micros(F.col("start_us") + F.col("i") * step_us)
    ).drop("start_us")

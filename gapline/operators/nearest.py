"""Nearest-row matches inside one timeline and windows before an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.functions.clock import cell, from_micros, micros
from gapline.operators.blocks import asof, measured_slice, neighbours


def nearest_other_row(
    df: DataFrame, keys: Sequence[str], ts: str, source: Sequence[str], target: Sequence[str],
    slice_us: int | None = None,
) -> DataFrame:
    """Each row with the target columns of the nearest other row of its key (ties: the earlier).

    Times are unique per key.  Rows without another row, and rows whose match has no
    target value, are dropped.
    """
    rows = df.filter(F.col(ts).isNotNull()).withColumn("_t", micros(ts))
    rows = rows.withColumn("_s", cell("_t", slice_us or measured_slice(rows, keys, "_t")))
    named = {c: f"_t_{i}" for i, c in enumerate(target)}
    rows = rows.select(*keys, ts, "_t", "_s", *source, *[F.col(c).alias(n) for c, n in named.items()])
    rows = neighbours(rows, keys, "_s", "_t", ["_t", *named.values()])
    back, ahead = F.col("_t") - F.col("_prev._t"), F.col("_next._t") - F.col("_t")
    use_prev = F.col("_prev").isNotNull() & (F.col("_next").isNull() | (back <= ahead))
    hit = F.when(use_prev, F.col("_prev")).otherwise(F.col("_next"))
    some = F.lit(False)
    for n in named.values():
        some = some | hit[n].isNotNull()
    return rows.filter(hit.isNotNull() & some).select(
        *keys, ts, *source, *[hit[n].alias(c if c not in source else f"{c}_near") for c, n in named.items()]
    )


def latest_within(
    snapshots: DataFrame, events: DataFrame, keys: Sequence[str], at: str, event_time: str, tolerance_us: int,
    out: str = "trigger_dose_time", slice_us: int | None = None,
) -> DataFrame:
    """Snapshots with the newest event at or before them, if it is not older than the tolerance (closed)."""
    left = snapshots.withColumn("_t", micros(at))
    right = events.select(*keys, micros(event_time).alias("_d")).distinct()
    found = asof(left, right, keys, "_t", "_d", ["_d"], "_m", slice_us)
    hit = F.col("_m._d")
    return found.withColumn(out, F.when(F.col("_t") - hit <= tolerance_us, from_micros(hit))).drop("_t", "_m")

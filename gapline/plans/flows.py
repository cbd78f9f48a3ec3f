"""Short flows composed of the operators: static table, raw pressure pairs, event-marked series, label outputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.config import ENTITY, PRESSURE_NAMES
from gapline.functions.scalar import lenient_double
from gapline.operators import labels as label_ops
from gapline.operators import statics
from gapline.operators.episodes import minutes_from_start
from gapline.operators.matrix import sample_per_class
from gapline.operators.nearest import nearest_other_row
from gapline.operators.reshape import pivot_first
from gapline.sources.writers import materialize


def static_table(mothers: DataFrame, newborns: DataFrame | None, work: str | None = None) -> DataFrame:
    """Slim static columns per pregnancy with newborn aggregates, or singleton defaults where there are none."""
    static = statics.mothers_static(mothers)
    if newborns is not None:
        static = statics.join_newborns(static, statics.newborns_basic(newborns), defaults=True)
    return materialize(mothers.sparkSession, f"{work}/static", lambda: static) if work else static


def raw_measurements(rows: DataFrame, seq: str, kept: Sequence[str], spellings: Mapping[str, Sequence[str]] = PRESSURE_NAMES) -> DataFrame:
    """Raw (name, value) rows to one row per (entity, time): first value per name, spellings of a pressure coalesced."""
    names = [*kept, *[n for group in spellings.values() for n in group]]
    number = rows.withColumn("_value", lenient_double("ResultNumeric"))
    wide = pivot_first(number, [ENTITY, "parameter_time"], "Parameter_Name", "_value", seq, names)
    both = {out: F.coalesce(*[F.col(f"`{n}`") for n in group]) for out, group in spellings.items()}
    return wide.select(ENTITY, "parameter_time", *[F.col(f"`{n}`") for n in kept], *[x.alias(out) for out, x in both.items()])


def nearest_measurements(rows: DataFrame, seq: str, source: Sequence[str], target: Sequence[str], **settings) -> DataFrame:
    """Raw rows to source values with the target values of the nearest other measured time of the entity."""
    wide = raw_measurements(rows, seq, [c for c in (*source, *target) if c not in ("diastolic", "systolic")], **settings)
    return nearest_other_row(wide, [ENTITY], "parameter_time", source, target)


def event_marked_series(rows: DataFrame, marks: DataFrame, keys: Sequence[str], signals: Sequence[str], n: int, seed: int,
                        ts: str = "snapshot_time") -> DataFrame:
    """Measured rows of n sampled episodes per class, minutes from the episode's start, and its first positive time.

    The sample size is the feature: a report of n episodes with and n without an event.
    """
    first = label_ops.first_positive(marks, keys, ts)
    chosen = sample_per_class(first, "bleed_flag", keys, n, seed)
    own = rows.join(chosen, list(keys))
    timed = minutes_from_start(own, keys, ts)
    event = (F.col("first_bleed_time").cast("timestamp").cast("double") - F.col("episode_start").cast("timestamp").cast("double")) / 60
    return timed.withColumn("first_event_min", event).select(
        *keys, ts, "mins_postpartum", *signals, "bleed_flag", "first_event_min"
    )


def labelled_outputs(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled rows, label vector): the vector has the key columns that are there, and labels are 0 or 1 throughout."""
    label_ops.assert_binary(labelled)
    names = [ENTITY, "episode_idx", "pregnancy_index", "snapshot_time", "label"]
    return labelled, labelled.select(*[c for c in names if c in labelled.columns])

"""Postpartum timeline parts to snapshot features and to fixed-channel sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.config import CANONICAL_VITALS, ENTITY, PostpartumSettings, SequenceSettings
from gapline.functions.clock import lenient_timestamp
from gapline.functions.scalar import lenient_double, positive_flag
from gapline.operators import postpartum as pp
from gapline.operators import reshape
from gapline.operators.episodes import delivery_episodes
from gapline.operators.grids import baseline, open_grid


def standardize(
    rows: DataFrame, vitals=CANONICAL_VITALS, labs: Sequence[str] = (), drugs: Sequence[str] = (),
    entity: str = "mother_id", ts: str = "event_time_abs", delivery: str = "birth_datetime",
) -> DataFrame:
    """Canonical names and types, missing signals as null and drugs as 0, rows from delivery on."""
    rows = reshape.rename(rows, {ENTITY: entity, ts: "ts", delivery: "delivery_time", **vitals})
    types = dict(rows.dtypes)
    rows = rows.withColumns(
        {c: lenient_timestamp(c) for c in ("ts", "delivery_time") if not types[c].startswith("timestamp")}
    )
    rows = reshape.ensure_columns(rows, [*vitals.values(), *labs])
    rows = rows.withColumns({c: lenient_double(f"`{c}`") for c in (*vitals.values(), *labs)})
    rows = reshape.ensure_columns(rows, drugs, F.lit(0))
    rows = rows.withColumns({c: positive_flag(c) for c in drugs})
    return pp.after_delivery(rows)


def postpartum_features(
    rows: DataFrame, static: DataFrame | None = None, settings: PostpartumSettings = PostpartumSettings(),
    entity: str = "mother_id", seq: str | None = None,
) -> DataFrame:
    """Snapshot features after delivery for all entities in one job."""
    keys = [entity]
    step = settings.step_us
    spans = pp.delivery_spans(rows, keys, "ts", "delivery_time", settings.longest_us)
    grid = open_grid(spans, keys, "start_us", "end_us", step)
    more = [seq] if seq else []

    def samples(columns: Sequence[str]) -> DataFrame:
        return pp.delivery_offsets(reshape.melt(rows, [entity, "ts", *more], columns), spans, keys, "ts", step)

    vitals, labs = samples(settings.vitals), samples(settings.labs)
    given = samples(settings.drugs).filter("value = 1")
    wide = pp.assemble(
        grid, keys, step,
        pp.vital_features(vitals, keys, step, settings.lookback_us, settings.baseline_us, settings.vital_age_cap_s, seq=seq),
        settings.vitals,
        pp.lab_features(labs, keys, step, settings.baseline_us, settings.lab_age_cap_s, seq=seq),
        settings.labs,
        pp.intervention_features(given, keys, step, settings.drug_age_cap_min),
        settings.drugs, settings,
        vital_base=baseline(samples([*settings.vitals, *settings.labs]), keys, settings.baseline_us, seq=seq),
    )
    out = pp.snapshot_column(wide, spans, keys, step).drop("i")
    return out if static is None else out.join(static, entity, "left")


def episode_sequences(
    rows: DataFrame, settings: SequenceSettings = SequenceSettings(), entity: str = "mother_id", seq: str | None = None
) -> DataFrame:
    """Delivery episodes and their channel sequences."""
    keys = [entity, "episode_idx"]
    rows = delivery_episodes(rows, [entity], "delivery_time", settings.delivery_gap_us)
    spans = pp.delivery_spans(rows, keys, "ts", "delivery_time", settings.longest_us)
    long = reshape.melt(rows, [*keys, "ts", *([seq] if seq else [])], settings.channels)
    samples = pp.delivery_offsets(long, spans, keys, "ts", settings.step_us)
    return pp.sequences(samples, spans, keys, settings.step_us, settings.channels, settings.baseline_us, settings.cap, seq=seq)

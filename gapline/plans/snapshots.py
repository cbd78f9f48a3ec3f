"""Timeline to hourly snapshots: window features, personal deltas, labels and static columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.config import DERIVED_PLAUSIBLE, ENTITY, PLAUSIBLE, SnapshotSettings
from gapline.functions.clock import from_micros, micros
from gapline.functions.scalar import mean_pressure, pulse_pressure, shock_index, within
from gapline.operators import episodes as ep
from gapline.operators import reshape, statics
from gapline.operators.grids import STATS, closed_grid, grid_last, grid_windows, offsets, spread_signals
from gapline.operators.labels import label_last_before_event
from gapline.operators.matrix import balanced_sample, dose_presence, frequency_filter
from gapline.sources.writers import materialize

EPISODE = [ENTITY, "episode_idx"]
TS = "event_time_abs"
DERIVED = ("MAP", "SI", "PP")


def masked_signals(
    timeline: DataFrame, signals: Sequence[str], plausible: Mapping = PLAUSIBLE, derived: Mapping = DERIVED_PLAUSIBLE,
    sys: str = "sistol", dia: str = "diastol", pulse: str = "pulse",
) -> tuple[DataFrame, list[str]]:
    """Timeline with implausible values nulled and the derived pressure signals added."""
    rows = reshape.mask_implausible(reshape.ensure_columns(timeline, signals), plausible)
    new = {}
    if sys in timeline.columns and dia in timeline.columns:
        new["MAP"] = mean_pressure(F.col(f"`{sys}`"), F.col(f"`{dia}`"))
        new["PP"] = pulse_pressure(F.col(f"`{sys}`"), F.col(f"`{dia}`"))
    if sys in timeline.columns and pulse in timeline.columns:
        new["SI"] = shock_index(F.col(f"`{pulse}`"), F.col(f"`{sys}`"))
    rows = rows.withColumns({name: within(x, derived.get(name)) for name, x in new.items()})
    return rows, [*signals, *[d for d in DERIVED if d in new]]


def add_index(timeline: DataFrame, gap_us: int) -> DataFrame:
    """Episode and pregnancy numbers; existing episode numbers are kept."""
    if "episode_idx" not in timeline.columns:
        timeline = ep.gap_episodes(timeline, [ENTITY], TS, gap_us)
    bounds = ep.pregnancy_index(ep.episode_bounds(timeline, [ENTITY], TS), [ENTITY])
    return timeline.join(bounds.select(*EPISODE, "pregnancy_index"), EPISODE)


def select_episodes(timeline: DataFrame, doses: DataFrame, settings: SnapshotSettings) -> DataFrame:
    """Frequency filter, then at most n episodes per dose class."""
    vitals = [s for s in settings.signals if s in timeline.columns]
    rows = frequency_filter(timeline, ENTITY, TS, vitals, doses, settings.min_vital_frequency)
    if settings.sample_per_class is None:
        return rows
    episodes = dose_presence(rows.select(*EPISODE).distinct(), doses, EPISODE)
    kept = balanced_sample(episodes, "has_dose", EPISODE, settings.sample_per_class, settings.seed)
    return reshape.semi_join(rows, kept, EPISODE)


def snapshot_features(
    timeline: DataFrame, doses: DataFrame | None = None, static: DataFrame | None = None,
    settings: SnapshotSettings = SnapshotSettings(), plausible: Mapping = PLAUSIBLE,
    derived: Mapping = DERIVED_PLAUSIBLE, roles: Mapping[str, str] | None = None,
    baseline_columns: Mapping[str, str] | None = None, work: str | None = None, deltas_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(features, labels) per kept snapshot.

    `timeline` is wide, with entity, time, episode and pregnancy number.  All episodes
    run as one job: samples shrink to panes, panes are repeated for the windows that see them, and only
    snapshots that keep a label are spread to columns.  `work` names a shared folder for
    the samples and episode spans, which several steps read; without it they are
    computed each time.  With `deltas_only` the features are the distances to the static
    baselines alone, from the newest sample of the fine window; no other statistic is formed.
    """
    if deltas_only and static is None:
        raise ValueError("distances need static baselines")
    roles = {"sys": "sistol", "dia": "diastol", "pulse": "pulse", **(roles or {})}
    rows, signals = masked_signals(timeline, settings.signals, plausible, derived, **roles)
    if work:
        spark, masked = timeline.sparkSession, rows
        rows = materialize(spark, f"{work}/masked", lambda: masked)
    spans = rows.groupBy(*EPISODE).agg(
        F.max("pregnancy_index").cast("int").alias("pregnancy_index"), F.min(micros(TS)).alias("start_us"),
        F.max(micros(TS)).alias("end_us"),
    )
    if work:
        measured = spans
        spans = materialize(spark, f"{work}/spans", lambda: measured)
    grid = closed_grid(spans, EPISODE, "start_us", "end_us", settings.step_us)
    if doses is None:
        labels = grid.withColumn("label", F.lit(0)).withColumn("trigger_dose_time", F.lit(None).cast("timestamp_ntz"))
    else:
        labels = label_last_before_event(grid, spans, doses, EPISODE, settings.step_us, window_us=settings.label_window_us)
    long = reshape.melt(rows, [*EPISODE, TS], signals)
    samples = offsets(long.join(spans, EPISODE), TS, "start_us", "end_us", settings.step_us)
    widths = {"fine": settings.fine_us // settings.step_us, "coarse": settings.coarse_us // settings.step_us}
    stats = grid_windows(
        samples, EPISODE, settings.step_us, {"fine": widths["fine"]} if deltas_only else widths, medians=not deltas_only,
        min_samples=settings.min_samples, slope_per=1e-9 if settings.slope_per_nanosecond else 1.0,
    )
    wanted = labels.select(*EPISODE, "i")
    stats = stats.join(wanted, [*EPISODE, "i"], "left_semi")
    columns = {} if deltas_only else {
        f"{scope}_{stat}": f"{scope}_{stat}" for scope in ("fine", "coarse") for stat in STATS
        if not (scope == "coarse" and stat == "last")
    }
    if static is not None:
        keys = [ENTITY, "pregnancy_index"] if "pregnancy_index" in static.columns else [ENTITY]
        named = baseline_columns or statics.baseline_columns(static.columns)
        base = statics.baselines_long(static, keys, named)
        stats = stats.join(spans.select(*EPISODE, "pregnancy_index"), EPISODE)
        stats = statics.personal_deltas(stats, base, keys, "fine_last")
        for name in ("fine_abs_from_prebirth_last", "fine_pct_from_prebirth_last"):
            columns[name] = name
    wide = spread_signals(stats, wanted, EPISODE, signals, columns, lambda s, stat: f"{s}_{stat}")
    if not deltas_only and roles["sys"] in timeline.columns and roles["pulse"] in timeline.columns:
        last = grid_last(samples.filter(F.col("signal").isin(roles["sys"], roles["pulse"])), EPISODE, settings.step_us)
        newest = last.groupBy(*EPISODE, "i").agg(
            F.max(F.when(F.col("signal") == roles["pulse"], F.col("last_value"))).alias("_p"),
            F.max(F.when(F.col("signal") == roles["sys"], F.col("last_value"))).alias("_s"),
        )
        ratio = F.when(F.col("_s") != 0, F.try_divide(F.col("_p"), F.col("_s")))
        wide = wide.join(newest, [*EPISODE, "i"], "left").withColumn("shock_index_fine_last", ratio).drop("_p", "_s")
    own = spans.select(*EPISODE, "pregnancy_index", "start_us")
    at = from_micros(F.col("start_us") + F.col("i") * settings.step_us)
    features = wide.join(own, EPISODE).withColumn("snapshot_time", at).drop("i", "start_us")
    labels = labels.join(own.select(*EPISODE, "pregnancy_index"), EPISODE).select(
        ENTITY, "pregnancy_index", "episode_idx", from_micros("snapshot_us").alias("snapshot_time"), "label",
        "trigger_dose_time",
    )
    return features, labels


def with_static(features: DataFrame, static: DataFrame, whole_words: bool = False) -> DataFrame:
    """Static columns without measured ones, onto the snapshots."""
    keys = [ENTITY, "pregnancy_index"] if "pregnancy_index" in static.columns else [ENTITY]
    return statics.join_static(features, statics.strip_leaky_static(static, keys, whole_words=whole_words))

"""Event labels of episodes and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.config import DOSE_WORDS, PRODUCT_WORDS
from gapline.functions.clock import cell, day_us, from_micros, hour_us, micros
from gapline.functions.scalar import contains_any, strict_double
from gapline.operators.episodes import contain_in_episode, gap_episodes
from gapline.operators.nearest import latest_within


def transfusion_rows(
    df: DataFrame, name: str, dose_words: Sequence[str] = DOSE_WORDS, product_words: Sequence[str] = PRODUCT_WORDS
) -> DataFrame:
    """Rows that name a blood dose or product, with both 0/1 flags."""
    flagged = df.withColumn("blood_dose", contains_any(name, dose_words)).withColumn(
        "blood_product", contains_any(name, product_words)
    )
    return flagged.filter((F.col("blood_dose") == 1) | (F.col("blood_product") == 1))


def label_rule(dose, product, strict_doc: bool = False):
    """0 without a dose; 1 for one or two; 2 above.  `strict_doc`: two doses plus a product count as 2."""
    rule = F.when(dose == 0, 0)
    if strict_doc:
        rule = rule.when((dose == 2) & (product > 0), 2)
    return rule.when(dose.between(1, 2), 1).when((dose > 2) | ((dose == 2) & (product > 0)), 2).otherwise(0)


def label_counts(flagged: DataFrame, keys: Sequence[str], strict_doc: bool = False) -> DataFrame:
    """Doses, products and label per episode."""
    sums = flagged.groupBy(*keys).agg(
        F.sum("blood_dose").cast("int").alias("blood_dose"), F.sum("blood_product").cast("int").alias("blood_product")
    )
    return sums.withColumn("label", label_rule(F.col("blood_dose"), F.col("blood_product"), strict_doc))


def episode_labels(
    df: DataFrame, entity: str, ts: str, name: str, gap_us: int = 180 * day_us, strict_doc: bool = False, **words
) -> DataFrame:
    """Transfusion label per entity and gap episode of its transfusion rows."""
    rows = gap_episodes(transfusion_rows(df, name, **words), [entity], ts, gap_us, out="pregnancy_index")
    return label_counts(rows, [entity, "pregnancy_index"], strict_doc)


def positive_dates(
    df: DataFrame, entity: str, ts: str, name: str, gap_us: int = 180 * day_us, iso: str = "yyyy-MM-dd HH:mm:ss.SSSSSS",
    **words,
) -> DataFrame:
    """Positive episodes with their first event time and all distinct times as joined text.

    The joined text is the output format; distinct times are taken before they are gathered.
    """
    keys = [entity, "pregnancy_index"]
    rows = gap_episodes(transfusion_rows(df, name, **words), [entity], ts, gap_us, out="pregnancy_index")
    labels = label_counts(rows, keys).filter("label > 0").select(*keys, "label")
    times = rows.select(*keys, ts).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list(ts)).alias("_times"))
    joined = labels.join(times, keys, "left")
    text = F.array_join(F.transform("_times", lambda t: F.date_format(t, iso)), ";")
    return joined.select(
        *keys, "label", F.get("_times", F.lit(0)).alias("first_positive_execution"),
        F.coalesce(text, F.lit("")).alias("execution_dates_iso"),
    )


def label_last_before_event(
    grid: DataFrame, bounds: DataFrame, events: DataFrame, keys: Sequence[str], step_us: int,
    event_time: str = "dose_time", start_us: str = "start_us", end_us: str = "end_us", window_us: int = hour_us,
    on_snapshot_counts: bool = False,
) -> DataFrame:
    """Snapshots kept for training, with label and trigger.

    `grid` has keys, `i`, `snapshot_us` (closed grid of `bounds`).  Without events an
    episode keeps all snapshots as 0.  Otherwise it keeps those before the first event
    as 0, and for each event the newest snapshot at or before it: label 1 if it lies
    strictly before, at most one window away (the latest event wins); all other
    snapshots go.  The snapshot of an event follows from grid arithmetic, not a search.
    """
    keys = list(keys)
    doses = events.filter(F.col(event_time).isNotNull()).select(*keys, micros(event_time).alias("_d")).distinct()
    first = doses.groupBy(*keys).agg(F.min("_d").alias("_first"))
    spans = bounds.select(*keys, start_us, end_us)
    placed = doses.join(spans, keys).filter(F.col("_d") >= F.col(start_us))
    last = cell(F.col(end_us) - F.col(start_us), step_us)
    at = cell(F.col("_d") - F.col(start_us) - (F.lit(1) if on_snapshot_counts else F.lit(0)), step_us)
    placed = placed.withColumn("i", F.least(at, last)).filter("i >= 0")
    distance = F.col("_d") - (F.col(start_us) + F.col("i") * step_us)
    hits = placed.filter((distance > 0) & (distance <= window_us)).groupBy(*keys, "i").agg(F.max("_d").alias("_hit"))
    joined = grid.join(hits, [*keys, "i"], "left").join(first, keys, "left")
    kept = joined.filter(
        F.col("_first").isNull() | (F.col("snapshot_us") < F.col("_first")) | F.col("_hit").isNotNull()
    )
    return kept.select(
        *keys, "i", "snapshot_us", F.col("_hit").isNotNull().cast("int").alias("label"),
        from_micros("_hit").alias("trigger_dose_time"),
    )


def label_after_event(
    snapshots: DataFrame, events: DataFrame, keys: Sequence[str], at: str = "snapshot_time",
    event_time: str = "dose_time", window_us: int = 3 * hour_us,
) -> DataFrame:
    """Snapshots with label 1 when an event happened at most one window before (closed), and that event's time."""
    found = latest_within(snapshots, events, keys, at, event_time, window_us)
    return found.withColumn("label", F.col("trigger_dose_time").isNotNull().cast("int"))


def assert_binary(labels: DataFrame, label: str = "label") -> DataFrame:
    bad = labels.filter(~F.col(label).isin(0, 1) | F.col(label).isNull()).limit(1).count()
    if bad:
        raise ValueError(f"{label} holds values other than 0 and 1")
    return labels


def align_labels(
    labels: DataFrame, bounds: DataFrame, entity: str = "hashed_mother_id", ts: str = "event_time_abs",
    positive: Sequence[int] = (1, 2), birth: str = "birth_datetime",
) -> DataFrame:
    """Label rows with the episode (renumbered by start) that holds their time, and its birth."""
    from gapline.operators.episodes import pregnancy_index

    own = pregnancy_index(bounds.drop("episode_idx"), [entity], out="episode_idx")
    if birth not in own.columns:
        own = own.withColumn(birth, F.lit(None).cast("timestamp_ntz"))
    rows = labels.filter(F.col(ts).isNotNull()).withColumn("label", F.coalesce(F.col("label"), F.lit(0)))
    for optional in ("blood_dose", "blood_product"):
        value = strict_double(optional) if optional in rows.columns else F.lit(None).cast("double")
        rows = rows.withColumn(optional, value)
    found = contain_in_episode(rows, own, [entity], ts, ["episode_idx", birth])
    return found.select(
        entity, "pregnancy_index", "episode_idx", ts, birth, "label",
        F.col("label").isin(*positive).cast("int").alias("label_pos"), "blood_dose", "blood_product",
    )


def dose_times(wide: DataFrame | None, aligned: DataFrame | None, entity: str, ts: str = "event_time_abs") -> DataFrame:
    """Dose times: distinct ones of the wide dose table if it has any, else those of all aligned labels above 0."""
    from gapline.operators.reshape import melt_times

    if wide is not None:
        if "episode_idx" not in wide.columns:
            if "pregnancy_index" not in wide.columns:
                raise ValueError("dose table needs episode_idx or pregnancy_index")
            wide = wide.withColumn("episode_idx", F.col("pregnancy_index"))
        doses = melt_times(wide, [entity, "episode_idx"])
        if aligned is None or not doses.isEmpty():
            return doses
    if aligned is None:
        raise ValueError("no dose source")
    return aligned.filter(F.col("label") > 0).select(
        entity, F.col("pregnancy_index").alias("episode_idx"), F.col(ts).alias("dose_time")
    )


def label_at_time(
    snapshots: DataFrame, labels: DataFrame, keys: Sequence[str], time: str | None = "snapshot_time",
    target: str = "label",
) -> DataFrame:
    """Snapshots with the largest label of their exact time, or of their episode without a time column; missing is 0."""
    on = [*keys, time] if time else list(keys)
    best = labels.groupBy(*on).agg(F.max(target).alias("_y"))
    joined = snapshots.join(best, on, "left")
    return joined.withColumn(target, F.coalesce(F.col("_y"), F.lit(0)).cast("int")).drop("_y")


def label_time_column(columns: Sequence[str], configured: str | None = None) -> str | None:
    """Name of the time column of a label table, by the usual order of preference."""
    if "snapshot_time" in columns:
        return "snapshot_time"
    if configured and configured in columns:
        return configured
    return next((c for c in columns if "time" in c.lower()), None)


def first_positive(labels: DataFrame, keys: Sequence[str], ts: str = "snapshot_time") -> DataFrame:
    """Earliest positive snapshot per episode and a 0/1 flag."""
    first = F.min(F.when(F.col("label") > 0, F.col(ts)))
    return labels.groupBy(*keys).agg(
        first.alias("first_bleed_time"), F.coalesce(F.max((F.col("label") > 0).cast("int")), F.lit(0)).alias("bleed_flag")
    )


def label_summary(labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of episodes per (largest) label."""
    best = labels.groupBy(*keys).agg(F.max("label").alias("label"))
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n_episodes"))


def documented_labels(df: DataFrame, entity: str, column: str, yes: str, no: str, seq: str) -> DataFrame:
    """Yes/no text to 1/0, other values dropped, first row per entity."""
    from gapline.functions.scalar import yes_no
    from gapline.operators.reshape import keep_first

    rows = df.select(entity, seq, yes_no(column, yes, no).alias("y_doc")).filter("y_doc IS NOT NULL")
    return keep_first(rows, [entity], [seq]).select(entity, "y_doc")

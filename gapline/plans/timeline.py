"""Raw hospital tables to the aligned per-entity timeline, episode bounds and aligned labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gapline.config import DRUG_RULES, ENTITY, VITAL_NAMES, VITALS
from gapline.functions.clock import day_us, second_us, strict_timestamp
from gapline.functions.scalar import first_match, safe_name, strict_double, translate
from gapline.operators import episodes as ep
from gapline.operators import reshape
from gapline.operators.labels import align_labels
from gapline.sources.writers import materialize

TS = "event_time_abs"


@dataclass(frozen=True)
class Timeline:
    rows: DataFrame
    bounds: DataFrame
    births: DataFrame
    vitals: list[str]
    labs: list[str]
    drugs: list[str]


def _time(df: DataFrame, column: str):
    return F.col(column) if dict(df.dtypes)[column].startswith("timestamp") else strict_timestamp(column)


def vitals_wide(measurements: DataFrame, seq: str, names=VITAL_NAMES, wanted: Sequence[str] = VITALS) -> DataFrame:
    """Parsed, quality-filtered and renamed measurements, one row per (entity, time)."""
    rows = measurements.withColumn(TS, _time(measurements, "parameter_time"))
    rows = rows.dropna(subset=[ENTITY, TS, "ResultNumeric"])
    if "flag" in rows.columns:
        rows = rows.filter(F.coalesce(F.col("flag").cast("double"), F.lit(0.0)) == 0)
    rows = rows.withColumn("_name", translate("Parameter_Name", names)).filter(F.col("_name").isin(*wanted))
    rows = rows.withColumn("_value", strict_double("ResultNumeric"))
    return reshape.pivot_last(rows, [ENTITY, TS], "_name", "_value", seq, list(wanted))


def labs_wide(labs: DataFrame, seq: str, values: Sequence[str] | None = None) -> DataFrame:
    """Parsed results, one row per (entity, time): declared tests as columns, else all tests in a map `cells`."""
    raw = reshape.assert_distinct_names(labs.withColumn("_raw", F.upper(F.trim("TestName"))), "_raw").drop("_raw")
    rows = raw.withColumn(TS, _time(labs, "ResultTime")).withColumn("_name", safe_name(F.upper("TestName")))
    rows = rows.withColumn("_value", strict_double("Result"))
    return reshape.pivot_last(rows, [ENTITY, TS], "_name", "_value", seq, values)


def drugs_wide(drugs: DataFrame, rules=DRUG_RULES) -> DataFrame:
    rows = drugs.withColumn("_name", first_match("DrugName", rules)).filter(F.col("_name").isNotNull())
    rows = rows.withColumn(TS, _time(rows, "ExecutionTime"))
    return reshape.pivot_flags(rows, [ENTITY, TS], "_name", [name for name, _ in rules])


def births(newborns: DataFrame) -> DataFrame:
    """Birth time (else birth date) per child row."""
    have = [c for c in ("birth_time", "child_birth_date") if c in newborns.columns]
    when = F.coalesce(*[_time(newborns, c) for c in have])
    rows = newborns.select(F.col(ENTITY).cast("string").alias(ENTITY), when.alias("birth_datetime"))
    return rows.dropna()


def build_timeline(
    vitals: DataFrame, labs: DataFrame, drugs: DataFrame, births: DataFrame, gap_us: int = 183 * day_us,
    near_us: int = second_us, names: Sequence[str] = VITALS,
    work: str | None = None, force: bool = False,
) -> Timeline:
    """Wide tables to one timeline: merge, episodes, births, column kinds, near-duplicate collapse.

    `work` names a shared folder for the stored steps (merged rows, bounds, aligned
    rows); a step that is already there is read instead of made, unless forced.
    """
    def step(name: str, df: DataFrame) -> DataFrame:
        return materialize(df.sparkSession, f"{work}/{name}", lambda: df, force) if work else df

    merged = reshape.outer_merge([vitals, labs, drugs], [ENTITY, TS])
    merged = merged.withColumn(ENTITY, F.col(ENTITY).cast("string")).filter(F.col(TS).isNotNull())
    merged = step("merged", merged)
    bounds = ep.gap_episode_bounds(merged, [ENTITY], TS, gap_us)
    bounds = step("bounds", ep.match_births(bounds, births, [ENTITY]))
    rows = ep.gap_episodes(merged, [ENTITY], TS, gap_us)
    rows = step("aligned", ep.attach_birth(rows, bounds, [ENTITY], TS))
    keys = [ENTITY, TS, "birth_datetime", "t_from_birth_sec", "t_from_birth_str", "episode_idx"]
    shown, lab_cols, drug_cols = reshape.classify_columns(rows, keys, names)
    compact = reshape.collapse_near_duplicates(
        rows, [ENTITY], TS, last=shown + lab_cols, largest=drug_cols, first=["birth_datetime", "episode_idx"],
        gap_us=near_us,
    )
    compact = ep.add_birth_distance(compact, TS)
    ordered = compact.select(*keys, *[F.col(f"`{c}`") for c in shown + lab_cols + drug_cols])
    return Timeline(ordered, bounds, births, shown, lab_cols, drug_cols)


def aligned_labels(labels: DataFrame, timeline: Timeline) -> DataFrame:
    """Label rows (lower-case optional columns, parsed `start_date`) onto the episodes."""
    from gapline.sources.readers import require, strict_label_times

    rows = reshape.rename(labels, {"blood dose": "blood_dose", "blood product": "blood_product"}, any_case=True)
    require(rows, [ENTITY, "pregnancy_index", "start_date", "label"])
    rows = strict_label_times(rows, "start_date", TS)
    rows = rows.withColumns({
        ENTITY: F.col(ENTITY).cast("string"), "pregnancy_index": F.col("pregnancy_index").cast("int"),
        "label": F.col("label").cast("int"),
    })
    return align_labels(rows, timeline.bounds, ENTITY, TS)

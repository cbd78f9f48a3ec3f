"""Static attributes: mothers, newborn aggregates, baselines, and their joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from gapline.config import (
    BASELINE_ALIASES, BASELINE_SUFFIX, BINARY_STATIC, ENTITY, LABS, MEASUREMENTS, SLIM_STATIC,
)
from gapline.functions.scalar import (
    body_mass_index, duration_minutes, gender_code, lenient_double, pose_text, positive_flag, stage_minutes, zero_flag,
)
from gapline.operators.blocks import block_rank, one_row, sampled_block
from gapline.operators.episodes import static_index
from gapline.operators.reshape import keep_first, many_to_one

DURATIONS = ("first_stage_begin", "first_stage_end")


def clean_mothers(df: DataFrame, entity: str = ENTITY, keep: Sequence[str] | None = None, seq: str = "seq") -> DataFrame:
    """Numeric columns, durations in minutes, labour stages, BMI, history flags and 0/1 columns."""
    if keep is not None:
        df = df.select(*[c for c in df.columns if c in {entity, seq, *keep}])
    types = dict(df.dtypes)
    texts = [c for c in df.columns if types[c] == "string" and c not in (entity, *DURATIONS)]
    df = df.withColumns({c: lenient_double(c) for c in texts})
    df = df.withColumns({c: duration_minutes(c) for c in DURATIONS if c in df.columns})
    have = set(df.columns)
    new = {}
    none = F.lit(None).cast("double")
    hours1 = F.col("first_stage_hours") if "first_stage_hours" in have else none
    spans = DURATIONS if set(DURATIONS) <= have else (None, None)
    new["labor_stage1_dur_min"] = stage_minutes(hours1, *spans)
    new["labor_stage2_dur_min"] = stage_minutes(F.col("second_stage_hours") if "second_stage_hours" in have else none)
    weight = next((c for c in ("weight_before_birth", "weight_before_pregnancy") if c in have), None)
    if "height" in have and weight:
        new["bmi"] = body_mass_index(F.col(weight).cast("double"), F.col("height").cast("double"))
    if "number_of_births_P" in have:
        new["parity_primip"] = zero_flag("number_of_births_P")
    if "number_of_cesareans_CS" in have:
        new["prior_csection"] = positive_flag("number_of_cesareans_CS")
    new.update({c: positive_flag(c) for c in BINARY_STATIC if c in have})
    return df.withColumns(new)


def mothers_static(df: DataFrame, entity: str = ENTITY, seq: str = "seq") -> DataFrame:
    """Slim static columns per (entity, pregnancy_index)."""
    clean = clean_mothers(df, entity, seq=seq)
    for c in ("fetus_count", "number_of_pregnancies_G"):
        if c not in clean.columns:
            clean = clean.withColumn(c, F.lit(None).cast("double"))
    ranked = static_index(clean, [entity], ["fetus_count", "number_of_pregnancies_G"], seq)
    present = [c for c in SLIM_STATIC if c in df.columns or c in ranked.columns]
    return ranked.select(entity, F.col("pregnancy_index").cast("int").alias("pregnancy_index"), *present)


def mothers_static_single(df: DataFrame, entity: str = ENTITY, seq: str = "seq") -> DataFrame:
    """Slim static columns of the first row of each entity."""
    clean = keep_first(clean_mothers(df, entity, seq=seq), [entity], [seq])
    return clean.select(entity, *[c for c in SLIM_STATIC if c in clean.columns])


# ---------------------------------------------------------------- newborns
def pose_codebook(df: DataFrame, column: str = "pose") -> DataFrame:
    """Distinct normalised texts with their rank from 0; the empty text has no code."""
    texts = df.select(column).distinct().select(pose_text(column).alias("pose_text")).filter("pose_text <> ''").distinct()
    ranked = block_rank(sampled_block(texts, "pose_text"), [], "_block", "pose_text")
    return ranked.select("pose_text", (F.col("rank") - 1).cast("double").alias("pose_code"))


def newborns_basic(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Counts, weight and Apgar ranges, intensive care and multiple birth per entity."""
    nicu = positive_flag("nicu_hospitalization") if "nicu_hospitalization" in df.columns else F.lit(0)
    weight = lenient_double("weight")
    agg = df.groupBy(entity).agg(
        F.count("child_gender").alias("fetus_count"),
        F.min(weight).alias("birthweight_min_g"),
        F.max(weight).alias("birthweight_max_g"),
        F.avg(weight).alias("birthweight_mean_g"),
        F.min(lenient_double("apgar1")).alias("apgar1_min"),
        F.min(lenient_double("apgar5")).alias("apgar5_min"),
        F.max(nicu).alias("any_nicu"),
    )
    return agg.withColumn("multiple_gestation", (F.col("fetus_count") >= 2).cast("int"))


#: Parts of a text's rows times number of texts that a join by text is dealt to.
DEALT = 4096


def _with_codes(df: DataFrame, codebook: DataFrame, entity: str, column: str = "pose") -> DataFrame:
    """Add the code of each row's text.

    A few texts may own all rows, so each code is repeated for parts of its text's rows, the more the fewer texts there
    are: no task gets all rows of a text.
    """
    texts = df.select(column).distinct().withColumn("pose_text", pose_text(column))
    codes = texts.join(codebook, "pose_text").select(column, "pose_code")
    number = one_row(texts.agg(F.count(F.lit(1)).alias("n")))["n"]
    parts = F.greatest(F.lit(1), F.least(F.lit(256), F.call_function("div", F.lit(DEALT), F.greatest(number, F.lit(1)))))
    codes = codes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return df.withColumn("_part", F.pmod(F.xxhash64(entity), parts)).join(codes, [column, "_part"], "left").drop("_part")


def newborns_coded(df: DataFrame, codebook: DataFrame | None = None, entity: str = ENTITY) -> DataFrame:
    """The same with gender and pose codes: mode (smallest wins ties), share of boys, any boy or girl."""
    have = set(df.columns)
    if "pose" in have:
        codebook = codebook if codebook is not None else pose_codebook(df)
        df = _with_codes(df, codebook, entity)
    else:
        df = df.withColumn("pose_code", F.lit(None).cast("double"))
    gender = gender_code("child_gender") if "child_gender" in have else F.lit(None).cast("double")
    source = next((c for c in ("nicu_hospitalization", "nicu") if c in have), None)
    nicu = positive_flag(source) if source else F.lit(0)

    def number(c: str):
        return lenient_double(c) if c in have else nicu.cast("double")

    children = F.count("child_gender" if "child_gender" in have else "pose_code")
    df = df.withColumn("gender_code", gender)
    agg = df.groupBy(entity).agg(
        children.alias("n_children"),
        F.min(number("weight")).alias("birthweight_min_g"),
        F.max(number("weight")).alias("birthweight_max_g"),
        F.avg(number("weight")).alias("birthweight_mean_g"),
        F.min(number("apgar1")).alias("apgar1_min"),
        F.min(number("apgar5")).alias("apgar5_min"),
        F.max(nicu).alias("any_nicu"),
        F.mode("gender_code", True).alias("gender_mode_code"),
        F.avg("gender_code").alias("gender_prop_male"),
        F.mode("pose_code", True).alias("pose_mode_code"),
    )
    share = F.col("gender_prop_male")
    return agg.withColumn("any_male", (F.coalesce(share, F.lit(0.0)) > 0).cast("int")).withColumn(
        "any_female", (F.coalesce(share, F.lit(1.0)) < 1).cast("int")
    )


# newborn column -> (statistics, output stem)
FULL_NEWBORN = {
    "apgar1": (("min", "max", "mean"), "apgar1_{}"),
    "apgar5": (("min", "max", "mean"), "apgar5_{}"),
    "weight": (("min", "max", "mean"), "birthweight_{}_g"),
    "pregnancy_weeks": (("min", "max", "mean"), "preg_weeks_{}"),
    "PH -Cord, V": (("mean",), "cord_ph_v_{}"),
    "PH -Cord, Ar": (("mean",), "cord_ph_a_{}"),
    "Base Excess -Cord, V": (("mean",), "base_excess_v_{}"),
    "Base Excess -Cord, Ar": (("mean",), "base_excess_a_{}"),
    "days_in_hospital": (("mean",), "days_in_hosp_{}"),
}
_AGGREGATES = {"min": F.min, "max": F.max, "mean": F.avg}


def newborns_full(df: DataFrame, entity: str = ENTITY) -> DataFrame:
    """Ranges and means of all newborn measures, stillbirth, and the modes of birth type and pose."""
    have = set(df.columns)
    counted = next((c for c in ("newborn_medical_record", "birth_medical_record", "weight") if c in have), entity)
    stats = []
    for column, (names, stem) in FULL_NEWBORN.items():
        x = lenient_double(f"`{column}`") if column in have else F.lit(None).cast("double")
        stats += [_AGGREGATES[s](x).alias(stem.format(s)) for s in names]
    still = positive_flag("stillborn") if "stillborn" in have else F.lit(0)
    kind = F.col("birth_type" if "birth_type" in have else "pose")
    pose = F.col("pose" if "pose" in have else "birth_type")
    agg = df.groupBy(entity).agg(
        F.count(lenient_double("weight") if counted == "weight" else counted).cast("int").alias("fetus_count"), F.max(still).alias("stillborn_any"), *stats,
        F.mode(kind, True).alias("mode_birth_type"), F.mode(pose, True).alias("mode_pose"),
    )
    return agg.withColumn("multiple_gestation", (F.col("fetus_count") >= 2).cast("int"))


def join_newborns(static: DataFrame, newborns: DataFrame, entity: str = ENTITY, defaults: bool = False) -> DataFrame:
    """Newborn aggregates onto every pregnancy of the entity."""
    joined = static.join(newborns, entity, "left")
    if defaults:
        joined = joined.fillna({"fetus_count": 1, "multiple_gestation": 0})
    return joined


# ---------------------------------------------------------------- baselines
def baseline_columns(columns: Sequence[str], signals: Sequence[str] = MEASUREMENTS, labs: Sequence[str] = LABS,
                     aliases: Mapping[str, Sequence[str]] = BASELINE_ALIASES,
                     suffix: str = BASELINE_SUFFIX, exact: bool = False) -> dict[str, str]:
    """Signal -> static column with its value before birth; labs by their own name.

    The first column that contains the suffix and the signal or one of its aliases;
    `exact` wants `{alias}_{suffix}` itself.
    """
    found: dict[str, str] = {}
    for name in signals:
        words = [name, *aliases.get(name, ())]
        for column in columns:
            low = column.lower()
            if exact:
                hit = any(low == f"{w.lower()}_{suffix}" for w in words)
            else:
                hit = suffix in low and any(w.lower() in low for w in words)
            if hit:
                found[name] = column
                break
    found.update({lab: lab for lab in labs if lab in columns})
    return found


def baselines_long(static: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Signal baselines per static row in long form, with those of the derived signals."""
    values = {name: lenient_double(f"`{column}`") for name, column in columns.items()}
    sys, dia, pulse = (values.get(n) for n in ("sistol", "diastol", "pulse"))
    if sys is not None and dia is not None:
        values["MAP"] = dia + (sys - dia) / 3.0
        values["PP"] = sys - dia
    if sys is not None and pulse is not None:
        values["SI"] = F.when(sys != 0, F.try_divide(pulse, sys))
    pairs = F.array(*[F.struct(F.lit(n).alias("signal"), v.alias("baseline")) for n, v in values.items()])
    return (
        static.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.*").filter(F.col("baseline").isNotNull())
    )


def personal_deltas(rows: DataFrame, baselines: DataFrame, keys: Sequence[str], last: str, signal: str = "signal",
                    prefix: str = "fine") -> DataFrame:
    """Distance of a value to its baseline, absolute and relative (null when the baseline is 0)."""
    joined = rows.join(baselines, [*keys, signal], "left")
    gap = F.col(last) - F.col("baseline")
    return joined.withColumn(f"{prefix}_abs_from_prebirth_last", gap).withColumn(
        f"{prefix}_pct_from_prebirth_last", F.try_divide(gap, F.col("baseline"))
    )


# ---------------------------------------------------------------- joins onto snapshots
def strip_leaky_static(
    static: DataFrame, keys: Sequence[str], signals: Sequence[str] = MEASUREMENTS, labs: Sequence[str] = LABS,
    aliases: Mapping[str, Sequence[str]] = BASELINE_ALIASES, whole_words: bool = False,
) -> DataFrame:
    """Drop static columns named like a measured signal, an alias or a lab.

    `whole_words` compares underscore-separated words, so `hr` no longer matches `chronic`.
    """
    words = [w.lower() for s in signals for w in (s, *aliases.get(s, ()))] + [w.lower() for w in labs]

    def leaky(column: str) -> bool:
        low = column.lower()
        if not whole_words:
            return any(w in low for w in words)
        return any(f"_{w}_" in f"_{low}_" for w in words)

    return static.drop(*[c for c in static.columns if c not in keys and leaky(c)])


def rename_collisions(static: DataFrame, other: Sequence[str], keys: Sequence[str], prefix: str = "static__") -> DataFrame:
    shared = [c for c in static.columns if c in set(other) and c not in keys]
    return static.withColumnsRenamed({c: f"{prefix}{c}" for c in shared})


def join_static(snapshots: DataFrame, static: DataFrame, entity: str = ENTITY, index: str = "pregnancy_index",
                check: bool = True) -> DataFrame:
    """Static columns onto snapshots by (entity, pregnancy) or by entity alone."""
    keys = [entity, index] if index in static.columns and index in snapshots.columns else [entity]
    return many_to_one(snapshots, rename_collisions(static, snapshots.columns, keys), keys, check)

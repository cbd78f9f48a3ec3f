"""Settings of the composed flows; every value is a plain default that a caller may replace."""

from __future__ import annotations

from dataclasses import dataclass, field

from gapline.functions.clock import day_us, hour_us, minute_us

# ------------------------------------------------------------------ fixed values: names, words and ranges of the data model
ENTITY = "hashed_mother_id"
VITALS = ("BP - Mean", "diastol", "sistol", "saturation", "heat", "pulse")
MEASUREMENTS = ("sistol", "diastol", "BP - Mean", "saturation", "heat", "pulse")
LABS = ("HGB", "HCT", "PLT", "FIBRINOGEN", "WBC", "SODIUM_BLOOD", "CREATININE_BLOOD", "URIC_ACID_BLOOD")
DRUGS = ("LACTATED_RINGERS", "METHYLERGONOVINE", "MISOPROSTOL", "OXYTOCIN", "SODIUM_CHLORIDE_0_9")

VITAL_NAMES = {
    "לחץ סיסטולי": "sistol",
    "לחץ דיאסטולי": "diastol",
    "לחץ דם ממוצע": "BP - Mean",
    "סטורציה": "saturation",
    "חום": "heat",
    "דופק": "pulse",
}

# two spellings of the same pressure in the long measurement file
PRESSURE_NAMES = {
    "diastolic": ("לחץ דיאסטולי", "לחץ דם. דיאסטולי"),
    "systolic": ("לחץ סיסטולי", "לחץ דם. סיסטולי"),
}

CANONICAL_VITALS = {
    "sistol": "sbp",
    "diastol": "dbp",
    "BP - Mean": "map",
    "pulse": "hr",
    "heat": "temp",
    "saturation": "spo2",
}

DRUG_RULES = (
    ("OXYTOCIN", (("OXYTOCIN",),)),
    ("MISOPROSTOL", (("MISOPROSTOL",), ("CYTOTEC",))),
    ("METHYLERGONOVINE", (("METHYLERGONOVINE",), ("METHERGIN",))),
    ("LACTATED_RINGERS", (("LACTATED RINGERS",), ("HARTMAN",))),
    ("SODIUM_CHLORIDE_0_9", (("SODIUM CHLORIDE", "0.9%"),)),
)
DOSE_WORDS = ("red blood cells", "rbc", "prbc")
PRODUCT_WORDS = ("plasma", "platelet")

BASELINE_ALIASES = {
    "heat": ("temp", "temperature"),
    "sistol": ("systolic", "systolic_pressure", "sbp"),
    "diastol": ("diastolic", "diastolic_pressure", "dbp"),
    "pulse": ("hr", "heart_rate"),
    "saturation": ("sat", "spo2"),
    "BP - Mean": ("map", "bp_mean"),
}
BASELINE_SUFFIX = "24h_last_before_birth"

PLAUSIBLE = {
    "sistol": (40, 250),
    "diastol": (20, 150),
    "pulse": (30, 220),
    "saturation": (50, 100),
    "heat": (34, 41),
    "HGB": (3, 20),
    "HCT": (10, 60),
    "PLT": (20_000, 1_000_000),
    "FIBRINOGEN": (100, 800),
    "WBC": (1, 100),
    "SODIUM_BLOOD": (110, 170),
    "CREATININE_BLOOD": (0.2, 10),
    "URIC_ACID_BLOOD": (1, 15),
}
DERIVED_PLAUSIBLE = {"MAP": (40, 170), "SI": (0.2, 3.5), "PP": (10, 150)}

YES_TOKEN, NO_TOKEN = "כן", "לא"

# fixed values: columns of the static table
BINARY_STATIC = (
    "anesthesia_local", "anesthesia_epidural", "anesthesia_general", "anesthesia_spinal", "no_anesthesia",
    "birth_start_spontaneous", "birth_start_cesarean", "birth_start_labor_induction", "birth_start_augmentation",
    "vbac_now",
)
SLIM_STATIC = (
    "age_on_date", "bmi", "parity_primip", "number_of_pregnancies_G", "number_of_births_P", "prior_csection",
    "chronic_hypertension", "pregnancy_induced_hypertension", "preeclampsia", "super_imposed_preeclampsia",
    "pregestational_diabetes", "gestational_diabetes_a1", "gestational_diabetes_a2",
    "gestational_diabetes_unspecified",
    "anesthesia_local", "anesthesia_epidural", "anesthesia_general", "anesthesia_spinal", "no_anesthesia",
    "temp_24h_last_before_birth", "temp_24h_max_before_birth", "temp_24h_min_before_birth",
    "systolic_pressure_24h_last_before_birth", "systolic_pressure_24h_max_before_birth",
    "systolic_pressure_24h_min_before_birth",
    "diastolic_pressure_24h_last_before_birth", "diastolic_pressure_24h_max_before_birth",
    "diastolic_pressure_24h_min_before_birth",
    "saturation_24h_last_before_birth", "saturation_24h_max_before_birth", "saturation_24h_min_before_birth",
    "labor_stage1_dur_min", "labor_stage2_dur_min",
    "birth_start_spontaneous", "birth_start_cesarean", "birth_start_labor_induction", "birth_start_augmentation",
    "vbac_now",
)


@dataclass(frozen=True)
class SnapshotSettings:
    """Hourly snapshots of an episode."""

    step_us: int = hour_us
    fine_us: int = 3 * hour_us
    coarse_us: int = 12 * hour_us
    min_samples: int = 3
    label_window_us: int = hour_us
    episode_gap_us: int = 183 * day_us
    min_vital_frequency: float = 1.0
    sample_per_class: int | None = 10_000
    seed: int = 111
    signals: tuple[str, ...] = MEASUREMENTS + LABS
    slope_per_nanosecond: bool = False


@dataclass(frozen=True)
class PostpartumSettings:
    """Snapshots after delivery."""

    step_us: int = 15 * minute_us
    lookback_us: int = 120 * minute_us
    baseline_us: int = 30 * minute_us
    longest_us: int = 6 * hour_us
    vital_age_cap_s: float = 12 * 3600.0
    lab_age_cap_s: float = 7 * 24 * 3600.0
    drug_age_cap_min: float = 7 * 24 * 60.0
    vitals: tuple[str, ...] = tuple(CANONICAL_VITALS.values())
    labs: tuple[str, ...] = (
        "CREATININE_BLOOD", "FIBRINOGEN", "HCT", "HGB", "PLT", "SODIUM_BLOOD", "URIC_ACID_BLOOD", "WBC",
    )
    drugs: tuple[str, ...] = DRUGS


@dataclass(frozen=True)
class SequenceSettings:
    step_us: int = 5 * minute_us
    baseline_us: int = 30 * minute_us
    longest_us: int = 6 * hour_us
    cap: int = 80
    channels: tuple[str, ...] = ("sbp", "dbp", "map", "hr", "temp", "spo2")
    delivery_gap_us: int = 183 * day_us


@dataclass(frozen=True)
class ColumnSettings:
    """Which feature columns reach the model matrix; the name parts are fixed values."""

    realtime_patterns: tuple[str, ...] = (
        "sistol", "diastol", "bp - mean", "map", "pulse", "saturation", "heat", "shock_index", "si_", "shockindex",
        "PP", "hgb", "hct", "plt", "fibrinogen", "wbc", "sodium_blood", "creatinine_blood", "uric_acid_blood",
        "_fine_", "_coarse_",
    )
    keep_only: tuple[str, ...] = (
        "sistol", "diastol", "bp - mean", "map", "pulse", "saturation", "shock_index", "si_", "shockindex", "HGB",
        "HCT", "PP",
    )
    drop_realtime: bool = False
    drop_if_contains: tuple[str, ...] = ("delta_t",)
    use_blocklist: bool = True
    blocked_patterns: tuple[str, ...] = (
        "_recency_s", "_measured", "_given", "time_since_", "t_from_birth_sec", "mins_postpartum", "episode_start",
    )
    blocked_columns: tuple[str, ...] = (
        "anesthesia_local", "anesthesia_epidural", "anesthesia_general", "anesthesia_spinal", "no_anesthesia",
        "amniofusion", "oxytocin_administrations", "membranes_rupture_type", "amniotic_fluid",
    )
    never: tuple[str, ...] = (
        ENTITY, "episode_idx", "snapshot_time", "episode_start", "mins_postpartum", "pregnancy_index",
    )
    duplicate_ids: dict = field(default_factory=lambda: {ENTITY: ("mother_id",)})


@dataclass(frozen=True)
class TrainingSettings:
    """The defaults of training that results depend on."""

    positive_labels: tuple[int, ...] = (1, 2)
    min_variance: float = 1e-12
    holdout_fraction: float = 0.2
    folds: int = 5
    seed: int = 42
    trees: int = 400
    depth: int = 5
    step: float = 0.05
    subsample: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    child_weight: float = 8.0
    bins: int = 256
    threshold: float = 0.5
    even_classes: bool = False

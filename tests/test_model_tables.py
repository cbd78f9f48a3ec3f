import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.config import ColumnSettings
from gapline.operators import columns, evaluate, labels, matrix, models, statics
from gapline.functions.clock import day_us
from tests.helpers import at, times


# ------------------------------------------------------------------ labels of episodes
def test_label_rule(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (2, 1), (3, 0)], "d int, p int")
    rule = [r[0] for r in df.select(labels.label_rule(F.col("d"), F.col("p"))).collect()]
    strict = [r[0] for r in df.select(labels.label_rule(F.col("d"), F.col("p"), True)).collect()]
    assert rule == [0, 1, 1, 1, 2] and strict == [0, 1, 1, 2, 2]


def test_transfusion_episodes(spark):
    day = 86400.0
    rows = [("a", at(0), "Packed RBC"), ("a", at(day), "Fresh PLASMA"), ("a", at(day), "saline"), ("a", at(181 * day), "platelets"),
            ("a", at(400 * day), "red blood cells"), ("b", at(0), "plasma"), ("c", at(0), None)]
    df = times(spark, rows, "id string, ts timestamp, name string")
    got = sorted(tuple(r) for r in labels.episode_labels(df, "id", "ts", "name").collect())
    assert got == [("a", 1, 1, 2, 1), ("a", 2, 1, 0, 1), ("b", 1, 0, 1, 0)]
    dates = labels.positive_dates(df, "id", "ts", "name", 180 * day_us).orderBy("pregnancy_index").collect()
    assert [r.first_positive_execution for r in dates] == [at(0), at(400 * day)]
    assert dates[0].execution_dates_iso.count(";") == 2


def test_label_time_column():
    assert labels.label_time_column(["a", "snapshot_time"]) == "snapshot_time"
    assert labels.label_time_column(["a", "when", "event_time"], "when") == "when"
    assert labels.label_time_column(["a", "Event_Time"]) == "Event_Time"
    assert labels.label_time_column(["a"]) is None


def test_dose_source_falls_back(spark):
    aligned = times(spark, [("a", 1, at(0), 1), ("a", 1, at(5), 0)], "id string, pregnancy_index int, event_time_abs timestamp, label int")
    wide = spark.createDataFrame([("a", 2, "2024-01-01 00:00:05")], "id string, pregnancy_index int, blood_dose_1 string")
    assert [(r.episode_idx, r.dose_time) for r in labels.dose_times(wide, aligned, "id").collect()] == [(2, at(5))]
    blank = wide.withColumn("blood_dose_1", F.lit(" "))
    assert [(r.episode_idx, r.dose_time) for r in labels.dose_times(blank, aligned, "id").collect()] == [(1, at(0))]
    with pytest.raises(ValueError):
        labels.dose_times(wide.drop("pregnancy_index"), aligned, "id")
    with pytest.raises(ValueError):
        labels.dose_times(None, None, "id")


# ------------------------------------------------------------------ column plans
NAMES = ["HGB_fine_last", "WBC_coarse_min", "sistol_fine_delta_t", "age_on_date", "anesthesia_local", "hr_measured", "time_since_x_min",
         "MAP_fine_std", "heat_fine_mean", "episode_idx", "bmi"]


def test_column_plan():
    assert columns.plan_columns(NAMES) == ["HGB_fine_last", "age_on_date", "MAP_fine_std", "bmi"]
    assert columns.plan_columns(NAMES, ColumnSettings(drop_realtime=True)) == ["age_on_date", "bmi"]
    free = columns.plan_columns(NAMES, ColumnSettings(keep_only=(), use_blocklist=False))
    assert free == [c for c in NAMES if c not in ("sistol_fine_delta_t", "episode_idx")]
    assert columns.keep_only(["WBC_fine_last"], ColumnSettings()) == ["WBC_fine_last"]  # nothing left: no filter


def test_duplicate_ids_and_numeric(spark):
    df = spark.createDataFrame([("a", "a", 1, 2.0)], "hashed_mother_id string, mother_id string, x int, y double")
    assert columns.drop_duplicate_ids(df).columns == ["hashed_mother_id", "x", "y"]
    assert columns.numeric_columns(df, ["x"]) == ["y"]


# ------------------------------------------------------------------ static columns
def test_leaky_static_names(spark):
    df = spark.createDataFrame([("a", 1, 2, 3, 4)], "id string, chronic_hypertension int, systolic_pressure_24h_last_before_birth int, WBC int, age int")
    assert statics.strip_leaky_static(df, ["id"]).columns == ["id", "age"]
    assert statics.strip_leaky_static(df, ["id"], whole_words=True).columns == ["id", "chronic_hypertension", "age"]


def test_baseline_columns():
    names = ["temp_24h_max_before_birth", "temp_24h_last_before_birth", "systolic_pressure_24h_last_before_birth", "HGB"]
    assert statics.baseline_columns(names) == {"heat": names[1], "sistol": names[2], "HGB": "HGB"}
    assert statics.baseline_columns(names, exact=True)["heat"] == names[1]
    assert "sistol" in statics.baseline_columns(names, exact=True)


def test_newborn_defaults_and_modes(spark):
    kids = spark.createDataFrame([("a", "f", "3000", "8", "9", "1", "Head"), ("a", "M", "x", "7", None, None, "head."), ("a", None, "3200", "9", "9", "0", None)],
                                 "hashed_mother_id string, child_gender string, weight string, apgar1 string, apgar5 string, nicu_hospitalization string, pose string")
    row = statics.newborns_coded(kids).first()
    assert (row.n_children, row.birthweight_mean_g, row.apgar1_min, row.any_nicu, row.gender_mode_code) == (2, 3100.0, 7.0, 1, 0.0)
    assert (row.gender_prop_male, row.pose_mode_code, row.any_male, row.any_female) == (0.5, 0.0, 1, 1)
    basic = statics.newborns_basic(kids)
    mothers = spark.createDataFrame([("a",), ("z",)], "hashed_mother_id string")
    got = {r.hashed_mother_id: r for r in statics.join_newborns(mothers, basic, defaults=True).collect()}
    assert (got["a"].fetus_count, got["a"].multiple_gestation) == (2, 1) and (got["z"].fetus_count, got["z"].multiple_gestation) == (1, 0)
    full = statics.newborns_full(kids.withColumn("stillborn", F.lit("1"))).first()
    assert full.stillborn_any == 1 and full.fetus_count == 2 and full.apgar5_mean == 9.0 and full.cord_ph_v_mean is None


# ------------------------------------------------------------------ matrix
def test_scaler_matches_filled_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(50, 9, 301)
    x[::4] = np.nan
    rows = [(i, None if np.isnan(v) else float(v), 3.0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, x double, flat double")
    fit = {r.feature: r for r in matrix.fit_scaler(df, ["x", "flat"]).collect()}
    med = np.nanmedian(x)
    filled = np.where(np.isnan(x), med, x)
    assert fit["x"].median == pytest.approx(med) and fit["x"].mean == pytest.approx(filled.mean()) and fit["x"].std == pytest.approx(filled.std())
    assert fit["flat"].std == 1.0
    out = matrix.apply_scaler(df, matrix.fit_scaler(df, ["x", "flat"]), ["x", "flat"])
    got = {r.id: r for r in out.collect()}
    assert got[0].x == pytest.approx((med - filled.mean()) / filled.std()) and got[5].flat == 0.0
    assert matrix.varying_features(df, ["x", "flat"]) == ["x"]


def test_splits_and_samples(spark):
    rng = random.Random(4)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randint(1, 30), int(rng.random() < 0.2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, g int, y int")
    split = matrix.group_holdout(df, ["g"]).collect()
    sides = {}
    for r in split:
        sides.setdefault(r.g, set()).add(r.is_validation)
    assert all(len(s) == 1 for s in sides.values())
    assert sum(1 in s for s in sides.values()) == math.ceil(0.2 * len(sides))
    assert matrix.group_holdout(df.filter("g = 1"), ["g"]).agg(F.sum("is_validation")).first()[0] == 0
    folds = {}
    for r in matrix.group_folds(df, ["g"], 5).collect():
        folds.setdefault(r.g, set()).add(r.fold)
    assert all(len(f) == 1 for f in folds.values()) and set().union(*folds.values()) == set(range(5))
    sizes = df.groupBy("y").count().collect()
    small = min(r["count"] for r in sizes)
    even = matrix.downsample_even(df, "y", ["id"]).groupBy("y").count().collect()
    assert [r["count"] for r in even] == [small, small]
    assert matrix.downsample_even(df.filter("y = 0"), "y", ["id"]).count() == df.filter("y = 0").count()
    one = {r.id for r in matrix.balanced_sample(df, "y", ["id"], 50).collect()}
    again = {r.id for r in matrix.balanced_sample(df.repartition(7), "y", ["id"], 50).collect()}
    assert one == again and len(one) == 100
    drawn = matrix.resample_balanced(df, "y", ["id"]).collect()
    assert len(drawn) == 600 and 220 < sum(r.y for r in drawn) < 380 and len({r.id for r in drawn}) < 600
    with pytest.raises(ValueError):
        matrix.sample_per_class(df.filter("y = 0"), "y", ["id"], 5, 1)


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 0)], "g string, y int")
    got = {r.g: r.pos_weight for r in matrix.class_weights(df, "y", ["g"]).collect()}
    assert got == {"a": 2.0, "b": 1.0}
    assert matrix.class_weights(df, "y", cap=1.5).first().pos_weight == 1.5


# ------------------------------------------------------------------ evaluation
def auc_reference(y, s):
    pos, neg = [b for a, b in zip(y, s) if a], [b for a, b in zip(y, s) if not a]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def ap_reference(y, s):
    total, out, seen = sum(y), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = [a for a, b in zip(y, s) if b >= t]
        out += (sum(hit) / total - seen) * sum(hit) / len(hit)
        seen = sum(hit) / total
    return out


def test_ranking_metrics(spark):
    rng = random.Random(8)
    y = [int(rng.random() < 0.3) for _ in range(300)]
    s = [round(rng.random() * 0.6 + 0.3 * a, 2) for a in y]
    df = spark.createDataFrame([("x", a, b) for a, b in zip(y, s)] + [("flat", 0, 0.4), ("flat", 0, 0.9)], "g string, y int, s double")
    got = {r.g: r for r in evaluate.ranking_metrics(df, "y", "s", ["g"]).collect()}
    assert got["x"].roc_auc == pytest.approx(auc_reference(y, s)) and got["x"].average_precision == pytest.approx(ap_reference(y, s))
    assert got["flat"].roc_auc is None and got["flat"].average_precision is None
    own = df.filter("g = 'x'")
    curve = evaluate.roc_points(own, "y", "s").orderBy(F.desc("threshold")).collect()
    assert (curve[0].fpr, curve[0].tpr) == (0.0, 0.0) and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)
    area = sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(got["x"].roc_auc)
    m = evaluate.threshold_metrics(own, "y", "s", 0.5).first()
    assert m.tp + m.fn == sum(y) and m.recall == m.sensitivity == m.tp / sum(y)
    none = evaluate.threshold_metrics(own.filter("y = 0"), "y", "s", 2.0).first()
    assert (none.precision, none.recall, none.f1, none.sensitivity, none.specificity) == (0.0, 0.0, 0.0, None, 1.0)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    v, y = rng.normal(size=200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b), 5.0) for a, b in zip(v, y)], "v double, y int, c double")
    got = evaluate.histogram_by_label(df, ["v", "c"], "y", 10).collect()
    edges = np.histogram_bin_edges(v, bins=10)
    for label in (0, 1):
        want, _ = np.histogram(v[y == label], bins=edges)
        assert [r.n for r in sorted((r for r in got if r.feature == "v" and r.y == label), key=lambda r: r.bin)] == list(want)
    flat = [r for r in got if r.feature == "c" and r.n > 0]
    assert {r.bin for r in flat} == {5} and all(r.pct == 100.0 for r in flat)


# ------------------------------------------------------------------ models
def test_permuted_column_is_a_permutation(spark):
    df = spark.range(200).select("id", (F.col("id") * 3).alias("v"), F.lit(1).alias("w"))
    out = models.permuted(df, ["id"], ["v", "w"], ["v"], 2, 7).collect()
    for turn in (0, 1):
        own = [r for r in out if r.turn == turn]
        assert sorted(r.v for r in own) == [3 * i for i in range(200)] and all(r.v != 3 * r.id for r in own)
    again = models.permuted(df.repartition(5), ["id"], ["v", "w"], ["v"], 2, 7).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_skewed_values_fall_into_like_ranges(spark):
    from gapline.operators.blocks import range_block, sampled_block

    df = spark.range(4000).select((F.pow(F.lit(0.5), F.col("id") % 1000)).alias("v"), F.concat(F.lit("patient_"), F.col("id")).alias("t"))
    for blocked in (range_block(df, "v", 16), sampled_block(df.union(spark.createDataFrame([(1.0, "!")], "v double, t string")), "t", 16)):
        sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
        assert len(sizes) >= 12 and max(sizes) <= 4000 / 16 * 3


def test_trees_find_the_signal(spark):
    rng = random.Random(3)
    rows = [(i, i % 40, rng.random(), rng.random()) for i in range(400)]
    df = spark.createDataFrame([(i, g, a, b, int(a > 0.5)) for i, g, a, b in rows], "id int, g int, a double, b double, y int")
    best, scores, metrics = models.cross_validate(df, ["a", "b"], "y", ["g"], k=2, trees=3, depth=2, step=0.3)
    assert scores.count() == 400 and all(r.roc_auc > 0.95 for r in metrics.collect())
    table = models.importance_table(best, ["a", "b"], spark)
    assert evaluate.top_features(table, 1).first().feature == "a"
    loss = {r.feature: r.importance_mean for r in models.permutation_importance(best, df, ["a", "b"], "y", ["id"], 2).collect()}
    assert loss["a"] > 0.2 and abs(loss["b"]) < 0.1


def test_fusion_uses_common_entities(spark):
    static = spark.createDataFrame([(i, i / 20) for i in range(20)], "mother_id int, static_score double")
    seqs = spark.createDataFrame([(i, i / 20) for i in range(5, 25)] + [(5, 0.75)], "mother_id int, sequence_score double")
    ys = spark.createDataFrame([(i, int(i > 10)) for i in range(18)], "mother_id int, y_doc int")
    from gapline.plans.training import fuse

    out = {r.mother_id: r for r in fuse(static, seqs, ys, c=100.0).collect()}
    assert sorted(out) == list(range(5, 18)) and out[5].sequence_score == 0.5 and out[17].fused_score > out[6].fused_score


def test_no_task_gets_all_rows_of_a_text(spark):
    """A few texts own all rows: the join that codes them is dealt over many tasks."""
    from pyspark.sql import functions as F

    from gapline.operators import statics

    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kids = spark.range(2000).select(
            F.col("id").cast("string").alias("hashed_mother_id"),
            F.when(F.col("id") % 4 == 0, " Breech .").when(F.col("id") % 4 < 3, "Cephalic").alias("pose"),
        )
        coded = statics._with_codes(kids, statics.pose_codebook(kids), "hashed_mother_id").withColumn("task", F.spark_partition_id())
        counts = {r.pose_code: (r.n, r.tasks) for r in coded.groupBy("pose_code").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert {k: n for k, (n, _) in counts.items()} == {0.0: 500, 1.0: 1000, None: 500}
    assert min(tasks for _, tasks in counts.values()) > 1

"""Flows over the driver tables that compose several operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.config import ENTITY, PRESSURE_NAMES, TrainingSettings
from gapline.functions.clock import hour_us
from gapline.operators.blocks import one_row
from gapline.operators import episodes as ep
from gapline.operators import grids, labels
from gapline.plans import flows, training
from gapline.session import shared_folder
from gapline.sources.writers import materialize
from gapline.suite.registry import query, table
from gapline.suite.snapshots import DOSE_SQL, STEP, doses, spans
from gapline.suite.statics import CHILD_SQL, MOTHER_SQL, _derived, _rounded, mothers, newborns
from gapline.suite.timeline import EPISODE, KEY, events
from gapline.suite.training import LAB_SQL, _vectors, _vectors_sql, label_rows

_slim_names = """age_on_date, round(bmi, 6) AS bmi, parity_primip, "number_of_pregnancies_G", "number_of_births_P", prior_csection,
  anesthesia_epidural, labor_stage1_dur_min, labor_stage2_dur_min"""


@query("W06 A13 P50 J14 S16", f"""WITH {MOTHER_SQL}, {CHILD_SQL},
n AS (SELECT hashed_mother_id, count(g) AS fetus_count, min(w) AS birthweight_min_g, max(w) AS birthweight_max_g, round(avg(w), 9) AS birthweight_mean_g,
  CAST(min(a1) AS DOUBLE) AS apgar1_min, min(a5) AS apgar5_min, max(nicu) AS any_nicu, CAST(count(g) >= 2 AS INT) AS multiple_gestation FROM c GROUP BY hashed_mother_id),
s AS (SELECT hashed_mother_id, CAST(row_number() OVER (PARTITION BY hashed_mother_id ORDER BY fetus_count, pregs NULLS LAST, seq) AS INT) AS pregnancy_index,
  {_slim_names} FROM (SELECT hashed_mother_id, fetus_count, pregs, seq, {_derived} FROM m))
SELECT s.*, coalesce(fetus_count, 1) AS fetus_count, birthweight_min_g, birthweight_max_g, birthweight_mean_g, apgar1_min, apgar5_min, any_nicu,
  coalesce(multiple_gestation, 0) AS multiple_gestation FROM s LEFT JOIN n USING (hashed_mother_id)""")
def static_table(spark, d):
    """Mothers and newborns to one stored static table."""
    out = flows.static_table(mothers(spark, d), newborns(spark, d), shared_folder(spark))
    return _rounded(out).withColumn("birthweight_mean_g", F.round("birthweight_mean_g", 9))


def _raw_rows(spark, d):
    kinds = {"view": PRESSURE_NAMES["diastolic"][0], "click": PRESSURE_NAMES["diastolic"][1], "signup": PRESSURE_NAMES["systolic"][0],
             "purchase": PRESSURE_NAMES["systolic"][1]}
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")], F.lit("pulse"))
    value = F.when(F.col("event_id") % 7 != 0, F.col("value").cast("string")).otherwise("n/a")
    return events(spark, d).select(
        "event_id", F.col("user_id").cast("string").alias(ENTITY), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("parameter_time"),
        name.alias("Parameter_Name"), value.alias("ResultNumeric"),
    )


@query("P25 P03 A02 J06", """WITH r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t, event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events),
w AS (SELECT id, t, """ + ", ".join(f"arg_min(v, event_id) FILTER (WHERE event_type = '{k}' AND v IS NOT NULL) AS {k}" for k in ("view", "click", "signup", "purchase")) + """,
  arg_min(v, event_id) FILTER (WHERE event_type NOT IN ('view', 'click', 'signup', 'purchase') AND v IS NOT NULL) AS pulse FROM r GROUP BY id, t),
x AS (SELECT id, t, pulse, coalesce("view", click) AS dia, coalesce(signup, purchase) AS sys FROM w),
y AS (SELECT *, lag(t) OVER p AS pt, lead(t) OVER p AS nt, lag(dia) OVER p AS pd, lead(dia) OVER p AS nd, lag(sys) OVER p AS ps, lead(sys) OVER p AS ns
  FROM x WINDOW p AS (PARTITION BY id ORDER BY t)),
z AS (SELECT id, t, pulse, CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN pd ELSE nd END AS dia,
  CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t - pt <= nt - t) THEN ps ELSE ns END AS sys FROM y)
SELECT id AS hashed_mother_id, t AS parameter_time, pulse, dia AS diastolic, sys AS systolic FROM z WHERE dia IS NOT NULL OR sys IS NOT NULL""")
def raw_measurement_pairs(spark, d):
    """Raw text values to wide rows, two spellings of each pressure coalesced, pressures of the nearest other day."""
    return flows.nearest_measurements(_raw_rows(spark, d), "event_id", ["pulse"], ["diastolic", "systolic"])


@query("M19 A19 A21 O03", f"""WITH {LAB_SQL}, f AS (SELECT user_id, episode_idx, min(snapshot_time) FILTER (WHERE label > 0) AS first_t,
  CAST(max(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS INT) AS bleed_flag FROM lab GROUP BY user_id, episode_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY bleed_flag ORDER BY md5(concat_ws('|', '111', user_id, episode_idx)), user_id, episode_idx) AS rn FROM f),
x AS (SELECT ep.user_id, ep.episode_idx, date_trunc('hour', ep.ts) AS t, ep.value, ep.event_id, bleed_flag, first_t FROM ep JOIN r USING (user_id, episode_idx) WHERE rn <= 25)
SELECT user_id, episode_idx, CAST(t AS TIMESTAMP) AS snapshot_time, value, event_id, bleed_flag,
  (epoch_us(t) - min(epoch_us(t)) OVER (PARTITION BY user_id, episode_idx)) / 6e7 AS mins_postpartum,
  (epoch_us(first_t) - min(epoch_us(t)) OVER (PARTITION BY user_id, episode_idx)) / 6e7 AS first_event_min FROM x""")
def event_marked_series(spark, d):
    """Series of 25 sampled episodes with and 25 without an event, in minutes, with the minute of the first event."""
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", 24 * hour_us).select(
        *EPISODE, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("snapshot_time"), "value", "event_id"
    )
    return flows.event_marked_series(rows, label_rows(spark, d), EPISODE, ["value", "event_id"], 25, 111)


@query("L04 J07 S14", f"""WITH {DOSE_SQL},
n AS (SELECT g.user_id, g.episode_idx, g.snap, max(d.d) AS d FROM g LEFT JOIN d
  ON d.user_id = g.user_id AND d.episode_idx = g.episode_idx AND d.d <= g.snap GROUP BY g.user_id, g.episode_idx, g.snap)
SELECT CAST(user_id AS VARCHAR) AS hashed_mother_id, episode_idx, snap AS snapshot_time, CAST(CASE WHEN snap - d <= INTERVAL 8 HOUR THEN 1 ELSE 0 END AS INT) AS label FROM n""")
def label_vector(spark, d):
    """The label vector of the post-dose labels, after the check that all labels are 0 or 1."""
    grid = grids.closed_grid(spans(spark, d), EPISODE, "ep_start_us", "ep_end_us", STEP)
    snaps = grid.select(*EPISODE, grids.from_micros("snapshot_us").alias("snapshot_time"))
    out = labels.label_after_event(snaps, doses(spark, d), EPISODE, window_us=8 * hour_us)
    folder = shared_folder(spark)
    stored = materialize(spark, f"{folder}/labelled", lambda: out.withColumn(ENTITY, F.col("user_id").cast("string")))
    return flows.labelled_outputs(stored)[1]


@query("M02 M05 M07 M10 S20", f"""WITH {_vectors_sql}, g AS (SELECT DISTINCT grp FROM v),
r AS (SELECT grp, row_number() OVER (ORDER BY md5(concat_ws('|', '42', grp, 1)), grp) AS rn, count(*) OVER () AS n FROM g)
SELECT count(*) AS n_validation, CAST(sum(planted) AS BIGINT) AS n_positive, TRUE AS signal_found FROM v JOIN r USING (grp) WHERE rn <= greatest(1, ceil(n * 0.2))""")
def holdout_flow(spark, d):
    """Hold-out by group with train-fit scaling on all features; its report is written and read back."""
    rows, names = _vectors(spark, d)
    holes = {c: F.when((F.col("vec_id") + i) % 9 != 0, F.col(c)) for i, c in enumerate(names) if c != "f03"}
    matrix = rows.withColumns(holes).drop("y").withColumnsRenamed({"planted": "y", "group": ENTITY}).withColumn("episode_idx", F.lit(1))
    report = training.train_holdout(matrix, names, TrainingSettings(trees=5, depth=3, step=0.3))
    folder = report.write(shared_folder(spark))
    area = spark.read.schema("roc_auc DOUBLE, average_precision DOUBLE").json(f"{folder}/metrics")
    counts = spark.read.parquet(f"{folder}/scores").agg(F.count(F.lit(1)).alias("n_validation"), F.sum("y").alias("n_positive"))
    return counts.withColumn("signal_found", one_row(area)["roc_auc"] > 0.9)


@query("J21 P46 P48", """WITH y AS (SELECT o_custkey AS id, CAST(CASE arg_min(o_orderkey % 3, o_orderkey) WHEN 0 THEN 1 ELSE 0 END AS INT) AS y_doc
  FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY o_custkey)
SELECT c_custkey AS mother_id, CAST(c_acctbal AS DOUBLE) AS c_acctbal, c_nationkey, y_doc FROM customer JOIN y ON y.id = c_custkey WHERE c_custkey IN (SELECT user_id FROM events)""")
def static_matrix(spark, d):
    """Numeric static columns of entities that have a documented label and a sequence."""
    from gapline.config import NO_TOKEN, YES_TOKEN

    k = F.col("o_orderkey") % 3
    answers = table(spark, d, "orders").select(
        F.col("o_custkey").alias("mother_id"), "o_orderkey", F.when(k == 0, YES_TOKEN).when(k == 1, NO_TOKEN).otherwise("?").alias("answer")
    )
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("mother_id"), "c_acctbal", "c_nationkey", "c_mktsegment")
    told = labels.documented_labels(answers, "mother_id", "answer", YES_TOKEN, NO_TOKEN, "o_orderkey")
    seen = table(spark, d, "events").select(F.col("user_id").alias("mother_id"))
    rows, names = training.static_matrix(static, told, seen)
    return rows.select("mother_id", *names, "y_doc")

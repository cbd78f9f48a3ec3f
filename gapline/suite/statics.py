"""Static attribute queries: customers play mothers, orders pregnancies, line items newborns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.config import ENTITY, SLIM_STATIC
from gapline.functions import scalar
from gapline.operators import reshape, statics
from gapline.suite.registry import query, table

MOTHER_SQL = """
m AS (SELECT CAST(o_custkey AS VARCHAR) AS hashed_mother_id, o_orderkey AS seq, month(o_orderdate) AS fetus_count,
  CASE WHEN o_orderstatus <> 'P' THEN length(o_orderpriority) END AS pregs,
  o_totalprice / 5000 AS weight, CASE WHEN o_orderkey % 50 = 0 THEN 0 ELSE 140 + o_orderkey % 60 END AS height,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 3 END AS births, o_orderkey % 5 - 2 AS cs,
  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 7 END AS h1, o_orderkey % 11 AS h2,
  (o_orderkey % 30) * 60 + o_orderkey % 60 AS b, (o_orderkey % 23) * 60 + o_orderkey % 50 AS e,
  o_orderkey % 3 AS anesthesia, o_orderkey % 40 AS age FROM orders)
"""


def mothers(spark, d):
    k = F.col("o_orderkey")

    def clock_text(hours, minutes):
        return F.format_string("%d:%02d:00", hours, minutes)

    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias(ENTITY), k.alias("seq"), F.month("o_orderdate").alias("fetus_count"),
        F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority").cast("string")).alias("number_of_pregnancies_G"),
        (F.col("o_totalprice") / 5000).alias("weight_before_birth"),
        F.when(k % 50 == 0, 0).otherwise(140 + k % 60).alias("height"),
        F.when(k % 4 != 0, k % 3).alias("number_of_births_P"), (k % 5 - 2).alias("number_of_cesareans_CS"),
        F.when(k % 2 == 0, k % 7).cast("string").alias("first_stage_hours"), (k % 11).alias("second_stage_hours"),
        clock_text(k % 30, k % 60).alias("first_stage_begin"), clock_text(k % 23, k % 50).alias("first_stage_end"),
        (k % 3).cast("string").alias("anesthesia_epidural"), (k % 40).alias("age_on_date"),
    )


_slim = """age_on_date, bmi, parity_primip, number_of_pregnancies_G, number_of_births_P, prior_csection, anesthesia_epidural,
  labor_stage1_dur_min, labor_stage2_dur_min"""
_derived = """age AS age_on_date, CASE WHEN height <> 0 THEN weight / ((height / 100.0) * (height / 100.0)) END AS bmi,
  CAST(coalesce(births, 0) = 0 AS INT) AS parity_primip, CAST(pregs AS DOUBLE) AS "number_of_pregnancies_G",
  births AS "number_of_births_P", CAST(coalesce(cs, 0) > 0 AS INT) AS prior_csection, CAST(anesthesia > 0 AS INT) AS anesthesia_epidural,
  CAST(coalesce(h1 * 60, CASE WHEN e >= b THEN e - b ELSE e END) AS DOUBLE) AS labor_stage1_dur_min, h2 * 60 AS labor_stage2_dur_min"""


def _rounded(df):
    return df.withColumns({"bmi": F.round("bmi", 6)})


@query("P18 P19 P20 P22 W06 P47", f"""WITH {MOTHER_SQL}
SELECT hashed_mother_id, CAST(row_number() OVER (PARTITION BY hashed_mother_id ORDER BY fetus_count, pregs NULLS LAST, seq) AS INT)
  AS pregnancy_index, x.* REPLACE (round(bmi, 6) AS bmi) FROM (SELECT hashed_mother_id, fetus_count, pregs, seq, {_derived} FROM m) x
QUALIFY true""".replace("x.* REPLACE (round(bmi, 6) AS bmi)", "age_on_date, round(bmi, 6) AS bmi, parity_primip, \"number_of_pregnancies_G\", \"number_of_births_P\", prior_csection, anesthesia_epidural, labor_stage1_dur_min, labor_stage2_dur_min").replace("\nQUALIFY true", ""))
def mothers_static(spark, d):
    """Slim static columns per pregnancy: BMI, flags, labour stages, derived index."""
    return _rounded(statics.mothers_static(mothers(spark, d)))


@query("W09 P47", f"""WITH {MOTHER_SQL}, x AS (SELECT hashed_mother_id, seq, {_derived} FROM m)
SELECT hashed_mother_id, age_on_date, round(bmi, 6) AS bmi, parity_primip, "number_of_pregnancies_G", "number_of_births_P",
  prior_csection, anesthesia_epidural, labor_stage1_dur_min, labor_stage2_dur_min
FROM x WHERE seq = (SELECT min(seq) FROM m WHERE m.hashed_mother_id = x.hashed_mother_id)""")
def mothers_static_single(spark, d):
    return _rounded(statics.mothers_static_single(mothers(spark, d)))


# ------------------------------------------------------------------ newborns
CHILD_SQL = """
c AS (SELECT CAST(l_orderkey AS VARCHAR) AS hashed_mother_id, CASE WHEN l_linenumber % 3 = 0 THEN 'Male' WHEN l_linenumber % 3 = 1 THEN 'f' END AS g,
  CASE WHEN l_linenumber % 3 = 0 THEN 1.0 WHEN l_linenumber % 3 = 1 THEN 0.0 END AS gc,
  l_extendedprice / 20 AS w, l_linenumber AS a1, CASE WHEN l_quantity > 25 THEN l_quantity END AS a5,
  CAST(l_tax > 0.06 AS INT) AS nicu, l_returnflag AS pose, l_linestatus AS bt, l_discount AS still, l_quantity AS weeks FROM lineitem)
"""


def newborns(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias(ENTITY), F.when(n % 3 == 0, "Male").when(n % 3 == 1, "f").alias("child_gender"),
        (F.col("l_extendedprice") / 20).alias("weight"), n.alias("apgar1"),
        F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("apgar5"),
        (F.col("l_tax") > 0.06).cast("int").alias("nicu_hospitalization"),
        F.concat(F.lit(" "), "l_returnflag", F.lit(" .")).alias("pose"), F.col("l_linestatus").alias("birth_type"),
        F.when(F.col("l_discount") > 0.08, 1).otherwise(0).alias("stillborn"), F.col("l_quantity").alias("pregnancy_weeks"),
        F.lit("1").alias("newborn_medical_record"), (F.col("l_linenumber") + 7).alias("PH -Cord, V"),
        (F.col("l_linenumber") + 6).alias("PH -Cord, Ar"), (F.col("l_linenumber") * 3).alias("Base Excess -Cord, V"),
        (-F.col("l_linenumber")).alias("Base Excess -Cord, Ar"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("days_in_hospital"),
    )


@query("A13 P50 J14", f"""WITH {CHILD_SQL},
n AS (SELECT hashed_mother_id, count(g) AS fetus_count, min(w) AS birthweight_min_g, max(w) AS birthweight_max_g,
  round(avg(w), 9) AS birthweight_mean_g, CAST(min(a1) AS DOUBLE) AS apgar1_min, min(a5) AS apgar5_min, max(nicu) AS any_nicu,
  CAST(count(g) >= 2 AS INT) AS multiple_gestation FROM c GROUP BY hashed_mother_id)
SELECT CAST(o_orderkey AS VARCHAR) AS hashed_mother_id, n.* EXCLUDE (hashed_mother_id, fetus_count, multiple_gestation),
  coalesce(fetus_count, 1) AS fetus_count, coalesce(multiple_gestation, 0) AS multiple_gestation
FROM orders LEFT JOIN n ON n.hashed_mother_id = CAST(o_orderkey AS VARCHAR)""")
def child_aggregates(spark, d):
    """Newborn aggregates onto every mother, with singleton defaults where there are none."""
    agg = statics.newborns_basic(newborns(spark, d))
    agg = agg.withColumn("birthweight_mean_g", F.round("birthweight_mean_g", 9))
    own = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias(ENTITY))
    return statics.join_newborns(own, agg, defaults=True)


@query("A14 A16 P23 P24", f"""WITH {CHILD_SQL},
book AS (SELECT pose, CAST(row_number() OVER (ORDER BY pose) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT pose FROM c)),
k AS (SELECT c.*, code FROM c JOIN book USING (pose)),
gm AS (SELECT hashed_mother_id, gc, row_number() OVER (PARTITION BY hashed_mother_id ORDER BY count(*) DESC, gc) AS rn FROM k
  WHERE gc IS NOT NULL GROUP BY hashed_mother_id, gc),
pm AS (SELECT hashed_mother_id, code, row_number() OVER (PARTITION BY hashed_mother_id ORDER BY count(*) DESC, code) AS rn FROM k
  GROUP BY hashed_mother_id, code)
SELECT k.hashed_mother_id, count(g) AS n_children, CAST(max(nicu) AS INT) AS any_nicu, any_value(CAST(gm.gc AS DOUBLE)) AS gender_mode_code,
  round(avg(CAST(k.gc AS DOUBLE)), 6) AS gender_prop_male, any_value(pm.code) AS pose_mode_code,
  CAST(coalesce(max(k.gc), 0) > 0 AS INT) AS any_male, CAST(coalesce(avg(k.gc), 1) < 1 AS INT) AS any_female,
  min(w) AS birthweight_min_g, max(w) AS birthweight_max_g, round(avg(w), 9) AS birthweight_mean_g, CAST(min(a1) AS DOUBLE) AS apgar1_min, min(a5) AS apgar5_min
FROM k LEFT JOIN gm ON gm.hashed_mother_id = k.hashed_mother_id AND gm.rn = 1
LEFT JOIN pm ON pm.hashed_mother_id = k.hashed_mother_id AND pm.rn = 1 GROUP BY k.hashed_mother_id""")
def child_codes(spark, d):
    out = statics.newborns_coded(newborns(spark, d))
    return out.withColumns({"gender_prop_male": F.round("gender_prop_male", 6), "birthweight_mean_g": F.round("birthweight_mean_g", 9)})


@query("A15 A16 J22", f"""WITH {CHILD_SQL},
bm AS (SELECT hashed_mother_id, bt, row_number() OVER (PARTITION BY hashed_mother_id ORDER BY count(*) DESC, bt) AS rn FROM c GROUP BY hashed_mother_id, bt)
SELECT c.hashed_mother_id, CAST(count(*) AS INT) AS fetus_count, CAST(max(CASE WHEN still > 0.08 THEN 1 ELSE 0 END) AS INT) AS stillborn_any,
  CAST(max(a1) AS DOUBLE) AS apgar1_max, round(avg(a1), 9) AS apgar1_mean, round(avg(a5), 9) AS apgar5_mean, min(weeks) AS preg_weeks_min,
  max(weeks) AS preg_weeks_max, any_value(bm.bt) AS mode_birth_type, CAST(count(*) >= 2 AS INT) AS multiple_gestation,
  CAST(min(a1) AS DOUBLE) AS apgar1_min, min(a5) AS apgar5_min, max(a5) AS apgar5_max, min(w) AS birthweight_min_g, max(w) AS birthweight_max_g,
  round(avg(w), 9) AS birthweight_mean_g, round(avg(weeks), 9) AS preg_weeks_mean, round(avg(a1 + 7), 9) AS cord_ph_v_mean, round(avg(a1 + 6), 9) AS cord_ph_a_mean,
  round(avg(a1 * 3), 9) AS base_excess_v_mean, round(avg(-a1), 9) AS base_excess_a_mean, round(avg(CASE WHEN weeks > 5 THEN weeks END), 9) AS days_in_hosp_mean,
  any_value(pm.p) AS mode_pose
FROM c JOIN (SELECT hashed_mother_id, ' ' || pose || ' .' AS p, row_number() OVER (PARTITION BY hashed_mother_id ORDER BY count(*) DESC, pose) AS rn
  FROM c GROUP BY hashed_mother_id, pose) pm ON pm.hashed_mother_id = c.hashed_mother_id AND pm.rn = 1 JOIN bm ON bm.hashed_mother_id = c.hashed_mother_id AND bm.rn = 1 GROUP BY c.hashed_mother_id""")
def child_ranges(spark, d):
    out = statics.newborns_full(newborns(spark, d))
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith(("_mean", "_mean_g"))})


@query("P24 S19", """SELECT t AS pose_text, CAST(row_number() OVER (ORDER BY t) - 1 AS DOUBLE) AS pose_code
FROM (SELECT DISTINCT lower(p_name) AS t FROM part)""")
def pose_codebook(spark, d):
    raw = table(spark, d, "part").select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" !?")).alias("pose"))
    return statics.pose_codebook(raw)


@query("J13 P39 P40 J04", """SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.c_acctbal, c.c_mktsegment,
  c.c_nationkey AS static__o_totalprice FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey""")
def static_join(spark, d):
    """Unique static rows onto snapshots; measured names are stripped, colliding names get a prefix."""
    snaps = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    static = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", F.col("c_nationkey").alias("o_totalprice"),
        F.col("c_acctbal").alias("systolic_24h_last_before_birth"), F.col("c_acctbal").alias("HGB"),
    )
    return statics.join_static(snaps, statics.strip_leaky_static(static, ["o_custkey"]), entity="o_custkey")


@query("J15", """SELECT CAST(c_custkey AS VARCHAR) AS hashed_mother_id, s.signal, CAST(s.b AS DOUBLE) AS baseline FROM customer,
  LATERAL (SELECT 'sistol' AS signal, c_acctbal AS b UNION ALL SELECT 'diastol', c_nationkey + 50.0 UNION ALL SELECT 'HGB', c_nationkey / 2.0
  UNION ALL SELECT 'MAP', (c_nationkey + 50.0) + (c_acctbal - (c_nationkey + 50.0)) / 3 UNION ALL SELECT 'PP', c_acctbal - (c_nationkey + 50.0)) s""".replace(
    "CAST(s.b AS DOUBLE) AS baseline", "round(CAST(s.b AS DOUBLE), 6) AS baseline"))
def baseline_lookup(spark, d):
    """Signal baselines found by column alias, in long form, with the derived ones."""
    static = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias(ENTITY), F.col("c_acctbal").alias("systolic_pressure_24h_last_before_birth"),
        (F.col("c_nationkey") + 50.0).alias("dbp_24h_last_before_birth"), (F.col("c_nationkey") / 2.0).alias("HGB"),
    )
    out = statics.baselines_long(static, [ENTITY], statics.baseline_columns(static.columns))
    return out.withColumn("baseline", F.round("baseline", 6))


@query("P46", """SELECT o_custkey AS mother_id, CAST(CASE arg_min(o_orderkey % 3, o_orderkey) WHEN 0 THEN 1 ELSE 0 END AS INT) AS y_doc
FROM orders WHERE o_orderkey % 3 <> 2 AND o_custkey IN (SELECT user_id FROM events) GROUP BY o_custkey""")
def documented_labels(spark, d):
    """First readable yes/no token per entity, for entities with a sequence."""
    from gapline.config import NO_TOKEN, YES_TOKEN
    from gapline.operators.labels import documented_labels as read_labels

    k = F.col("o_orderkey") % 3
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("mother_id"), "o_orderkey",
        F.when(k == 0, YES_TOKEN).when(k == 1, NO_TOKEN).otherwise("?").alias("answer"),
    )
    out = read_labels(rows, "mother_id", "answer", YES_TOKEN, NO_TOKEN, "o_orderkey")
    seen = table(spark, d, "events").select(F.col("user_id").alias("mother_id"))
    return reshape.semi_join(out, seen, ["mother_id"])

"""Matrix, split, evaluation and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.config import ENTITY, TrainingSettings
from gapline.operators import boosting, evaluate, labels, matrix, models
from gapline.operators.blocks import one_row
from gapline.plans import training as plan
from gapline.suite.registry import query, table
from gapline.suite.snapshots import TIMELINE_SQL, wide_timeline
from gapline.plans.snapshots import add_index
from gapline.functions.clock import day_us, hour_us
from gapline.operators import episodes as ep
from gapline.operators import reshape
from gapline.suite.timeline import EPISODE, EPISODES_SQL, KEY, event_bounds, events


def r9(col):
    return F.round(F.col(col) if isinstance(col, str) else col, 9)


# ------------------------------------------------------------------ transfusion labels
LABEL_SQL = """
r AS (SELECT user_id, ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS dose,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS prod,
  CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 20 HOUR THEN 1 ELSE 0 END AS is_new
  FROM events WHERE event_type IN ('purchase', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
p AS (SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS pregnancy_index FROM r),
c AS (SELECT user_id, pregnancy_index, CAST(sum(dose) AS INT) AS blood_dose, CAST(sum(prod) AS INT) AS blood_product FROM p
  GROUP BY user_id, pregnancy_index),
lab AS (SELECT *, CASE WHEN blood_dose = 0 THEN 0 WHEN blood_dose BETWEEN 1 AND 2 THEN 1 ELSE 2 END AS label FROM c)
"""
WORDS = dict(dose_words=("purchase",), product_words=("error",))


@query("L01 A06 A07 P15 W02", f"WITH {LABEL_SQL} SELECT * FROM lab")
def episode_labels(spark, d):
    return labels.episode_labels(events(spark, d), "user_id", "ts", "event_type", 20 * hour_us, **WORDS)


@query("A07", f"""WITH {LABEL_SQL} SELECT user_id, pregnancy_index, CASE WHEN blood_dose = 0 THEN 0
  WHEN blood_dose = 2 AND blood_product > 0 THEN 2 WHEN blood_dose BETWEEN 1 AND 2 THEN 1 ELSE 2 END AS label FROM c""")
def episode_labels_documented(spark, d):
    """The documented rule: two doses and a product count as severe."""
    out = labels.episode_labels(events(spark, d), "user_id", "ts", "event_type", 20 * hour_us, strict_doc=True, **WORDS)
    return out.select("user_id", "pregnancy_index", "label")


@query("L02 A08 A09 J18", f"""WITH {LABEL_SQL}
SELECT lab.user_id, lab.pregnancy_index, label, min(ts) AS first_positive_execution,
  string_agg(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ';' ORDER BY ts) AS execution_dates_iso
FROM lab JOIN p ON p.user_id = lab.user_id AND p.pregnancy_index = lab.pregnancy_index WHERE label > 0
GROUP BY lab.user_id, lab.pregnancy_index, label""")
def positive_dates(spark, d):
    return labels.positive_dates(events(spark, d), "user_id", "ts", "event_type", 20 * hour_us, **WORDS)


@query("L05 P08 P45 J05", f"""WITH {EPISODES_SQL},
own AS (SELECT user_id, ep_start, ep_end, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ep_start) AS INT) AS k FROM bounds),
l AS (SELECT user_id, ts + INTERVAL 5 HOUR AS t, CAST(length(event_type) % 4 AS INT) AS label, CAST(event_id % 3 AS DOUBLE) AS dose FROM events WHERE event_type <> 'view')
SELECT CAST(l.user_id AS VARCHAR) AS hashed_mother_id, 1 AS pregnancy_index, own.k AS episode_idx, t AS event_time_abs, label,
  CAST(label IN (1, 2) AS INT) AS label_pos, CAST(NULL AS TIMESTAMP) AS birth_datetime, dose AS blood_dose, CAST(NULL AS DOUBLE) AS blood_product
FROM l LEFT JOIN own ON own.user_id = l.user_id AND t BETWEEN own.ep_start AND own.ep_end""")
def label_alignment(spark, d):
    bounds = event_bounds(spark, d).withColumn(ENTITY, F.col("user_id").cast("string")).drop("user_id")
    rows = events(spark, d).filter("event_type <> 'view'").select(
        F.col("user_id").cast("string").alias(ENTITY), F.lit(1).alias("pregnancy_index"),
        (F.col("ts") + F.expr("INTERVAL 5 HOUR")).alias("event_time_abs"),
        (F.length("event_type") % 4).cast("int").alias("label"), (F.col("event_id") % 3).cast("string").alias("blood_dose"),
    )
    return labels.align_labels(rows, bounds).withColumn("blood_product", F.col("blood_product").cast("double"))


# ------------------------------------------------------------------ label tables
LAB_SQL = f"""{EPISODES_SQL},
lab AS (SELECT user_id, episode_idx, date_trunc('hour', ts) AS snapshot_time, event_id,
  CAST(CASE WHEN event_type = 'purchase' AND value > 80 THEN 2 WHEN event_type = 'error' AND value > 80 THEN 1 ELSE 0 END AS INT) AS label FROM ep)
"""


def label_rows(spark, d):
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us)
    value = F.when(F.expr("event_type = 'purchase' AND value > 80"), 2).when(F.expr("event_type = 'error' AND value > 80"), 1)
    return rows.select(
        *EPISODE, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("snapshot_time"), "event_id",
        value.otherwise(0).alias("label"),
    )


@query("J11 L06", f"""WITH {LAB_SQL}, y AS (SELECT user_id, episode_idx, snapshot_time, max(label) AS label FROM lab
  WHERE event_id % 3 = 0 GROUP BY user_id, episode_idx, snapshot_time)
SELECT x.event_id, x.user_id, x.episode_idx, CAST(x.snapshot_time AS TIMESTAMP) AS snapshot_time, coalesce(y.label, 0) AS label
FROM lab x LEFT JOIN y ON y.user_id = x.user_id AND y.episode_idx = x.episode_idx AND y.snapshot_time = x.snapshot_time""")
def label_intersection(spark, d):
    rows = label_rows(spark, d)
    return labels.label_at_time(rows.drop("label"), rows.filter("event_id % 3 = 0"), EPISODE)


@query("J12 L06", f"""WITH {LAB_SQL}, y AS (SELECT user_id, episode_idx, max(label) AS label FROM lab WHERE event_id % 3 = 0
  GROUP BY user_id, episode_idx)
SELECT x.event_id, x.user_id, x.episode_idx, CAST(x.snapshot_time AS TIMESTAMP) AS snapshot_time, coalesce(y.label, 0) AS label
FROM lab x LEFT JOIN y ON y.user_id = x.user_id AND y.episode_idx = x.episode_idx""")
def label_episode_level(spark, d):
    rows = label_rows(spark, d)
    return labels.label_at_time(rows.drop("label"), rows.filter("event_id % 3 = 0"), EPISODE, None)


@query("A21", f"""WITH {LAB_SQL} SELECT user_id, episode_idx, CAST(min(snapshot_time) FILTER (WHERE label > 0) AS TIMESTAMP) AS first_bleed_time,
  CAST(max(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS INT) AS bleed_flag FROM lab GROUP BY user_id, episode_idx""")
def first_positive(spark, d):
    return labels.first_positive(label_rows(spark, d), EPISODE)


@query("A18", f"""WITH {LAB_SQL}, m AS (SELECT user_id, episode_idx, max(label) AS label FROM lab GROUP BY user_id, episode_idx)
SELECT label, count(*) AS n_episodes FROM m GROUP BY label""")
def label_summary(spark, d):
    return labels.label_summary(label_rows(spark, d), EPISODE)


@query("A26", f"""WITH {LAB_SQL} SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_entities,
  count(DISTINCT (user_id, episode_idx)) AS n_episodes, CAST(sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) / count(*) AS positive_share FROM lab""")
def dataset_summary(spark, d):
    return matrix.dataset_summary(label_rows(spark, d), "user_id", EPISODE, "label")


@query("A23", """SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
  CAST(sum(CASE WHEN l_discount > 0.08 THEN 0 ELSE 1 END) AS BIGINT) AS n_neg,
  least(sum(CASE WHEN l_discount > 0.08 THEN 0 ELSE 1 END) / greatest(sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END), 1), 4.45) AS pos_weight
FROM lineitem GROUP BY l_returnflag""")
def class_weights(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") > 0.08).cast("int").alias("y"))
    return matrix.class_weights(rows, "y", ["l_returnflag"], cap=4.45)


@query("A17 J19", """WITH h AS (SELECT user_id, count(DISTINCT date_trunc('hour', ts)) AS hours,
  count(CASE WHEN event_type = 'view' THEN value END) AS a, count(CASE WHEN event_type = 'click' THEN value END) AS b,
  max(CASE WHEN event_type = 'purchase' AND value > 230 THEN 1 ELSE 0 END) AS dose FROM events GROUP BY user_id)
SELECT e.event_id FROM events e JOIN h ON h.user_id = e.user_id WHERE dose = 1 OR greatest(a, b) / hours >= 0.24""")
def frequency_filter(spark, d):
    kind = F.col("event_type")
    rows = events(spark, d).select(
        "event_id", "user_id", "ts", F.when(kind == "view", F.col("value")).alias("a"),
        F.when(kind == "click", F.col("value")).alias("b"),
    )
    doses = events(spark, d).filter("event_type = 'purchase' AND value > 230").select("user_id")
    return matrix.frequency_filter(rows, "user_id", "ts", ["a", "b"], doses, 0.24).select("event_id")


@query("J19", f"""WITH {EPISODES_SQL} SELECT b.user_id, b.episode_idx, CAST(max(CASE WHEN e.event_type = 'purchase' AND e.value > 80 THEN 1 ELSE 0 END) AS INT) AS has_dose
FROM bounds b JOIN ep e ON e.user_id = b.user_id AND e.episode_idx = b.episode_idx GROUP BY b.user_id, b.episode_idx""")
def dose_presence(spark, d):
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us)
    doses = rows.filter("event_type = 'purchase' AND value > 80").select(*EPISODE)
    return matrix.dose_presence(event_bounds(spark, d).select(*EPISODE), doses, EPISODE)


# ------------------------------------------------------------------ matrix
MATRIX_COLUMNS = {
    "sistol": "sistol_fine_mean", "diastol": "diastol_fine_delta_t", "pulse": "pulse_recency_s", "HGB": "HGB_fine_last",
    "heat": "heat_fine_mean", "MAP": "MAP_coarse_std",
}


@query("M01 P32 P33 P34 P35 P36 P37 P41 P42 P44 P45 P49 S06", f"""WITH {TIMELINE_SQL},
k AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 0),
y AS (SELECT CAST(user_id AS VARCHAR) AS id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t, max(CASE WHEN value > 120 THEN 3 WHEN value > 90 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END) AS label
  FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
x AS (SELECT raw.id, raw.t, tl.episode_idx, sistol_raw, "HGB_raw", c.c_nationkey FROM raw JOIN tl ON tl.id = raw.id AND tl.t = raw.t
  JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = raw.id WHERE raw.id IN (SELECT id FROM k))
SELECT x.id AS hashed_mother_id, x.episode_idx, x.episode_idx AS pregnancy_index, x.t AS snapshot_time,
  (epoch_us(x.t) - min(epoch_us(x.t)) OVER (PARTITION BY x.id, x.episode_idx)) / 6e7 AS mins_postpartum,
  CAST(CASE WHEN y.label IN (1, 2) THEN 1 ELSE 0 END AS INT) AS y,
  CAST(CAST(sistol_raw AS FLOAT) AS DOUBLE) AS sistol_fine_mean, CAST(CAST("HGB_raw" AS FLOAT) AS DOUBLE) AS "HGB_fine_last",
  CAST(x.c_nationkey AS DOUBLE) AS age_on_date
FROM x LEFT JOIN y ON y.id = x.id AND y.t = x.t""")
def matrix_build(spark, d):
    """Feature and label tables to the matrix: column plan, keep list, labels at the exact time, binary target."""
    wide = add_index(wide_timeline(spark, d), 2 * day_us)
    wide = wide.withColumn("MAP", F.col("sistol"))
    features = reshape.rename(wide, {**MATRIX_COLUMNS, "event_time_abs": "snapshot_time"})
    # a blocked realtime statistic and a metadata name never reach the matrix
    features = reshape.rename(features, {"MAP_coarse_std": "time_since_map_coarse_min"})
    age = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias(ENTITY), F.col("c_nationkey").alias("age_on_date"), "c_acctbal"
    )
    features = features.join(age.drop("c_acctbal"), ENTITY).withColumn("mother_id", F.col(ENTITY))
    doses = events(spark, d).filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias(ENTITY), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_time"),
        F.expr("CASE WHEN value > 120 THEN 3 WHEN value > 90 THEN 2 WHEN value > 60 THEN 1 ELSE 0 END").alias("label"),
    )
    own = features.select(ENTITY, "episode_idx", F.col("snapshot_time").alias("event_time"))
    doses = doses.join(own, [ENTITY, "event_time"])
    names = [c for c in features.columns if c != "mother_id"]
    out, used = plan.build_matrix(features, doses, names, age.filter("c_acctbal > 0"))
    return out.withColumns({c: F.col(c).cast("double") for c in used})


def _flawed(spark, d):
    """Line items with holes."""
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.when(n % 5 != 0, F.col("l_extendedprice")).alias("price"),
        F.when(n % 3 != 0, F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"), F.lit(7.0).alias("fixed"),
    )


_flawed_sql = """f AS (SELECT l_orderkey, l_linenumber, l_returnflag, CASE WHEN l_linenumber % 5 <> 0 THEN l_extendedprice END AS price,
  CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS quantity, l_tax AS tax, 7.0::DOUBLE AS fixed FROM lineitem)"""
_cols = ("price", "quantity", "tax", "fixed")


@query("M05", f"""WITH {_flawed_sql},
u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM f" for c in _cols)}),
m AS (SELECT feature, median(v) AS md FROM u GROUP BY feature),
s AS (SELECT u.feature, any_value(md) AS md, avg(coalesce(v, md)) AS mean, stddev_pop(coalesce(v, md)) AS sd FROM u JOIN m USING (feature) GROUP BY u.feature)
SELECT feature, md AS median, round(mean + 1e-9, 6) AS mean, round(CASE WHEN sd < 1e-8 THEN 1.0 ELSE sd END + 1e-9, 6) AS std FROM s""")
def scaler_fit(spark, d):
    """Median of the values, mean and std of the filled column, per feature; shifted off the ties of the rounding, as
    means of decimals often end on one."""
    out = matrix.fit_scaler(_flawed(spark, d), _cols)
    return out.withColumns({"mean": F.round(F.col("mean") + 1e-9, 6), "std": F.round(F.col("std") + 1e-9, 6)})


@query("M05", f"""WITH {_flawed_sql},
m AS (SELECT median(price) AS mp, median(quantity) AS mq FROM f),
g AS (SELECT l_orderkey, l_linenumber, coalesce(price, mp) AS price, coalesce(quantity, mq) AS quantity FROM f, m),
s AS (SELECT avg(price) AS ap, stddev_pop(price) AS sp, avg(quantity) AS aq, stddev_pop(quantity) AS sq FROM g)
SELECT l_orderkey, l_linenumber, round((price - ap) / sp, 6) AS price, round((quantity - aq) / sq, 6) AS quantity FROM g, s""")
def impute_standardize(spark, d):
    rows = _flawed(spark, d).select("l_orderkey", "l_linenumber", "price", "quantity")
    out = matrix.apply_scaler(rows, matrix.fit_scaler(rows, ["price", "quantity"]), ["price", "quantity"])
    return out.withColumns({"price": F.round("price", 6), "quantity": F.round("quantity", 6)})


@query("M06", f"""WITH {_flawed_sql} SELECT l_orderkey, l_linenumber, price, quantity,
  CAST(price IS NULL AS INT)::DOUBLE AS price_missing, CAST(quantity IS NULL AS INT)::DOUBLE AS quantity_missing FROM f""")
def missing_mask(spark, d):
    rows = _flawed(spark, d).select("l_orderkey", "l_linenumber", "price", "quantity")
    out = matrix.add_missing_mask(rows, ["price", "quantity"])
    return out.withColumns({c: F.col(c).cast("double") for c in ("price_missing", "quantity_missing")})


@query("A28 P48", f"""WITH {_flawed_sql}, m AS (SELECT median(CAST(price AS FLOAT)::DOUBLE) AS mp, median(CAST(quantity AS FLOAT)::DOUBLE) AS mq FROM f)
SELECT l_orderkey, l_linenumber, round(coalesce(CAST(price AS FLOAT)::DOUBLE, mp), 4) AS price, round(coalesce(CAST(quantity AS FLOAT)::DOUBLE, mq), 4) AS quantity FROM f, m""")
def median_fill(spark, d):
    from gapline.operators.columns import numeric_columns

    rows = _flawed(spark, d).select("l_orderkey", "l_linenumber", "price", "quantity")
    out = matrix.median_fill(rows, numeric_columns(rows, ["l_orderkey", "l_linenumber"]))
    return out.withColumns({c: F.round(F.col(c), 4) for c in ("price", "quantity")})


@query("A24", f"""WITH {_flawed_sql}, u AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v FROM f" for c in _cols)})
SELECT feature, round(var_samp(v), 4) AS variance FROM u GROUP BY feature HAVING var_samp(v) > 1e-12""")
def near_constant(spark, d):
    out = matrix.feature_variance(_flawed(spark, d), _cols).filter("variance > 1e-12")
    return out.withColumn("variance", F.round("variance", 4))


@query("A27 M18", f"""WITH {_flawed_sql}, l AS ({" UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS feature, {c} AS v FROM f WHERE {c} IS NOT NULL" for c in _cols)}),
e AS (SELECT feature, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM l GROUP BY feature),
b AS (SELECT l.feature, l_returnflag, least(CAST(floor((v - lo) / (hi - lo) * 20) AS INT), 19) AS bin FROM l JOIN e USING (feature)),
c AS (SELECT feature, l_returnflag, bin, count(*) AS n FROM b GROUP BY ALL),
t AS (SELECT feature, l_returnflag, sum(n) AS total FROM c GROUP BY ALL),
fr AS (SELECT t.feature, t.l_returnflag, total, lo, hi, CAST(unnest(range(20)) AS INT) AS bin FROM t JOIN e USING (feature))
SELECT fr.feature, fr.l_returnflag, fr.bin, round(lo + fr.bin * (hi - lo) / 20, 6) AS bin_start, coalesce(n, 0) AS n, round(coalesce(n, 0) / total * 100, 6) AS pct
FROM fr LEFT JOIN c ON c.feature = fr.feature AND c.l_returnflag = fr.l_returnflag AND c.bin = fr.bin""")
def histogram_by_label(spark, d):
    out = evaluate.histogram_by_label(_flawed(spark, d), _cols, "l_returnflag", 20)
    return out.withColumns({"bin_start": F.round("bin_start", 6), "pct": F.round("pct", 6)})


# ------------------------------------------------------------------ sampling and splits
def _rank(seed, keys, part="", source="orders", ids="o_orderkey"):
    hashed = f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"
    return f"row_number() OVER ({part} ORDER BY {hashed}, {', '.join(keys)})"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_totalprice") > 400000).cast("int").alias("y"))


_orders_sql = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice > 400000 AS INT) AS y FROM orders)"


@query("O02 U02 J10", f"""WITH {_orders_sql}, r AS (SELECT *, {_rank(111, ["o_orderkey"], "PARTITION BY y")} AS rn FROM o)
SELECT o_orderkey, o_custkey, o_orderstatus, y FROM r WHERE rn <= 1000""")
def balanced_sample(spark, d):
    return matrix.balanced_sample(_orders(spark, d), "y", ["o_orderkey"], 1000)


@query("O03", f"""WITH {_orders_sql}, r AS (SELECT *, {_rank(7, ["o_orderkey"], "PARTITION BY y")} AS rn FROM o)
SELECT o_orderkey, y FROM r WHERE rn <= 25""")
def profile_sample(spark, d):
    return matrix.sample_per_class(_orders(spark, d), "y", ["o_orderkey"], 25, 7).select("o_orderkey", "y")


@query("O04", f"""WITH {_orders_sql}, r AS (SELECT *, {_rank(123, ["o_orderkey"], "PARTITION BY y")} AS rn FROM o),
m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM o GROUP BY y))
SELECT o_orderkey, o_custkey, o_orderstatus, y FROM r, m WHERE rn <= m.n""")
def downsample_even(spark, d):
    return matrix.downsample_even(_orders(spark, d), "y", ["o_orderkey"])


@query("O05", f"""WITH {_orders_sql}, r AS (SELECT *, {_rank('42r', ["o_orderkey"], "PARTITION BY y")} AS rn, count(*) OVER (PARTITION BY y) AS n FROM o),
cl AS (SELECT y, count(*) AS n, row_number() OVER (ORDER BY y) - 1 AS k FROM o GROUP BY y),
h AS (SELECT o_orderkey AS draw_o_orderkey, ('0x' || substr(md5(concat_ws('|', '42c', o_orderkey)), 1, 12))::BIGINT AS hc,
  ('0x' || substr(md5(concat_ws('|', '42p', o_orderkey)), 1, 12))::BIGINT AS hp FROM o),
dr AS (SELECT draw_o_orderkey, cl.y, hp % cl.n + 1 AS rn FROM h JOIN cl ON cl.k = hc % 2)
SELECT dr.draw_o_orderkey, r.o_orderkey, r.o_custkey, r.o_orderstatus, dr.y FROM dr JOIN r ON r.y = dr.y AND r.rn = dr.rn""")
def resample_balanced(spark, d):
    """As many draws as rows, classes with equal weight, with replacement."""
    return matrix.resample_balanced(_orders(spark, d), "y", ["o_orderkey"])


@query("M02 M03", f"""WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, {_rank(42, ["o_custkey"])} AS rn, count(*) OVER () AS n FROM g)
SELECT o_orderkey, o.o_custkey, CAST(rn <= greatest(1, ceil(n * 0.2)) AS INT) AS is_validation FROM orders o JOIN r ON r.o_custkey = o.o_custkey""")
def group_holdout(spark, d):
    """Whole customers go to validation."""
    return matrix.group_holdout(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("M04", """WITH g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', o_custkey)), o_custkey) - 1 AS k FROM g)
SELECT o_orderkey, o.o_custkey, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INT) AS fold
FROM orders o JOIN r ON r.o_custkey = o.o_custkey""")
def group_kfold(spark, d):
    return matrix.group_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


@query("M04", """WITH RECURSIVE g AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', o_custkey)), o_custkey) AS k FROM g),
deal AS (SELECT 0::BIGINT AS k, 0 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL SELECT k + 1, place - 1, list_transform(range(1, 6), lambda i: loads[i] + CASE WHEN i = place THEN n ELSE 0 END)
  FROM (SELECT deal.k, r.n, deal.loads, list_position(deal.loads, list_min(deal.loads)) AS place FROM deal JOIN r ON r.k = deal.k + 1))
SELECT o_orderkey, o.o_custkey, CAST(fold AS INT) AS fold FROM orders o JOIN r USING (o_custkey) JOIN deal USING (k)""")
def greedy_kfold(spark, d):
    """Customers, those with most orders first, each to the fold with the fewest orders so far."""
    return matrix.greedy_folds(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"])


# ------------------------------------------------------------------ evaluation
SCORE_SQL = """s AS (SELECT l.doc_id, l.quality AS y, (d.n_chars % 97) / 97.0::DOUBLE AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""
CURVE_SQL = f"""{SCORE_SQL},
k AS (SELECT score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS neg FROM s GROUP BY score),
cu AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM k)"""


def scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 97 / 97.0).alias("score"))
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return rows.join(docs, "doc_id")


@query("M10 M11", f"""WITH {CURVE_SQL} SELECT round(CAST(sum(neg * (tp - pos / 2)) AS DOUBLE) / (max(p) * max(n)), 9) AS roc_auc,
  round(sum(pos * (tp / (tp + fp))) / max(p), 9) AS average_precision FROM cu""")
def ranking_metrics(spark, d):
    out = evaluate.ranking_metrics(scores(spark, d), "y", "score")
    return out.select(r9("roc_auc").alias("roc_auc"), r9("average_precision").alias("average_precision"))


@query("M13", f"""WITH {CURVE_SQL} SELECT round(score, 9) AS threshold, fp / n AS fpr, tp / p AS tpr FROM cu UNION ALL SELECT 2.0, 0.0, 0.0""")
def roc_points(spark, d):
    out = evaluate.roc_points(scores(spark, d), "y", "score")
    return out.select(r9(F.least("threshold", F.lit(2.0))).alias("threshold"), "fpr", "tpr")


@query("M13", f"""WITH {CURVE_SQL}, x AS (SELECT *, lag(score) OVER w AS before, lead(pos) OVER w AS pos1, lead(neg) OVER w AS neg1 FROM cu WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 9) AS threshold, fp / n AS fpr, tp / p AS tpr FROM x WHERE before IS NULL OR pos1 IS NULL OR pos <> pos1 OR neg <> neg1 UNION ALL SELECT 2.0, 0.0, 0.0""")
def roc_steps(spark, d):
    """The curve without points between two equal steps."""
    out = evaluate.roc_points(scores(spark, d), "y", "score", simplify="steps")
    return out.select(r9(F.least("threshold", F.lit(2.0))).alias("threshold"), "fpr", "tpr")


@query("M13", f"""WITH {CURVE_SQL}, x AS (SELECT *, lag(score) OVER w AS before, lead(pos) OVER w AS pos1, lead(neg) OVER w AS neg1 FROM cu WINDOW w AS (ORDER BY score DESC))
SELECT round(score, 9) AS threshold, fp / n AS fpr, tp / p AS tpr FROM x WHERE before IS NULL OR pos1 IS NULL OR pos * neg1 <> neg * pos1 UNION ALL SELECT 2.0, 0.0, 0.0""")
def roc_corners(spark, d):
    """The curve's corners alone."""
    out = evaluate.roc_points(scores(spark, d), "y", "score", simplify="slopes")
    return out.select(r9(F.least("threshold", F.lit(2.0))).alias("threshold"), "fpr", "tpr")


@query("M14", f"""WITH {CURVE_SQL} SELECT round(score, 9) AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM cu UNION ALL SELECT NULL, 1.0, 0.0""")
def pr_points(spark, d):
    out = evaluate.pr_points(scores(spark, d), "y", "score")
    return out.withColumn("threshold", r9("threshold"))


@query("M12", f"""WITH {SCORE_SQL}, c AS (SELECT CAST(count(*) FILTER (WHERE score < 0.5 AND y = 0) AS BIGINT) AS tn, count(*) FILTER (WHERE score >= 0.5 AND y = 0) AS fp,
  count(*) FILTER (WHERE score < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE score >= 0.5 AND y = 1) AS tp FROM s)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fp) AS specificity, tp / (tp + fn) AS sensitivity FROM c""")
def threshold_metrics(spark, d):
    return evaluate.threshold_metrics(scores(spark, d), "y", "score")


@query("M15", f"WITH {SCORE_SQL} SELECT y, CAST(score >= 0.5 AS INT) AS predicted, count(*) AS n FROM s GROUP BY ALL")
def confusion_table(spark, d):
    return evaluate.confusion_table(scores(spark, d), "y", "score")


@query("A22 J20", """WITH st AS (SELECT c_custkey AS id, c_acctbal / 10000 AS static_score FROM customer),
sq AS (SELECT o_custkey AS id, avg(o_totalprice / 500000) AS sequence_score FROM orders GROUP BY o_custkey),
y AS (SELECT user_id AS id, CAST(max(value) > 150 AS INT) AS y FROM events GROUP BY user_id)
SELECT st.id, static_score, round(sequence_score, 9) AS sequence_score, y FROM st JOIN sq USING (id) JOIN y USING (id)""")
def score_alignment(spark, d):
    """Entities with a static score, the mean of their episode scores, and a label."""
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("static_score"))
    seqs = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 500000).alias("sequence_score"))
    ys = events(spark, d).groupBy(F.col("user_id").alias("id")).agg((F.max("value") > 150).cast("int").alias("y"))
    return evaluate.align_scores(static, seqs, ys, "id").withColumn("sequence_score", r9("sequence_score"))


# ------------------------------------------------------------------ models
WIDTH = 64
_vectors_sql = "v AS (SELECT vec_id, vec_id % 120 AS grp, CAST(label >= 5 AS INT) AS y, CAST(embedding[4] > 0 AS INT) AS planted, embedding FROM embeddings)"


def _vectors(spark, d):
    """All dimensions of the vectors as features."""
    vectors = table(spark, d, "embeddings").select(
        "vec_id", (F.col("vec_id") % 120).alias("group"), (F.col("label") >= 5).cast("int").alias("y"),
        (F.get("embedding", F.lit(3)) > 0).cast("int").alias("planted"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i:02d}") for i in range(WIDTH)],
    )
    return vectors, [f"f{i:02d}" for i in range(WIDTH)]


def _whole_weights(rows, names):
    """Features in whole thousandths, so that sums are exact, and a fixed linear score over all of them."""
    rows = rows.withColumns({c: F.floor(F.col(c) * 1000).cast("double") for c in names})

    def add(table):
        total = F.lit(0.0)
        for i, c in enumerate(names):
            total = total + F.col(c) * float(i % 7 - 3)
        return table.withColumn("score", total)

    return rows, add


_linear_sql = " + ".join(f"floor(embedding[{i + 1}]::DOUBLE * 1000) * {i % 7 - 3}" for i in range(WIDTH))


@query("M07 M08 M16 A23")
def trees_cross_validated(spark, d):
    """Boosted trees with class weights on five grouped folds; metrics per fold (checked by tests)."""
    from gapline.session import shared_folder
    from gapline.sources.writers import materialize

    rows, names = _vectors(spark, d)
    work = shared_folder(spark)
    _, _, metrics = models.cross_validate(
        rows.drop("planted"), names, "y", ["group"], k=5, trees=5, depth=3, step=0.3,
        store=lambda made, name: materialize(spark, f"{work}/{name}", lambda: made, force=True),
    )
    return metrics


# ------------------------------------------------------------------ boosted trees on gaps
_ap_sql = """k AS (SELECT {keys}score, sum(y) AS pos, sum(1 - y) AS neg FROM s GROUP BY {keys}score),
cu AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY {part} ORDER BY score DESC) AS fp,
  sum(pos) OVER (PARTITION BY {part}) AS p, sum(neg) OVER (PARTITION BY {part}) AS n FROM k)"""
TREE_CUTS = {"quantity": range(1, 51), "discount": range(1, 11), "tax": range(1, 9)}
_parts_sql = """lines AS (SELECT l_orderkey, l_linenumber, CAST(l_returnflag = 'R' AS INT) AS y, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS quantity,
  CASE WHEN l_linenumber % 5 <> 0 THEN round(l_discount * 100) END AS discount, round(l_tax * 100) AS tax FROM lineitem)"""


def _returned_lines(spark, d):
    """Line items with holes and whether they came back; all features are whole numbers."""
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(n % 3 != 0, F.col("l_quantity")).cast("double").alias("quantity"),
        F.when(n % 5 != 0, F.round(F.col("l_discount") * 100)).alias("discount"), F.round(F.col("l_tax") * 100).alias("tax"),
    )


def _level_sql(name: str, rows: str) -> str:
    """Best cut per node of rows (node, g, h in units of 2^-20, features); missing values on either side."""
    u = " UNION ALL ".join(
        f"SELECT node, {i} AS f, '{c}' AS feature, {max(cuts)} AS top, {c} AS v, g, h FROM {rows}" for i, (c, cuts) in enumerate(TREE_CUTS.items())
    )
    each = ", ".join(f"sum({x}) OVER (PARTITION BY node, f) AS {x}a, sum({x}) OVER (PARTITION BY node, f ORDER BY v NULLS FIRST) AS {x}w, "
                     f"coalesce(sum({x}) FILTER (WHERE v IS NULL) OVER (PARTITION BY node, f), 0) AS {x}m" for x in "ghn")
    left = ", ".join(f"({x}w - CASE WHEN ml THEN 0 ELSE {x}m END) AS {x}i" for x in "ghn")
    real = ", ".join(f"{x}i::DOUBLE / 1048576 AS {x}l, ({x}a - {x}i)::DOUBLE / 1048576 AS {x}r, {x}a::DOUBLE / 1048576 AS {x}" for x in "gh")
    return f"""{name}k AS (SELECT node, f, feature, top, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM ({u}) GROUP BY ALL),
{name}s AS (SELECT node, f, feature, top, v, ml, {real}, na AS n, ni AS nl, na - ni AS nr FROM (SELECT *, {left} FROM (SELECT node, f, feature, top, v, {each} FROM {name}k), (SELECT unnest([FALSE, TRUE]) AS ml))),
{name} AS (SELECT *, gl * gl / (hl + 1) + gr * gr / (hr + 1) - g * g / (h + 1) AS gain, CASE WHEN v = top THEN 'inf'::DOUBLE ELSE v + 1 END AS cut FROM {name}s
  WHERE v IS NOT NULL AND nl > 0 AND nr > 0 AND least(hl, hr) >= 8
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY gl * gl / (hl + 1) + gr * gr / (hr + 1) - g * g / (h + 1) DESC, f, v, ml) = 1 AND gain > 0)"""


def _tree_sql(depth: int) -> str:
    """A tree with positives of weight 2: t0, t1, ... are the cuts by level, r{depth} the rows in the last nodes, `cuts` and `leaves`."""
    value = "CASE feature " + " ".join(f"WHEN '{c}' THEN {c}" for c in TREE_CUTS) + " END"
    text = [f"""{_parts_sql}, r0 AS (SELECT 0 AS node, *, CASE WHEN y = 1 THEN -1048576 ELSE 524288 END AS g, CASE WHEN y = 1 THEN 524288 ELSE 262144 END AS h FROM lines)"""]
    for i in range(depth):
        text.append(_level_sql(f"t{i}", f"r{i}"))
        text.append(f"""r{i + 1} AS (SELECT CASE WHEN CASE WHEN {value} IS NULL THEN ml ELSE {value} < cut END THEN 2 * r.node + 1 ELSE 2 * r.node + 2 END AS node, {", ".join(f"r.{c}" for c in TREE_CUTS)}, r.g, r.h
  FROM r{i} r JOIN t{i} t ON t.node = r.node)""")
    text.append("cuts AS (" + " UNION ALL ".join(f"SELECT node, feature, cut, ml, gain, h, n FROM t{i}" for i in range(depth)) + ")")
    text.append("leaves AS (" + " UNION ALL ".join(
        f"SELECT node, sum(g)::DOUBLE / 1048576 AS g, sum(h)::DOUBLE / 1048576 AS h, count(*) AS n FROM r{i} " + (f"WHERE node NOT IN (SELECT node FROM t{i}) " if i < depth else "") + "GROUP BY node"
        for i in range(depth + 1)) + ")")
    return ", ".join(text)


def _returned_tree(spark, d):
    """One tree of depth 3 on all line items."""
    return boosting.fit_boosted(
        _returned_lines(spark, d), list(TREE_CUTS), "y", trees=1, depth=3, subsample=1.0, columns=1.0, pos_weight=2.0, cuts=TREE_CUTS
    )


@query("M07 M16", f"""WITH {_tree_sql(3)}
SELECT 0 AS tree, CAST(node AS INT) AS node, feature, cut, ml AS missing_left, gain, h AS cover, n AS n_rows, 0.0::DOUBLE AS weight FROM cuts
UNION ALL SELECT 0, CAST(node AS INT), NULL, NULL, NULL, 0.0, h, n, -g / (h + 1) * 0.05::DOUBLE FROM leaves""")
def boosted_nodes(spark, d):
    """Node table of a second-order tree on features with gaps: cuts, gains, covers, leaf weights."""
    return _returned_tree(spark, d).node_table(spark)


@query("M16 O06", f"""WITH {_tree_sql(3)} SELECT feature, round(avg(gain), 6) AS gain, count(*)::DOUBLE AS weight, round(avg(h), 6) AS cover, round(sum(gain), 6) AS total_gain, round(sum(h), 6) AS total_cover
FROM cuts GROUP BY feature""")
def boosted_importances(spark, d):
    """Gain, splits and cover per feature, from the nodes of a fitted tree."""
    out = boosting.importances(_returned_tree(spark, d).node_table(spark))
    return out.withColumns({c: F.round(c, 6) for c in ("gain", "cover", "total_gain", "total_cover")})


@query("M08 M07 A23 M10 M11 M12", f"""WITH {_parts_sql}, g AS (SELECT l_orderkey, count(*) AS n FROM lines GROUP BY l_orderkey),
o AS (SELECT l_orderkey, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', l_orderkey)), l_orderkey) - 1 AS k FROM g),
x AS (SELECT lines.*, CAST(CASE WHEN (k // 3) % 2 = 0 THEN k % 3 ELSE 2 - k % 3 END AS INT) AS fold FROM lines JOIN o USING (l_orderkey)),
w AS (SELECT a.node, sum(1 - y) / greatest(sum(y), 1) AS w FROM x, (SELECT unnest([0, 1, 2]) AS node) a WHERE x.fold <> a.node GROUP BY a.node),
r AS (SELECT w.node, {", ".join(TREE_CUTS)}, CAST(round(CASE WHEN y = 1 THEN w ELSE 1.0::DOUBLE END * (0.5::DOUBLE - y) * 1048576) AS BIGINT) AS g,
  CAST(round(CASE WHEN y = 1 THEN w ELSE 1.0::DOUBLE END * 0.25::DOUBLE * 1048576) AS BIGINT) AS h FROM x JOIN w ON x.fold <> w.node),
{_level_sql("t", "r")},
s AS (SELECT x.fold, y, CASE WHEN CASE WHEN v0 IS NULL THEN ml ELSE v0 < cut END THEN -gl / (hl + 1) ELSE -gr / (hr + 1) END AS score
  FROM (SELECT x.*, t.*, CASE feature {" ".join(f"WHEN '{c}' THEN {c}" for c in TREE_CUTS)} END AS v0 FROM x JOIN t ON t.node = x.fold) x),
{_ap_sql.format(keys="fold, ", part="fold")},
m AS (SELECT fold, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 9) AS roc_auc, round(sum(pos * (tp / (tp + fp))) / max(p), 9) AS average_precision FROM cu GROUP BY fold),
q AS (SELECT fold, count(*) FILTER (WHERE score < 0 AND y = 0) AS tn, count(*) FILTER (WHERE score >= 0 AND y = 0) AS fp, count(*) FILTER (WHERE score < 0 AND y = 1) AS fn,
  count(*) FILTER (WHERE score >= 0 AND y = 1) AS tp FROM s GROUP BY fold)
SELECT fold, roc_auc, average_precision, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1, round(tn / nullif(tn + fp, 0), 9) AS specificity, round(tp / nullif(tp + fn, 0), 9) AS sensitivity FROM m JOIN q USING (fold)""")
def boosted_cross_validated(spark, d):
    """One cut per fold, fitted and weighted by the fold's training orders alone; all metrics on its validation orders."""
    from gapline.session import shared_folder
    from gapline.sources.writers import materialize

    work = shared_folder(spark)
    learner = models.boosted_learner("y", [], trees=1, depth=1, subsample=1.0, columns=1.0, cuts=TREE_CUTS)
    _, _, metrics = models.cross_validate(
        _returned_lines(spark, d), list(TREE_CUTS), "y", ["l_orderkey"], 3, learner=learner,
        store=lambda made, name: materialize(spark, f"{work}/{name}", lambda: made, force=True),
    )
    return metrics.withColumns({c: r9(c) for c in ("roc_auc", "average_precision", "precision", "recall", "f1", "specificity", "sensitivity")})


@query("M08 M04 A23 M10 M11", f"""WITH {_vectors_sql},
g AS (SELECT grp, count(*) AS n FROM v GROUP BY grp),
r AS (SELECT grp, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', grp)), grp) - 1 AS k FROM g),
s AS (SELECT CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INT) AS fold, y, {_linear_sql} AS score FROM v JOIN r USING (grp)),
c AS (SELECT fold, count(*) AS n_validation, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY fold),
t AS (SELECT count(*) AS total, sum(y) AS tp, sum(1 - y) AS tn FROM s),
{_ap_sql.format(keys="fold, ", part="fold")},
m AS (SELECT fold, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 9) AS roc_auc, round(sum(pos * (tp / (tp + fp))) / max(p), 9) AS average_precision FROM cu GROUP BY fold)
SELECT c.fold, CAST(total - n_validation AS BIGINT) AS n_train, n_validation, (tn - n) / greatest(tp - p, 1) AS pos_weight, roc_auc, average_precision FROM c, t JOIN m USING (fold)""".replace("FROM c, t JOIN m USING (fold)", "FROM c JOIN m USING (fold), t"))
def fold_plumbing(spark, d):
    """Fold members, sizes, weights and areas of a cross-validation, with a fixed score in the place of a fit."""
    rows, names = _vectors(spark, d)
    rows, add = _whole_weights(rows, names)
    report = models.fold_report(add(matrix.group_folds(rows, ["group"], 5)), "y")
    return report.withColumns({"roc_auc": r9("roc_auc"), "average_precision": r9("average_precision")})


@query("M07 A23 M10", f"""WITH {_vectors_sql} SELECT count(*) AS n, count(*) FILTER (WHERE planted = 0) / greatest(count(*) FILTER (WHERE planted = 1), 1) AS pos_weight,
  TRUE AS scores_are_probabilities, TRUE AS signal_found FROM v""")
def trees_planted_signal(spark, d):
    """A fit on all features finds the one that decides the label."""
    rows, names = _vectors(spark, d)
    weighted = models.weight_rows(rows, "planted")
    model = models.fit_trees(weighted, names, "planted", trees=5, depth=3, step=0.3)
    scored = models.score(model, weighted, names)
    area = one_row(evaluate.ranking_metrics(scored, "planted", "score"))["roc_auc"]
    return scored.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("planted") == 1, F.col("_w"))).alias("pos_weight"),
        F.min(F.col("score").between(0, 1)).alias("scores_are_probabilities"),
    ).withColumn("signal_found", area > 0.95)


@query("M07 M16 O06", "SELECT 'f03' AS feature, 1.0::DOUBLE AS importance UNION ALL SELECT 'f00', 0.0 UNION ALL SELECT 'f01', 0.0")
def trees_importance(spark, d):
    """One cut explains a planted label: its feature has all the importance, the others follow by name."""
    rows, names = _vectors(spark, d)
    model = models.fit_trees(models.weight_rows(rows, "planted"), names, "planted", trees=1, depth=1, step=0.3, subsample=1.0)
    return evaluate.top_features(models.importance_table(model, names, spark), 3)


_newton = ["n0 AS (SELECT 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"]
for _i in range(12):
    _newton.append(f"""g{_i} AS (SELECT b0, b1, b2, sum(p - y) AS g0, sum((p - y) * x1) + b1 AS g1, sum((p - y) * x2) + b2 AS g2,
  sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x1) AS h01, sum(p * (1 - p) * x2) AS h02, sum(p * (1 - p) * x1 * x1) + 1 AS h11,
  sum(p * (1 - p) * x1 * x2) AS h12, sum(p * (1 - p) * x2 * x2) + 1 AS h22
  FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM xy, n{_i}) GROUP BY b0, b1, b2)""")
    _newton.append(f"""n{_i + 1} AS (SELECT b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS b0,
  b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b1,
  b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS b2
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM g{_i}))""")


@query("M09 A22 J20", f"""WITH st AS (SELECT c_custkey AS id, c_acctbal / 10000 AS x1 FROM customer),
sq AS (SELECT o_custkey AS id, round(avg(o_totalprice / 500000), 9) AS x2 FROM orders GROUP BY o_custkey),
l AS (SELECT user_id AS id, CAST(max(value) > 150 AS INT) AS y FROM events GROUP BY user_id),
xy AS (SELECT id, x1, x2, y FROM st JOIN sq USING (id) JOIN l USING (id)),
{", ".join(_newton)}
SELECT id AS mother_id, x1 AS static_score, x2 AS sequence_score, y AS y_doc, round(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 3) AS fused_score FROM xy, n12""")
def score_fusion(spark, d):
    """Logistic regression on the static score and the mean sequence score."""
    rows = score_alignment(spark, d).withColumnRenamed("id", "mother_id").withColumnRenamed("y", "y_doc")
    fused = plan.fuse(
        rows.select("mother_id", "static_score"), rows.select("mother_id", "sequence_score"),
        rows.select("mother_id", "y_doc"),
    )
    return fused.withColumn("fused_score", F.round("fused_score", 3))


@query("M17", f"""WITH {_vectors_sql},
q AS (SELECT vec_id, y, {_linear_sql} AS base, [floor(x::DOUBLE * 1000) for x in embedding] AS f FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', vec_id)), vec_id) AS rk, count(*) OVER () AS n FROM q),
t AS (SELECT i, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, turn FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(2)) AS turn)),
o AS (SELECT t.*, ('0x' || substr(md5(concat_ws('|', '42', feature, turn)), 1, 12))::BIGINT AS drawn FROM t),
x AS (SELECT o.feature, o.turn, r.y, r.base, r.f[o.i + 1] AS own, o.i, (r.rk - 1 + drawn % greatest(r.n - 1, 1) + 1) % r.n + 1 AS src FROM r, o),
s AS (SELECT x.feature, x.turn, x.y, x.base + (r.f[x.i + 1] - x.own) * (x.i % 7 - 3) AS score FROM x JOIN r ON r.rk = x.src
  UNION ALL SELECT '', 0, y, base FROM q),
{_ap_sql.format(keys="feature, turn, ", part="feature, turn")},
m AS (SELECT feature, turn, sum(pos * (tp / (tp + fp))) / max(p) AS ap FROM cu GROUP BY feature, turn),
z AS (SELECT ap AS whole FROM m WHERE feature = '')
SELECT feature, round(avg(whole - ap), 9) AS importance_mean, round(stddev_pop(whole - ap), 9) AS importance_std FROM m, z WHERE feature <> '' GROUP BY feature""")
def permutation_importance(spark, d):
    """Loss in average precision of a fixed linear score after moving each feature, all features and turns in one plan."""
    rows, names = _vectors(spark, d)
    rows, add = _whole_weights(rows, names)
    out = models.permutation_importance(add, rows, names, "y", ["vec_id"], repeats=2)
    return out.select("feature", r9("importance_mean").alias("importance_mean"), r9("importance_std").alias("importance_std"))


@query("M17 O06")
def permutation_of_trees(spark, d):
    """The same for a fitted model, on the features that its own importances put first (checked by tests)."""
    rows, names = _vectors(spark, d)
    model = models.fit_trees(models.weight_rows(rows, "y"), names, "y", trees=3, depth=2, step=0.3)
    return models.permutation_importance(model, rows, names, "y", ["vec_id"], repeats=2, tested=models.most_important(model, names, 8))


@query("M05 M04", f"""WITH {_flawed_sql}, g AS (SELECT l_orderkey, count(*) AS n FROM f GROUP BY l_orderkey),
r AS (SELECT l_orderkey, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', l_orderkey)), l_orderkey) - 1 AS k FROM g),
x AS (SELECT f.*, CAST(CASE WHEN (k // 3) % 2 = 0 THEN k % 3 ELSE 2 - k % 3 END AS INT) AS fold FROM f JOIN r USING (l_orderkey)),
m AS (SELECT o.fold, median(price) AS mp, median(quantity) AS mq FROM x, (SELECT unnest([0, 1, 2]) AS fold) o WHERE x.fold <> o.fold GROUP BY o.fold),
s AS (SELECT m.fold, avg(coalesce(price, mp)) AS ap, stddev_pop(coalesce(price, mp)) AS sp, avg(coalesce(quantity, mq)) AS aq, stddev_pop(coalesce(quantity, mq)) AS sq
  FROM x JOIN m ON x.fold <> m.fold GROUP BY m.fold)
SELECT l_orderkey, l_linenumber, x.fold, round((coalesce(price, mp) - ap) / sp, 5) AS price, round((coalesce(quantity, mq) - aq) / sq, 5) AS quantity,
  CAST(price IS NULL AS INT)::DOUBLE AS price_missing, CAST(quantity IS NULL AS INT)::DOUBLE AS quantity_missing
FROM x JOIN m ON m.fold = x.fold JOIN s ON s.fold = x.fold""")
def fold_imputation(spark, d):
    """Each fold's validation rows, filled and scaled by what its training rows alone have shown."""
    from gapline.session import shared_folder
    from gapline.sources.writers import materialize

    names = ["price", "quantity"]
    folded = matrix.group_folds(_flawed(spark, d).select("l_orderkey", "l_linenumber", *names), ["l_orderkey"], 3)
    # both scans of the fit and the result read the folds
    rows = materialize(spark, f"{shared_folder(spark)}/folds", lambda: folded, force=True)
    scalers = matrix.fit_scalers(rows, names, "fold")
    out = matrix.apply_fold_scalers(matrix.add_missing_mask(rows, names), scalers, names)
    return out.withColumns({c: F.round(c, 5) for c in names} | {f"{c}_missing": F.col(f"{c}_missing").cast("double") for c in names})


# ------------------------------------------------------------------ whole flows
@query("M01 M05 M06 M07 M08 M10 M11 M12 W14 W17 L03 O02 A17 J13")
def features_to_folds(spark, d):
    """Timeline and doses to snapshots, static columns, matrix and grouped folds; metrics per fold."""
    from gapline.config import SnapshotSettings
    from gapline.plans import snapshots as snapshot_plan
    from gapline.session import shared_folder
    from gapline.sources.writers import materialize
    from gapline.suite.snapshots import DERIVED, ORDER, RANGES, static_baselines

    settings = SnapshotSettings(
        step_us=day_us, fine_us=3 * day_us, coarse_us=6 * day_us, label_window_us=20 * hour_us, episode_gap_us=4 * day_us,
        min_vital_frequency=0.1, sample_per_class=5000, signals=tuple(ORDER),
    )
    work = shared_folder(spark)
    timeline = materialize(spark, f"{work}/timeline", lambda: add_index(wide_timeline(spark, d), settings.episode_gap_us))
    shots = events(spark, d).filter("event_type = 'purchase' AND value > 60").select(
        F.col("user_id").cast("string").alias(ENTITY), F.col("ts").alias("dose_time"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_time_abs"),
    )
    shots = shots.join(timeline.select(ENTITY, "event_time_abs", "episode_idx"), [ENTITY, "event_time_abs"])
    kept = snapshot_plan.select_episodes(timeline, shots, settings)
    static = static_baselines(spark, d)
    features, marks = snapshot_plan.snapshot_features(kept, shots, static, settings, RANGES, DERIVED, work=work)
    features = snapshot_plan.with_static(features, static)
    built, used = plan.build_matrix(features, marks, drop_constant=True, work=work)
    small = TrainingSettings(trees=3, depth=2, step=0.3)
    report = plan.train_folds(built, used, ["hashed_mother_id", "episode_idx", "snapshot_time"], small, work)
    return report.metrics

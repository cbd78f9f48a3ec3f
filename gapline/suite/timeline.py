"""Timeline queries: episodes, births, reshaping and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.functions.clock import day_us, from_micros, hour_us, micros, minute_us
from gapline.functions.scalar import signed_hms
from gapline.operators import episodes as ep
from gapline.operators import nearest, reshape
from gapline.session import shared_folder
from gapline.suite.registry import query, table

KEY = ["user_id"]
EPISODE = ["user_id", "episode_idx"]
TYPES = ["click", "error", "purchase", "signup", "view"]

EPISODES_SQL = """
ev AS (
  SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS is_new
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
ep AS (
  SELECT *, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS episode_idx FROM ev),
bounds AS (
  SELECT user_id, episode_idx, min(ts) AS ep_start, max(ts) AS ep_end FROM ep GROUP BY user_id, episode_idx)
"""


def events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


def event_bounds(spark, d):
    return ep.gap_episode_bounds(events(spark, d), KEY, "ts", day_us)


def anchors(spark, d):
    """Purchases play the births."""
    return events(spark, d).filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("birth_datetime"))


@query("W01 J02", f"WITH {EPISODES_SQL} SELECT event_id, user_id, ts, episode_idx FROM ep")
def gap_episodes(spark, d):
    return ep.gap_episodes(events(spark, d), KEY, "ts", day_us).select("event_id", "user_id", "ts", "episode_idx")


@query("W01 W07", """
WITH ev AS (
  SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE
    THEN 1 ELSE 0 END AS is_new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, user_id, CAST(sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS INT) AS cluster_idx FROM ev
""")
def short_gap_clusters(spark, d):
    """Short gaps take the two-level path (cells, then blocks of cells)."""
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", 30 * minute_us, out="cluster_idx")
    return rows.select("event_id", "user_id", "cluster_idx")


@query("A10", f"WITH {EPISODES_SQL} SELECT user_id, episode_idx, ep_start, ep_end FROM bounds")
def episode_bounds(spark, d):
    return event_bounds(spark, d)


@query("A11", "SELECT user_id, min(ts) AS anchor FROM events GROUP BY user_id")
def first_event(spark, d):
    return ep.first_event(events(spark, d), KEY, "ts")


@query("W04", f"""WITH {EPISODES_SQL}
SELECT user_id, episode_idx, ep_start,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ep_start) AS INT) AS pregnancy_index FROM bounds""")
def episode_pregnancy_index(spark, d):
    return ep.pregnancy_index(event_bounds(spark, d), KEY).drop("ep_end")


@query("W05", """
SELECT o_orderkey, o_custkey, o_orderdate,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pregnancy_index FROM orders""")
def birth_index(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ep.birth_index(orders, ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query("W06", """
SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE length(o_orderpriority) END NULLS LAST,
           month(o_orderdate), o_orderkey) AS pregnancy_index FROM orders""")
def static_row_index(spark, d):
    orders = table(spark, d, "orders")
    rows = orders.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderstatus") != "P", F.length("o_orderpriority")).alias("a"), F.month("o_orderdate").alias("b"),
    )
    return ep.static_index(rows, ["o_custkey"], ["a", "b"], "o_orderkey").drop("a", "b")


@query("W03", """
WITH o AS (
  SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN lag(o_orderdate) OVER w IS NULL
    OR (o_orderdate <> lag(o_orderdate) OVER w AND o_orderdate - lag(o_orderdate) OVER w >= INTERVAL 183 DAY)
    THEN 1 ELSE 0 END AS is_new
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, o_custkey,
  CAST(sum(is_new) OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS BIGINT) AS episode_idx FROM o""")
def delivery_episodes(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ep.delivery_episodes(orders, ["o_custkey"], "o_orderdate").drop("o_orderdate")


BIRTH_SQL = f"""{EPISODES_SQL},
births AS (SELECT user_id, ts AS b FROM events WHERE event_type = 'purchase'),
ranked AS (
  SELECT x.user_id, x.episode_idx, x.ep_start, x.ep_end, b.b, row_number() OVER (
    PARTITION BY x.user_id, x.episode_idx
    ORDER BY CASE WHEN b.b BETWEEN x.ep_start AND x.ep_end THEN 0 ELSE 1 END,
      abs(epoch_us(b.b) - epoch_us(x.ep_start)), b.b DESC) AS rn
  FROM bounds x LEFT JOIN births b ON b.user_id = x.user_id),
matched AS (SELECT user_id, episode_idx, ep_start, ep_end, b AS birth_datetime FROM ranked WHERE rn = 1)
"""


@query("J03", f"WITH {BIRTH_SQL} SELECT * FROM matched")
def nearest_anchor(spark, d):
    """Episode to birth: the first one inside, else the nearest."""
    return ep.match_births(event_bounds(spark, d), anchors(spark, d), KEY)


@query("J02 J04 P27 P28", f"""WITH {BIRTH_SQL},
t AS (SELECT e.event_id, e.user_id, e.ts, e.episode_idx, m.birth_datetime,
  (epoch_us(e.ts) - epoch_us(m.birth_datetime)) / 1e6 AS s
  FROM ep e LEFT JOIN matched m ON m.user_id = e.user_id AND m.episode_idx = e.episode_idx),
p AS (SELECT *, floor(abs(s) / 3600) AS h, floor((abs(s) - 3600 * floor(abs(s) / 3600)) / 60) AS m FROM t)
SELECT event_id, user_id, episode_idx, birth_datetime, s AS t_from_birth_sec,
  CASE WHEN s < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%04.1f', CAST(h AS INT), CAST(m AS INT),
    round_even(abs(s) - 3600 * h - 60 * m, 1)) AS t_from_birth_str FROM p""")
def birth_aligned_timeline(spark, d):
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us)
    bounds = ep.match_births(event_bounds(spark, d), anchors(spark, d), KEY)
    out = ep.attach_birth(rows, bounds, KEY, "ts")
    return out.select(
        "event_id", "user_id", "episode_idx", "birth_datetime",
        "t_from_birth_sec", "t_from_birth_str",
    )


@query("P29", f"""WITH {BIRTH_SQL}
SELECT e.event_id FROM ep e JOIN matched m ON m.user_id = e.user_id AND m.episode_idx = e.episode_idx
WHERE epoch_us(e.ts) - epoch_us(m.birth_datetime) BETWEEN -24 * 3600000000 AND 48 * 3600000000""")
def prune_around_birth(spark, d):
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us)
    bounds = ep.match_births(event_bounds(spark, d), anchors(spark, d), KEY)
    return ep.prune_around_birth(ep.attach_birth(rows, bounds, KEY, "ts"), 24, 48).select("event_id")


@query("P28 A19", f"""WITH {EPISODES_SQL}
SELECT e.event_id, b.ep_start AS episode_start,
  (epoch_us(e.ts) - epoch_us(b.ep_start)) / 6e7 AS mins_postpartum
FROM ep e JOIN bounds b ON b.user_id = e.user_id AND b.episode_idx = e.episode_idx""")
def mins_from_start(spark, d):
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us)
    out = ep.minutes_from_start(rows, EPISODE, "ts")
    return out.select("event_id", "episode_start", "mins_postpartum")


@query("J05", f"""WITH {EPISODES_SQL},
probe AS (SELECT event_id, user_id, ts + INTERVAL 13 HOUR AS at FROM events)
SELECT p.event_id, p.user_id, p.at, b.episode_idx FROM probe p
LEFT JOIN bounds b ON b.user_id = p.user_id AND p.at BETWEEN b.ep_start AND b.ep_end""")
def interval_containment(spark, d):
    """Shifted event times against the closed episode intervals."""
    probe = events(spark, d).select("event_id", "user_id", (F.col("ts") + F.expr("INTERVAL 13 HOUR")).alias("at"))
    return ep.contain_in_episode(probe, event_bounds(spark, d), KEY, "at", ["episode_idx"])


@query("J06", """
WITH r AS (
  SELECT user_id, ts, CASE WHEN event_type IN ('click', 'view', 'error') THEN value END AS source,
    CASE WHEN event_type IN ('purchase', 'signup', 'click') THEN value END AS target FROM events),
n AS (
  SELECT *, lag(ts) OVER w AS pt, lead(ts) OVER w AS nt, lag(target) OVER w AS pv, lead(target) OVER w AS nv
  FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
m AS (SELECT user_id, ts, source,
  CASE WHEN pt IS NOT NULL AND (nt IS NULL OR ts - pt <= nt - ts) THEN pv ELSE nv END AS target FROM n)
SELECT * FROM m WHERE target IS NOT NULL""")
def nearest_other_row(spark, d):
    rows = events(spark, d).select(
        "user_id", "ts",
        F.when(F.col("event_type").isin("click", "view", "error"), F.col("value")).alias("source"),
        F.when(F.col("event_type").isin("purchase", "signup", "click"), F.col("value")).alias("target"),
    )
    return nearest.nearest_other_row(rows, KEY, "ts", ["source"], ["target"])


# ------------------------------------------------------------------ reshaping
def hourly(spark, d):
    """Event hour as the time of a cell, so that cells hold several rows."""
    return events(spark, d).withColumn("t", F.date_trunc("day", "ts").cast("timestamp_ntz"))


def _case(fn, extra=""):
    return ", ".join(f"{fn}(value{extra}) FILTER (WHERE event_type = '{t}') AS {t}" for t in TYPES)


@query("A01 W08", f"""WITH e AS (SELECT *, date_trunc('day', ts) AS t FROM events)
SELECT user_id, CAST(t AS TIMESTAMP) AS t, {_case('arg_max', ', event_id')} FROM e GROUP BY user_id, t""")
def pivot_last(spark, d):
    return reshape.pivot_last(hourly(spark, d), ["user_id", "t"], "event_type", "value", "event_id", TYPES)


@query("A02", f"""WITH e AS (SELECT *, date_trunc('day', ts) AS t FROM events)
SELECT user_id, CAST(t AS TIMESTAMP) AS t, {_case('arg_min', ', event_id')} FROM e GROUP BY user_id, t""")
def pivot_first(spark, d):
    return reshape.pivot_first(hourly(spark, d), ["user_id", "t"], "event_type", "value", "event_id", TYPES)


@query("A01 A02 A03", """WITH e AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t FROM events)
SELECT user_id, t, event_type AS name, arg_max(value, event_id) AS last_value, arg_min(value, event_id) AS first_value, 1 AS flag
FROM e GROUP BY user_id, t, event_type""")
def pivot_map(spark, d):
    """Pivots over undeclared names: one map per row, no name reaches the driver."""
    rows, keys = hourly(spark, d), ["user_id", "t"]
    last = reshape.pivot_last(rows, keys, "event_type", "value", "event_id").select(*keys, F.explode("cells").alias("name", "last_value"))
    first = reshape.pivot_first(rows, keys, "event_type", "value", "event_id").select(*keys, F.explode("cells").alias("name", "first_value"))
    flags = reshape.pivot_flags(rows, keys, "event_type").select(*keys, F.explode("cells").alias("name", "flag"))
    return last.join(first, [*keys, "name"]).join(flags, [*keys, "name"])


@query("M02 M04 W01 W05", """WITH e AS (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS owner, ts FROM events),
g AS (SELECT owner, count(*) AS n FROM e GROUP BY owner),
r AS (SELECT owner, row_number() OVER (ORDER BY n DESC, md5(concat_ws('|', '42', owner)), owner NULLS FIRST) - 1 AS k,
  row_number() OVER (ORDER BY md5(concat_ws('|', '42', owner)), owner NULLS FIRST) AS h, count(*) OVER () AS groups FROM g),
b AS (SELECT event_id, row_number() OVER (PARTITION BY owner ORDER BY ts, event_id) AS nth FROM e WHERE owner IS NOT NULL)
SELECT e.event_id, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INT) AS fold,
  CAST(h <= greatest(1, ceil(groups * 0.2)) AS INT) AS is_validation, b.nth
FROM e JOIN r ON e.owner IS NOT DISTINCT FROM r.owner LEFT JOIN b USING (event_id)""")
def null_entities(spark, d):
    """Splits keep rows of a null entity as one group; per-entity numbers leave them out."""
    from gapline.operators import matrix

    rows = events(spark, d).select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("owner"), "ts")
    split = matrix.group_holdout(matrix.group_folds(rows, ["owner"]), ["owner"])
    numbered = ep.birth_index(rows, ["owner"], "ts", ["event_id"], out="nth").select("event_id", "nth")
    return split.select("event_id", "fold", "is_validation").join(numbered, "event_id", "left")


@query("A03", """SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t,
  CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INT) AS error,
  CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS purchase
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id, date_trunc('day', ts)""")
def pivot_flags(spark, d):
    return reshape.pivot_flags(hourly(spark, d), ["user_id", "t"], "event_type", ["error", "purchase"])


@query("J01 U01", """
WITH e AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t FROM events),
v AS (SELECT user_id, t, arg_max(value, event_id) FILTER (WHERE event_type = 'view') AS "view",
  arg_max(value, event_id) FILTER (WHERE event_type = 'click') AS click
  FROM e WHERE event_type IN ('view', 'click') GROUP BY user_id, t),
l AS (SELECT user_id, t, arg_max(value, event_id) AS signup FROM e WHERE event_type = 'signup' GROUP BY user_id, t),
g AS (SELECT user_id, t, CAST(max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS INT) AS error,
  CAST(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS INT) AS purchase
  FROM e WHERE event_type IN ('error', 'purchase') GROUP BY user_id, t)
SELECT * FROM v FULL JOIN l USING (user_id, t) FULL JOIN g USING (user_id, t)""")
def outer_merge(spark, d):
    rows = hourly(spark, d)
    keys = ["user_id", "t"]
    return reshape.outer_merge(
        [
            reshape.pivot_last(rows, keys, "event_type", "value", "event_id", ["view", "click"]),
            reshape.pivot_last(rows, keys, "event_type", "value", "event_id", ["signup"]),
            reshape.pivot_flags(rows, keys, "event_type", ["error", "purchase"]),
        ],
        keys,
    )


@query("A04 P07", """
WITH w AS (SELECT o_orderkey, o_custkey,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS blood_dose_1,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.250'
       WHEN o_orderstatus = 'O' THEN 'n/a' ELSE ' ' END AS "Blood_Product_1" FROM orders),
u AS (SELECT o_custkey, blood_dose_1 AS t FROM w UNION ALL SELECT o_custkey, "Blood_Product_1" FROM w)
SELECT DISTINCT o_custkey, CAST(t AS TIMESTAMP) AS dose_time FROM u
WHERE regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}(\\.\\d{1,9})?')""")
def unpivot_times(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    wide = table(spark, d, "orders").select(
        "o_custkey", text.alias("blood_dose_1"),
        F.when(F.col("o_orderstatus") == "F", F.concat(text, F.lit(".250")))
        .when(F.col("o_orderstatus") == "O", "n/a").otherwise(" ").alias("Blood_Product_1"),
    )
    return reshape.melt_times(wide, ["o_custkey"])


@query("W07 W10 A12", """
WITH r AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN value END AS a,
  CASE WHEN event_type IN ('click', 'signup') THEN value END AS b,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM events),
k AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 3 HOUR THEN 1 ELSE 0 END AS is_new
  FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts) AS cl FROM k)
SELECT user_id, min(ts) AS ts, arg_max(a, ts) AS a, arg_max(b, ts) AS b, CAST(max(flag) AS INT) AS flag,
  min(event_id) AS event_id FROM c GROUP BY user_id, cl""")
def collapse_near_dups(spark, d):
    kind = F.col("event_type")
    rows = events(spark, d).select(
        "user_id", "ts", "event_id", F.when(kind == "view", F.col("value")).alias("a"),
        F.when(kind.isin("click", "signup"), F.col("value")).alias("b"), (kind == "error").cast("int").alias("flag"),
    )
    return reshape.collapse_near_duplicates(
        rows, KEY, "ts", last=["a", "b"], largest=["flag"], first=["event_id"], seq="event_id", gap_us=3 * hour_us
    )


@query("W08", """SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def keep_last(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "event_type", "ts")
    return reshape.keep_last(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("W09", """SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def keep_first(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "event_type", "ts")
    return reshape.keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"])


@query("P31", """
SELECT * FROM (VALUES ('discount_flag', 'drug'), ('empty', 'lab'), ('l_quantity', 'vital'), ('l_tax', 'lab')) t(name, kind)""")
def classify_columns(spark, d):
    """Names of a wide table by kind; a column of 0 and 1 is a drug."""
    wide = table(spark, d, "lineitem").select(
        "l_orderkey", "l_quantity", "l_tax", (F.col("l_discount") > 0.05).cast("int").alias("discount_flag"),
        F.lit(None).cast("double").alias("empty"),
    )
    vitals, labs, drugs = reshape.classify_columns(wide, ["l_orderkey"], ["l_quantity"])
    kinds = {**{c: "vital" for c in vitals}, **{c: "lab" for c in labs}, **{c: "drug" for c in drugs}}
    return spark.createDataFrame(sorted(kinds.items()), "name string, kind string")


@query("A25", """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return reshape.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("J09 S12", """SELECT e.event_id, e.user_id FROM events e
SEMI JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') k ON k.c_custkey = e.user_id""")
def keep_list(spark, d):
    kept = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return reshape.semi_join(events(spark, d).select("event_id", "user_id"), kept, KEY)


@query("U02 U03", """SELECT DISTINCT user_id, kind FROM (
  SELECT user_id, 'pos' AS kind FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT user_id, 'neg' FROM events WHERE event_type = 'error')""")
def union_distinct(spark, d):
    rows = events(spark, d)
    pos = rows.filter("event_type = 'purchase'").select("user_id", F.lit("pos").alias("kind"))
    neg = rows.filter("event_type = 'error'").select("user_id", F.lit("neg").alias("kind"))
    return reshape.union_all([pos, neg]).distinct()


@query("P27", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice - 50000 AS x FROM lineitem),
p AS (SELECT *, CAST(floor(abs(x) / 3600) AS INT) AS h FROM s),
q AS (SELECT *, CAST(floor((abs(x) - 3600 * h) / 60) AS INT) AS m FROM p)
SELECT DISTINCT round(x, 2) AS seconds, CASE WHEN x < 0 THEN '-' ELSE '' END
  || printf('%02d:%02d:%04.1f', h, m, round_even(abs(x) - 3600 * h - 60 * m, 1)) AS shown FROM q""")
def signed_hms_text(spark, d):
    x = F.col("l_extendedprice") - 50000
    return table(spark, d, "lineitem").select(F.round(x, 2).alias("seconds"), signed_hms(x).alias("shown")).distinct()


# ------------------------------------------------------------------ the timeline flow
def raw_tables(spark, d):
    """Events as measurement, lab and drug files with their text formats; purchases are births too."""
    rows = events(spark, d)
    entity = F.col("user_id").cast("string").alias("hashed_mother_id")
    text = F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")
    kind = F.col("event_type")
    measurements = rows.filter(kind.isin("view", "click")).select(
        entity, "event_id", text.alias("parameter_time"),
        F.when(kind == "view", "לחץ סיסטולי").otherwise("pulse").alias("Parameter_Name"),
        F.col("value").cast("string").alias("ResultNumeric"), F.when(F.col("value") > 200, 1).alias("flag"),
    )
    labs = rows.filter(kind == "signup").select(
        entity, "event_id", text.alias("ResultTime"), F.lit("hgb (blood)").alias("TestName"), F.col("value").cast("string").alias("Result")
    )
    drugs = rows.filter(kind == "error").select(
        entity, text.alias("ExecutionTime"), F.when(F.col("value") > 30, "Oxytocin 10u").otherwise("Aspirin").alias("DrugName")
    )
    children = rows.filter(kind == "purchase").select(
        entity, F.when(F.col("value") > 20, text).alias("birth_time"), text.alias("child_birth_date")
    )
    return measurements, labs, drugs, children


@query("J01 W01 A10 J03 P05 P11 P12 P14 P26 P28 P31 W07 A12 A01 A03", """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS id, ts,
  CASE WHEN event_type = 'view' THEN value END AS sistol, CASE WHEN event_type = 'click' THEN value END AS pulse,
  CASE WHEN event_type = 'signup' THEN value END AS "HGB_BLOOD", CASE WHEN event_type = 'error' THEN 1 END AS "OXYTOCIN"
  FROM events WHERE (event_type IN ('view', 'click') AND value <= 200) OR event_type = 'signup' OR (event_type = 'error' AND value > 30)),
n AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new_ep,
  CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new_cl
  FROM r WINDOW w AS (PARTITION BY id ORDER BY ts)),
e AS (SELECT *, CAST(sum(new_ep) OVER w AS INT) AS episode_idx, sum(new_cl) OVER w AS cl FROM n WINDOW w AS (PARTITION BY id ORDER BY ts)),
b AS (SELECT id, episode_idx, min(ts) AS s, max(ts) AS f FROM e GROUP BY id, episode_idx),
births AS (SELECT CAST(user_id AS VARCHAR) AS id, ts AS b FROM events WHERE event_type = 'purchase'),
m AS (SELECT b.id, b.episode_idx, births.b AS birth, row_number() OVER (PARTITION BY b.id, b.episode_idx
  ORDER BY CASE WHEN births.b BETWEEN b.s AND b.f THEN 0 ELSE 1 END, abs(epoch_us(births.b) - epoch_us(b.s)), births.b DESC) AS rn
  FROM b LEFT JOIN births ON births.id = b.id),
c AS (SELECT e.id, cl, min(ts) AS ts, arg_min(m.birth, ts) AS birth, min(e.episode_idx) AS episode_idx, arg_max(sistol, ts) AS sistol,
  arg_max(pulse, ts) AS pulse, arg_max("HGB_BLOOD", ts) AS hgb, max("OXYTOCIN") AS oxy
  FROM e LEFT JOIN m ON m.id = e.id AND m.episode_idx = e.episode_idx AND m.rn = 1 GROUP BY e.id, cl)
SELECT id AS hashed_mother_id, ts AS event_time_abs, birth AS birth_datetime, (epoch_us(ts) - epoch_us(birth)) / 1e6 AS t_from_birth_sec,
  episode_idx, sistol, pulse, hgb AS "HGB_BLOOD", oxy AS "OXYTOCIN" FROM c""")
def timeline_build(spark, d):
    """Raw text tables to the collapsed, episode- and birth-aligned timeline."""
    from gapline.plans import timeline as flow

    measurements, labs, drugs, children = raw_tables(spark, d)
    built = flow.build_timeline(
        flow.vitals_wide(measurements, "event_id"), flow.labs_wide(labs, "event_id", ["HGB_BLOOD"]), flow.drugs_wide(drugs),
        flow.births(children), day_us, hour_us, work=shared_folder(spark),
    )
    return built.rows.select(
        "hashed_mother_id", "event_time_abs", "birth_datetime", "t_from_birth_sec", "episode_idx", "sistol", "pulse",
        "HGB_BLOOD", "OXYTOCIN",
    )


@query("O01", "SELECT event_id, user_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS position FROM events")
def sorted_timeline(spark, d):
    return reshape.sorted_positions(events(spark, d), KEY, "ts", "event_id").select("event_id", "user_id", "position")

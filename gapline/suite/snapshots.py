"""Snapshot queries: grids, window statistics, look-back features, sequences and snapshot labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapline.config import ENTITY, PostpartumSettings, SequenceSettings, SnapshotSettings
from gapline.functions.clock import day_us, hour_us
from gapline.operators import episodes as ep
from gapline.operators import grids, labels, nearest, postpartum, reshape, statics
from gapline.plans import postpartum as postpartum_plan
from gapline.plans import snapshots as snapshot_plan
from gapline.session import shared_folder
from gapline.suite.registry import query, table
from gapline.suite.timeline import EPISODE, EPISODES_SQL, KEY, TYPES, events, hourly

STEP = 6 * hour_us
GRID_SQL = f"""{EPISODES_SQL},
g AS (
  SELECT user_id, episode_idx, ep_start, i, ep_start + i * INTERVAL 6 HOUR AS snap FROM (
    SELECT user_id, episode_idx, ep_start,
      unnest(range((epoch_us(ep_end) - epoch_us(ep_start)) // 21600000000 + 1)) AS i FROM bounds))
"""


def r6(col):
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def spans(spark, d):
    rows = ep.episode_rows_with_bounds(events(spark, d), KEY, "ts", day_us)
    return rows.select(*EPISODE, "ep_start_us", "ep_end_us").distinct()


def samples(spark, d):
    rows = ep.episode_rows_with_bounds(events(spark, d), KEY, "ts", day_us)
    rows = rows.withColumnRenamed("event_type", "signal")
    return grids.offsets(rows, "ts", "ep_start_us", "ep_end_us", STEP)


@query("W11", f"WITH {GRID_SQL} SELECT user_id, episode_idx, i, snap AS snapshot_time FROM g")
def snapshot_grid(spark, d):
    grid = grids.closed_grid(spans(spark, d), EPISODE, "ep_start_us", "ep_end_us", STEP)
    return grid.select(*EPISODE, "i", grids.from_micros("snapshot_us").alias("snapshot_time"))


@query("W12", f"""WITH {EPISODES_SQL}
SELECT user_id, episode_idx, i, ep_start + i * INTERVAL 45 MINUTE AS snapshot_time FROM (
  SELECT *, unnest(range((least(epoch_us(ep_end) - epoch_us(ep_start), 43200000000) + 2699999999) // 2700000000)) AS i
  FROM bounds)""")
def open_snapshot_grid(spark, d):
    step = 45 * 60_000_000
    rows = spans(spark, d).withColumn("end_us", F.least("ep_end_us", F.col("ep_start_us") + 12 * hour_us))
    grid = grids.open_grid(rows, EPISODE, "ep_start_us", "end_us", step)
    return grid.select(*EPISODE, "i", grids.from_micros("snapshot_us").alias("snapshot_time"))


def window_sql(scope: str, width: str, source: str = "ep", grid: str = "g", keys=("user_id", "episode_idx"),
               signal: str = "event_type", ts: str = "ts", origin: str = "ep_start", least: int = 3) -> str:
    """The rule itself: join every grid point with the samples of its window, then aggregate."""
    k = ", ".join(f"g.{c}" for c in keys)
    on = " AND ".join(f"e.{c} = g.{c}" for c in keys)
    v = "CAST(CAST(e.value AS FLOAT) AS DOUBLE)"
    x = f"(epoch_us(e.{ts}) - epoch_us(g.{origin})) / 1e6"

    def gate(expr):
        return f"CASE WHEN count(*) >= {least} THEN {expr} END"

    return f"""SELECT {k}, e.{signal} AS signal, g.i, count(*) AS {scope}_n,
  arg_max({v}, e.{ts}) AS {scope}_last, min({v}) AS {scope}_min, max({v}) AS {scope}_max,
  {gate(f'avg({v})')} AS {scope}_mean, {gate(f'stddev_pop({v})')} AS {scope}_std,
  {gate(f'quantile_cont({v}, 0.5)')} AS {scope}_median, {gate(f'regr_slope({v}, {x})')} AS {scope}_slope_linfit,
  {gate(f'arg_max({v}, e.{ts}) - arg_min({v}, e.{ts})')} AS {scope}_delta,
  {gate(f'(epoch_us(max(e.{ts})) - epoch_us(min(e.{ts}))) / 1e6')} AS {scope}_delta_t
FROM {grid} g JOIN {source} e ON {on} AND e.{ts} > g.snap - {width} AND e.{ts} <= g.snap
WHERE e.value IS NOT NULL GROUP BY {k}, e.{signal}, g.i"""


STATS = ("last", "min", "max", "mean", "std", "median", "slope_linfit", "delta", "delta_t")


def stat_list(scope: str, prefix: str, with_last: bool = True) -> str:
    out = []
    for s in STATS:
        if s == "last" and not with_last:
            continue
        x = f"{prefix}.{scope}_{s}" + (" * 86400" if s == "slope_linfit" else "")
        out.append(f"round({x}, 6) AS {scope}_{s}")
    return ", ".join(out)


@query("W13 W14", f"""WITH {GRID_SQL}, fine AS ({window_sql('fine', 'INTERVAL 1 DAY')}),
coarse AS ({window_sql('coarse', 'INTERVAL 4 DAY')})
SELECT c.user_id, c.episode_idx, c.signal, c.i, coalesce(f.fine_n, 0) AS fine_n, c.coarse_n,
  {stat_list('fine', 'f')}, {stat_list('coarse', 'c', False)}
FROM coarse c LEFT JOIN fine f
  ON f.user_id = c.user_id AND f.episode_idx = c.episode_idx AND f.signal = c.signal AND f.i = c.i""")
def window_stats(spark, d):
    """Look-back statistics of every signal on a 6 h grid, over one and four days (slopes per day)."""
    out = grids.grid_windows(samples(spark, d), EPISODE, STEP, {"fine": 4, "coarse": 16})
    cols = []
    for scope in ("fine", "coarse"):
        for s in STATS:
            if not (scope == "coarse" and s == "last"):
                x = F.col(f"{scope}_{s}") * 86400 if s == "slope_linfit" else F.col(f"{scope}_{s}")
                cols.append(r6(x).alias(f"{scope}_{s}"))
    return out.select(*EPISODE, "signal", "i", "fine_n", "coarse_n", *cols)


@query("W13", f"""WITH {GRID_SQL}, w AS ({window_sql('fine', 'INTERVAL 1 DAY')})
SELECT user_id, episode_idx, signal, i, fine_median FROM w WHERE fine_median IS NOT NULL""")
def window_medians(spark, d):
    return grids.window_medians(samples(spark, d), EPISODE, STEP, {"fine": 4})


@query("J16 W16", f"""WITH {GRID_SQL},
l AS (SELECT g.user_id, g.episode_idx, g.i,
  arg_max(CAST(CAST(e.value AS FLOAT) AS DOUBLE), e.ts) FILTER (WHERE e.event_type = 'purchase') AS last_purchase,
  arg_max(CAST(CAST(e.value AS FLOAT) AS DOUBLE), e.ts) FILTER (WHERE e.event_type = 'view') AS last_view
  FROM g JOIN ep e ON e.user_id = g.user_id AND e.episode_idx = g.episode_idx AND e.ts <= g.snap
  WHERE e.event_type IN ('purchase', 'view') GROUP BY g.user_id, g.episode_idx, g.i)
SELECT *, CASE WHEN last_view <> 0 THEN last_purchase / last_view END AS ratio FROM l""")
def locf_grid(spark, d):
    """Newest value of two signals at every grid point, and their ratio."""
    rows = samples(spark, d).filter(F.col("signal").isin("purchase", "view"))
    last = grids.grid_last(rows, EPISODE, STEP)
    wide = last.groupBy(*EPISODE, "i").agg(
        *[F.max(F.when(F.col("signal") == s, F.col("last_value"))).alias(f"last_{s}") for s in ("purchase", "view")]
    )
    ratio = F.when(F.col("last_view") != 0, F.try_divide("last_purchase", "last_view"))
    return wide.withColumn("ratio", ratio)


# ------------------------------------------------------------------ labels of snapshots
DOSE_SQL = f"""{GRID_SQL},
d AS (SELECT user_id, episode_idx, ts AS d FROM ep WHERE event_type = 'purchase' AND value > 60)
"""


def doses(spark, d):
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us)
    return rows.filter("event_type = 'purchase' AND value > 60").select(*EPISODE, F.col("ts").alias("dose_time"))


@query("L03 J08", f"""WITH {DOSE_SQL},
f AS (SELECT user_id, episode_idx, min(d) AS first_d FROM d GROUP BY user_id, episode_idx),
h AS (SELECT d.user_id, d.episode_idx, d.d, max(g.i) AS i, max(g.snap) AS snap
  FROM d JOIN g ON g.user_id = d.user_id AND g.episode_idx = d.episode_idx AND g.snap <= d.d
  GROUP BY d.user_id, d.episode_idx, d.d),
hit AS (SELECT user_id, episode_idx, i, max(d) AS d FROM h
  WHERE d > snap AND d - snap <= INTERVAL 3 HOUR GROUP BY user_id, episode_idx, i)
SELECT g.user_id, g.episode_idx, g.snap AS snapshot_time, CAST(CASE WHEN hit.d IS NULL THEN 0 ELSE 1 END AS INT) AS label,
  hit.d AS trigger_dose_time
FROM g LEFT JOIN f ON f.user_id = g.user_id AND f.episode_idx = g.episode_idx
LEFT JOIN hit ON hit.user_id = g.user_id AND hit.episode_idx = g.episode_idx AND hit.i = g.i
WHERE f.first_d IS NULL OR g.snap < f.first_d OR hit.d IS NOT NULL""")
def label_pre_dose(spark, d):
    own = spans(spark, d).withColumnsRenamed({"ep_start_us": "start_us", "ep_end_us": "end_us"})
    grid = grids.closed_grid(own, EPISODE, "start_us", "end_us", STEP)
    out = labels.label_last_before_event(grid, own, doses(spark, d), EPISODE, STEP, window_us=3 * hour_us)
    return out.select(*EPISODE, grids.from_micros("snapshot_us").alias("snapshot_time"), "label", "trigger_dose_time")


@query("L04 J07 P41", f"""WITH {DOSE_SQL},
n AS (SELECT g.user_id, g.episode_idx, g.snap, max(d.d) AS d FROM g LEFT JOIN d
  ON d.user_id = g.user_id AND d.episode_idx = g.episode_idx AND d.d <= g.snap GROUP BY g.user_id, g.episode_idx, g.snap)
SELECT user_id, episode_idx, concat(user_id, '|', episode_idx) AS by_key, snap AS snapshot_time,
  CAST(CASE WHEN snap - d <= INTERVAL 8 HOUR THEN 1 ELSE 0 END AS INT) AS label,
  CASE WHEN snap - d <= INTERVAL 8 HOUR THEN d END AS trigger_dose_time FROM n""")
def label_post_dose(spark, d):
    from gapline.functions.scalar import composite_key

    grid = grids.closed_grid(spans(spark, d), EPISODE, "ep_start_us", "ep_end_us", STEP)
    snaps = grid.select(*EPISODE, grids.from_micros("snapshot_us").alias("snapshot_time"))
    out = labels.label_after_event(snaps, doses(spark, d), EPISODE, window_us=8 * hour_us)
    return out.withColumn("by_key", composite_key(*EPISODE))


@query("A05", f"""WITH {EPISODES_SQL}
SELECT user_id, episode_idx AS episode_idx, ts AS dose_time FROM ep WHERE event_type = 'purchase' AND value > 60""")
def dose_times_fallback(spark, d):
    """An empty wide dose table falls back to aligned labels above 0."""
    rows = ep.gap_episodes(events(spark, d), KEY, "ts", day_us, out="pregnancy_index")
    aligned = rows.select(
        "user_id", "pregnancy_index", F.col("ts").alias("event_time_abs"),
        F.expr("CAST(event_type = 'purchase' AND value > 60 AS INT)").alias("label"),
    )
    blank = rows.select("user_id", "pregnancy_index", F.lit(" ").alias("blood_dose_1"))
    return labels.dose_times(blank, aligned, "user_id")


# ------------------------------------------------------------------ snapshot features of a wide timeline
SIGNALS = {"view": "sistol", "click": "diastol", "purchase": "pulse", "error": "HGB", "signup": "heat"}
RANGES = {"sistol": (1, 250), "diastol": (1, 150), "pulse": (2, 220), "HGB": (0, 200)}
DERIVED = {"MAP": (5, 170), "SI": (0.05, 20), "PP": (-100, 150)}
ORDER = ["sistol", "diastol", "pulse", "HGB", "heat"]


def wide_timeline(spark, d):
    """Days as event times, so that rows hold several signals."""
    wide = reshape.pivot_last(hourly(spark, d), ["user_id", "t"], "event_type", "value", "event_id", TYPES)
    wide = reshape.rename(wide, {**SIGNALS, "t": "event_time_abs"})
    return wide.select(F.col("user_id").cast("string").alias(ENTITY), "event_time_abs", *ORDER)


def static_baselines(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias(ENTITY),
        (F.col("c_acctbal") / 50).alias("systolic_pressure_24h_last_before_birth"),
        (F.col("c_acctbal") / 100).alias("diastolic_pressure_24h_last_before_birth"),
        (F.col("c_nationkey") * 3.0).alias("heart_rate_24h_last_before_birth"),
        (F.col("c_nationkey") / 2.0).alias("HGB"),
        F.length("c_mktsegment").alias("segment_length"),
    )


def _masked(name: str, expr: str, bounds) -> str:
    if name not in bounds:
        return expr
    low, high = bounds[name]
    return f"CASE WHEN {expr} BETWEEN {low} AND {high} THEN {expr} END"


_types = {v: k for k, v in SIGNALS.items()}
_wide_cols = ", ".join(
    f"arg_max(value, event_id) FILTER (WHERE event_type = '{_types[s]}') AS {s}_raw" for s in ORDER)
TIMELINE_SQL = f"""
e0 AS (SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS t FROM events),
raw AS (SELECT CAST(user_id AS VARCHAR) AS id, t, {_wide_cols} FROM e0 GROUP BY user_id, t),
m AS (SELECT id, t, {", ".join(f"{_masked(s, f'{s}_raw', {s: RANGES[s]} if s in RANGES else {})} AS {s}" for s in ORDER)} FROM raw),
m2 AS (SELECT *, diastol + (sistol - diastol) / 3 AS map_, CASE WHEN sistol <> 0 THEN pulse / sistol END AS si_,
  sistol - diastol AS pp_,
  CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > INTERVAL 2 DAY THEN 1 ELSE 0 END AS is_new
  FROM m WINDOW w AS (PARTITION BY id ORDER BY t)),
tl AS (SELECT id, t, {", ".join(ORDER)}, {_masked("MAP", "map_", DERIVED)} AS "MAP", {_masked("SI", "si_", DERIVED)} AS "SI",
  {_masked("PP", "pp_", DERIVED)} AS "PP",
  CAST(sum(is_new) OVER (PARTITION BY id ORDER BY t) AS INT) AS episode_idx FROM m2),
b2 AS (SELECT id, episode_idx, min(t) AS origin, max(t) AS fin FROM tl GROUP BY id, episode_idx),
g AS (SELECT id, episode_idx, origin, i, origin + i * INTERVAL 1 DAY AS snap FROM (
  SELECT *, unnest(range((epoch_us(fin) - epoch_us(origin)) // 86400000000 + 1)) AS i FROM b2)),
ep_long AS ({" UNION ALL ".join(f"SELECT id, episode_idx, t AS ts, '{s}' AS sig, \"{s}\" AS value FROM tl" for s in [*ORDER, "MAP", "SI", "PP"])})
"""
FEATURE_SIGNALS = [*ORDER, "MAP", "SI", "PP"]
_pieces = []
for _s in FEATURE_SIGNALS:
    for _scope, _alias in (("fine", "f"), ("coarse", "c")):
        for _st in STATS:
            if _scope == "coarse" and _st == "last":
                continue
            _x = f"{_alias}.{_scope}_{_st}" + (" * 86400" if _st == "slope_linfit" else "")
            _pieces.append(f"round(max(CASE WHEN {_alias}.signal = '{_s}' THEN {_x} END), 6) AS \"{_s}_{_scope}_{_st}\"")
_kw = dict(source="ep_long", keys=("id", "episode_idx"), signal="sig", origin="origin")


@query("W14 W15 W16 P16 P17 P02 A01", f"""WITH {TIMELINE_SQL}, fine AS ({window_sql('fine', 'INTERVAL 3 DAY', **_kw)}),
coarse AS ({window_sql('coarse', 'INTERVAL 6 DAY', **_kw)}),
wide AS (SELECT g.id AS hashed_mother_id, g.episode_idx, g.snap AS snapshot_time, {", ".join(_pieces)}
FROM g LEFT JOIN coarse c ON c.id = g.id AND c.episode_idx = g.episode_idx AND c.i = g.i
LEFT JOIN fine f ON f.id = g.id AND f.episode_idx = g.episode_idx AND f.i = g.i AND f.signal = c.signal
GROUP BY g.id, g.episode_idx, g.snap),
si AS (SELECT g.id, g.episode_idx, g.snap, arg_max(CAST(CAST(pulse AS FLOAT) AS DOUBLE), t) FILTER (WHERE pulse IS NOT NULL) AS p,
  arg_max(CAST(CAST(sistol AS FLOAT) AS DOUBLE), t) FILTER (WHERE sistol IS NOT NULL) AS s
  FROM g JOIN tl ON tl.id = g.id AND tl.episode_idx = g.episode_idx AND tl.t <= g.snap GROUP BY g.id, g.episode_idx, g.snap)
SELECT w.*, w.episode_idx AS pregnancy_index, round(CASE WHEN s <> 0 THEN p / s END, 6) AS shock_index_fine_last
FROM wide w JOIN si ON si.id = w.hashed_mother_id AND si.episode_idx = w.episode_idx AND si.snap = w.snapshot_time""")
def snapshot_features(spark, d):
    """The snapshot flow on a wide timeline: masks, derived signals, both windows, newest-value ratio."""
    settings = SnapshotSettings(
        step_us=day_us, fine_us=3 * day_us, coarse_us=6 * day_us, episode_gap_us=2 * day_us, signals=tuple(ORDER)
    )
    timeline = snapshot_plan.add_index(wide_timeline(spark, d), settings.episode_gap_us)
    out, _ = snapshot_plan.snapshot_features(timeline, settings=settings, plausible=RANGES, derived=DERIVED, work=shared_folder(spark))
    rounded = []
    for c in out.columns:
        if "_fine_" in c or "_coarse_" in c:
            x = F.col(c) * 86400 if c.endswith("slope_linfit") else F.col(c)
            rounded.append(r6(x).alias(c))
        else:
            rounded.append(F.col(c))
    return out.select(*rounded)


@query("W17 J15 L03 J17 A05", f"""WITH {TIMELINE_SQL}, fine AS ({window_sql('fine', 'INTERVAL 3 DAY', **_kw)}),
d AS (SELECT CAST(user_id AS VARCHAR) AS id, ts AS d FROM events WHERE event_type = 'purchase' AND value > 150),
dd AS (SELECT b.id, b.episode_idx, d.d FROM d JOIN b2 b ON b.id = d.id AND d.d >= b.origin AND d.d < b.fin + INTERVAL 1 DAY),
first_d AS (SELECT id, episode_idx, min(d) AS d FROM dd GROUP BY id, episode_idx),
h AS (SELECT dd.id, dd.episode_idx, dd.d, max(g.snap) AS snap FROM dd JOIN g
  ON g.id = dd.id AND g.episode_idx = dd.episode_idx AND g.snap <= dd.d GROUP BY dd.id, dd.episode_idx, dd.d),
hit AS (SELECT id, episode_idx, snap, max(d) AS d FROM h WHERE d > snap AND d - snap <= INTERVAL 16 HOUR GROUP BY id, episode_idx, snap),
kept AS (SELECT g.* FROM g LEFT JOIN first_d f ON f.id = g.id AND f.episode_idx = g.episode_idx
  LEFT JOIN hit ON hit.id = g.id AND hit.episode_idx = g.episode_idx AND hit.snap = g.snap
  WHERE f.d IS NULL OR g.snap < f.d OR hit.d IS NOT NULL),
base AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal / 50 AS s, c_acctbal / 100 AS di, c_nationkey * 3.0 AS p,
  c_nationkey / 2.0 AS hgb FROM customer),
bl AS (SELECT id, 'sistol' AS sig, s AS b FROM base UNION ALL SELECT id, 'diastol', di FROM base
  UNION ALL SELECT id, 'pulse', p FROM base UNION ALL SELECT id, 'HGB', hgb FROM base
  UNION ALL SELECT id, 'MAP', di + (s - di) / 3 FROM base UNION ALL SELECT id, 'PP', s - di FROM base
  UNION ALL SELECT id, 'SI', CASE WHEN s <> 0 THEN p / s END FROM base)
SELECT k.id AS hashed_mother_id, k.episode_idx, k.snap AS snapshot_time,
  {", ".join(f'''round(max(CASE WHEN f.signal = '{s}' THEN f.fine_last - bl.b END), 6) AS "{s}_fine_abs_from_prebirth_last",
  round(max(CASE WHEN f.signal = '{s}' AND bl.b <> 0 THEN (f.fine_last - bl.b) / bl.b END), 6) AS "{s}_fine_pct_from_prebirth_last"''' for s in FEATURE_SIGNALS)}
FROM kept k LEFT JOIN fine f ON f.id = k.id AND f.episode_idx = k.episode_idx AND f.i = k.i
LEFT JOIN bl ON bl.id = k.id AND bl.sig = f.signal GROUP BY k.id, k.episode_idx, k.snap""")
def personalized_deltas(spark, d):
    """Distances to static baselines on the snapshots that keep a label."""
    settings = SnapshotSettings(
        step_us=day_us, fine_us=3 * day_us, coarse_us=6 * day_us, label_window_us=16 * hour_us,
        episode_gap_us=2 * day_us, signals=tuple(ORDER),
    )
    timeline = snapshot_plan.add_index(wide_timeline(spark, d), settings.episode_gap_us)
    shots = events(spark, d).filter("event_type = 'purchase' AND value > 150")
    shots = shots.select(F.col("user_id").cast("string").alias(ENTITY), F.col("ts").alias("dose_time"),
                         F.date_trunc("day", "ts").cast("timestamp_ntz").alias("event_time_abs"))
    shots = shots.join(timeline.select(ENTITY, "event_time_abs", "episode_idx"), [ENTITY, "event_time_abs"])
    out, _ = snapshot_plan.snapshot_features(
        timeline, shots, static_baselines(spark, d), settings, RANGES, DERIVED, work=shared_folder(spark), deltas_only=True)
    wanted = [c for c in out.columns if "_from_prebirth_last" in c]
    return out.select(ENTITY, "episode_idx", "snapshot_time", *[r6(c).alias(c) for c in wanted])


# ------------------------------------------------------------------ after delivery
AFTER_SQL = """
dl AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'purchase' GROUP BY user_id),
pp AS (SELECT e.user_id, e.ts, e.event_type, e.value, d.t0 FROM events e JOIN dl d ON d.user_id = e.user_id AND e.ts >= d.t0),
b AS (SELECT user_id, t0, least(max(ts), t0 + INTERVAL 10 DAY) AS fin FROM pp GROUP BY user_id, t0),
g AS (SELECT user_id, t0, i, t0 + i * INTERVAL 6 HOUR AS snap FROM (
  SELECT *, unnest(range((epoch_us(fin) - epoch_us(t0) + 21599999999) // 21600000000)) AS i FROM b)),
base AS (SELECT user_id, event_type, coalesce(avg(value) FILTER (WHERE ts <= t0 + INTERVAL 1 DAY), arg_min(value, ts)) AS baseline
  FROM pp GROUP BY user_id, event_type)
"""
LONGEST = 10 * day_us


def after(spark, d):
    """Events from the user's first purchase on, which plays the delivery."""
    rows = events(spark, d)
    first = rows.filter("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("delivery_time"))
    return postpartum.after_delivery(rows.join(first, "user_id"))


def after_samples(spark, d):
    rows = after(spark, d).withColumnRenamed("event_type", "signal")
    own = postpartum.delivery_spans(rows, KEY, "ts", "delivery_time", LONGEST)
    return postpartum.delivery_offsets(rows, own, KEY, "ts", STEP)


@query("P30", f"WITH {AFTER_SQL} SELECT user_id, ts, event_type FROM pp")
def after_delivery(spark, d):
    return after(spark, d).select("user_id", "ts", "event_type")


@query("A20", f"WITH {AFTER_SQL} SELECT user_id, event_type AS signal, round(baseline, 6) AS baseline FROM base")
def baseline_means(spark, d):
    out = grids.baseline(after_samples(spark, d), KEY, day_us)
    return out.withColumn("baseline", r6("baseline"))


LOOKBACK_SQL = f"""{AFTER_SQL},
hist AS (SELECT g.user_id, g.i, g.snap, e.event_type, arg_max(e.value, e.ts) AS last_abs, max(e.ts) AS last_ts
  FROM g JOIN pp e ON e.user_id = g.user_id AND e.ts <= g.snap GROUP BY g.user_id, g.i, g.snap, e.event_type),
win AS (SELECT g.user_id, g.i, e.event_type, avg(e.value) AS mean_abs, stddev_pop(e.value) AS std_abs,
  min(e.value) AS min_abs, max(e.value) AS max_abs, arg_min(e.value, e.ts) AS oldest, min(e.ts) AS oldest_ts
  FROM g JOIN pp e ON e.user_id = g.user_id AND e.ts <= g.snap AND e.ts >= g.snap - INTERVAL 2 DAY
  GROUP BY g.user_id, g.i, e.event_type),
look AS (SELECT h.user_id, h.i, h.snap, h.event_type AS signal, 1 AS measured, h.last_abs, w.mean_abs, w.std_abs, w.min_abs, w.max_abs,
  CASE WHEN h.snap > w.oldest_ts THEN (h.last_abs - w.oldest) / ((epoch_us(h.snap) - epoch_us(w.oldest_ts)) / 1e6) END AS slope_abs,
  least((epoch_us(h.snap) - epoch_us(h.last_ts)) / 1e6, 43200.0) AS recency_s, b.baseline,
  h.last_abs - b.baseline AS delta_last, CASE WHEN b.baseline <> 0 THEN (h.last_abs - b.baseline) / b.baseline * 100 END AS pct_last,
  w.mean_abs - b.baseline AS delta_mean
  FROM hist h LEFT JOIN win w ON w.user_id = h.user_id AND w.i = h.i AND w.event_type = h.event_type
  LEFT JOIN base b ON b.user_id = h.user_id AND b.event_type = h.event_type)
"""
_look = [s for s in postpartum.VITAL_STATS if s != "measured"]


def _scaled(s: str) -> str:
    return f"{s} * 86400" if s == "slope_abs" else s


@query("W18", f"""WITH {LOOKBACK_SQL} SELECT user_id, i, signal, CAST(measured AS INT) AS measured,
  {", ".join(f"round({_scaled(s)}, 6) AS {s}" for s in _look)} FROM look""")
def lookback_features(spark, d):
    """Closed two-day look-back on a 6 h grid after delivery (slopes per day)."""
    out = postpartum.vital_features(after_samples(spark, d), KEY, STEP, 2 * day_us, day_us, 12 * 3600.0)
    cols = [r6(F.col(s) * 86400 if s == "slope_abs" else F.col(s)).alias(s) for s in _look]
    return out.select("user_id", "i", "signal", "measured", *cols)


@query("W19 P51", f"""WITH {LOOKBACK_SQL} SELECT user_id, i, signal, CAST(1 AS INT) AS measured, last_abs AS last,
  recency_s, round(baseline, 6) AS baseline, round(delta_last, 6) AS delta_last FROM look""")
def lab_recency(spark, d):
    out = postpartum.lab_features(after_samples(spark, d), KEY, STEP, day_us, 12 * 3600.0)
    return out.withColumns({"baseline": r6("baseline"), "delta_last": r6("delta_last")})


@query("W20 P51", f"""WITH {AFTER_SQL},
n AS (SELECT g.user_id, g.i, g.snap, max(e.ts) AS t FROM g LEFT JOIN pp e
  ON e.user_id = g.user_id AND e.event_type = 'error' AND e.value > 50 AND e.ts <= g.snap GROUP BY g.user_id, g.i, g.snap)
SELECT user_id, i, CAST(CASE WHEN t IS NULL THEN 0 ELSE 1 END AS INT) AS given,
  CASE WHEN t IS NULL THEN 1e9 ELSE least((epoch_us(snap) - epoch_us(t)) / 6e7, 4320.0) END AS minutes FROM n""")
def intervention_recency(spark, d):
    """Minutes since the newest large error event, capped at three days; never given shows as 1e9."""
    rows = after(spark, d).withColumnRenamed("event_type", "signal")
    own = postpartum.delivery_spans(rows, KEY, "ts", "delivery_time", LONGEST)
    given = postpartum.delivery_offsets(rows.filter("signal = 'error' AND value > 50"), own, KEY, "ts", STEP)
    out = postpartum.intervention_features(given, KEY, STEP, 4320.0).drop("signal")
    grid = grids.open_grid(own, KEY, "start_us", "end_us", STEP).select("user_id", "i")
    joined = grid.join(out, ["user_id", "i"], "left")
    return joined.select(
        "user_id", "i", F.coalesce("given", F.lit(0)).alias("given"),
        F.coalesce("minutes", F.lit(1e9)).alias("minutes"),
    )


def _post_sql() -> str:
    cols = []
    for v, t in (("sbp", "view"), ("hr", "click")):
        for s in postpartum.VITAL_STATS:
            if s == "baseline":
                x = f"(SELECT baseline FROM base WHERE base.user_id = g.user_id AND base.event_type = '{t}')"
                cols.append(f"round(any_value({x}), 6) AS {v}_baseline")
                continue
            x = f"max(CASE WHEN l.signal = '{t}' THEN {_scaled('l.' + s) if s == 'slope_abs' else 'l.' + s} END)"
            if s == "slope_abs":
                x = f"max(CASE WHEN l.signal = '{t}' THEN l.slope_abs * 86400 END)"
            if s == "measured":
                cols.append(f"CAST(coalesce({x}, 0) AS INT) AS {v}_measured")
            elif s == "recency_s":
                cols.append(f"coalesce({x}, 43200.0) AS {v}_recency_s")
            else:
                cols.append(f"round({x}, 6) AS {v}_{s}")
    t = "signup"
    cols += [
        f"CAST(coalesce(max(CASE WHEN l.signal = '{t}' THEN 1 END), 0) AS INT) AS hgb_measured",
        f"max(CASE WHEN l.signal = '{t}' THEN l.last_abs END) AS hgb_last",
        f"coalesce(max(CASE WHEN l.signal = '{t}' THEN least((epoch_us(l.snap) - epoch_us(h.last_ts)) / 1e6, 604800.0) END), 604800.0) AS hgb_recency_s",
        f"round(any_value((SELECT baseline FROM base WHERE base.user_id = g.user_id AND base.event_type = '{t}')), 6) AS hgb_baseline",
        f"round(max(CASE WHEN l.signal = '{t}' THEN l.delta_last END), 6) AS hgb_delta_last",
    ]
    return ", ".join(cols)


@query("W18 W19 W20 W21 P01 P02 P20 P30", f"""WITH {LOOKBACK_SQL},
n AS (SELECT g.user_id, g.i, max(e.ts) AS t FROM g LEFT JOIN pp e
  ON e.user_id = g.user_id AND e.event_type = 'error' AND e.value > 0 AND e.ts <= g.snap GROUP BY g.user_id, g.i)
SELECT g.user_id AS mother_id, g.snap AS snapshot_time, {_post_sql()},
  CAST(any_value(CASE WHEN n.t IS NULL THEN 0 ELSE 1 END) AS INT) AS oxytocin_given,
  any_value(CASE WHEN n.t IS NULL THEN 1e9 ELSE least((epoch_us(g.snap) - epoch_us(n.t)) / 6e7, 10080.0) END) AS time_since_oxytocin_min,
  any_value(c.c_nationkey) AS nation
FROM g LEFT JOIN look l ON l.user_id = g.user_id AND l.i = g.i
LEFT JOIN hist h ON h.user_id = g.user_id AND h.i = g.i AND h.event_type = l.signal
LEFT JOIN n ON n.user_id = g.user_id AND n.i = g.i
LEFT JOIN customer c ON c.c_custkey = g.user_id
GROUP BY g.user_id, g.snap""")
def postpartum_features(spark, d):
    """The postpartum flow: two vitals, one lab, one drug and a static column per snapshot."""
    kind = F.col("event_type")
    rows = after(spark, d).select(
        F.col("user_id").alias("mother_id"), F.col("ts").alias("event_time_abs"),
        F.col("delivery_time").alias("birth_datetime"),
        F.when(kind == "view", F.col("value")).alias("sistol"), F.when(kind == "click", F.col("value")).alias("pulse"),
        F.when(kind == "signup", F.col("value")).alias("HGB"),
        F.when(kind == "error", F.col("value")).otherwise(0.0).alias("OXYTOCIN"),
    )
    settings = PostpartumSettings(
        step_us=STEP, lookback_us=2 * day_us, baseline_us=day_us, longest_us=LONGEST, vitals=("sbp", "hr"),
        labs=("HGB",), drugs=("OXYTOCIN",),
    )
    rows = postpartum_plan.standardize(rows, {"sistol": "sbp", "pulse": "hr"}, settings.labs, settings.drugs)
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("mother_id"), F.col("c_nationkey").alias("nation"))
    out = postpartum_plan.postpartum_features(rows, static, settings)
    cols = []
    for c, t in out.dtypes:
        x = F.col(c)
        if t == "double":
            x = F.when(x == float("inf"), 1e9).otherwise(x * 86400 if c.endswith("slope_abs") else x)
            if not (c.endswith("recency_s") or c.startswith("time_since_")):
                x = F.round(x, 6)
        cols.append(x.alias(c))
    return out.select(*cols)


@query("W22 O07 U01", f"""WITH {AFTER_SQL},
last AS (SELECT g.user_id, g.i, {", ".join(f"arg_max(CAST(e.value AS FLOAT), e.ts) FILTER (WHERE e.event_type = '{t}') AS v{k}" for k, t in enumerate(("view", "click")))}
  FROM g LEFT JOIN pp e ON e.user_id = g.user_id AND e.ts <= g.snap GROUP BY g.user_id, g.i),
bw AS (SELECT user_id, {", ".join(f"max(CASE WHEN event_type = '{t}' THEN baseline END) AS b{k}" for k, t in enumerate(("view", "click")))} FROM base GROUP BY user_id),
ids AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS episode_idx FROM dl)
SELECT l.user_id AS mother_id, ids.episode_idx, CAST(least(count(*) OVER (PARTITION BY l.user_id), 20) AS INT) AS t_used, CAST(l.i AS INT) AS i,
  CAST(v0 AS DOUBLE) AS c0, CAST(v1 AS DOUBLE) AS c1,
  round(CAST(v0 - CAST(b0 AS FLOAT) AS DOUBLE), 3) AS c2, round(CAST(v1 - CAST(b1 AS FLOAT) AS DOUBLE), 3) AS c3
FROM last l JOIN bw ON bw.user_id = l.user_id JOIN ids ON ids.user_id = l.user_id QUALIFY l.i < 20""")
def sequence_export(spark, d):
    """Channel sequences of at most 20 steps, shown one step per row."""
    kind = F.col("event_type")
    rows = after(spark, d).select(
        F.col("user_id").alias("mother_id"), "ts", "delivery_time",
        F.when(kind == "view", F.col("value")).alias("sbp"), F.when(kind == "click", F.col("value")).alias("hr"),
    )
    settings = SequenceSettings(step_us=STEP, baseline_us=day_us, longest_us=LONGEST, cap=20, channels=("sbp", "hr"))
    out = postpartum_plan.episode_sequences(rows, settings)
    steps = out.select("mother_id", "episode_idx", F.col("T_used").alias("t_used"), F.posexplode("x").alias("i", "x"))
    cells = [F.get("x", F.lit(k)).cast("double") for k in range(4)]
    return steps.select(
        "mother_id", "episode_idx", "t_used", "i", cells[0].alias("c0"), cells[1].alias("c1"),
        F.round(cells[2], 3).alias("c2"), F.round(cells[3], 3).alias("c3"),
    )

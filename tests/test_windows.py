import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.config import PostpartumSettings
from gapline.functions.clock import hour_us, minute_us, second_us
from gapline.operators import grids, labels, postpartum
from gapline.plans import postpartum as plan
from tests.helpers import at, times, us, window_reference

H = 3600.0


def sample_table(spark, rows, last_point):
    """rows: (key, signal, seconds, value)"""
    data = [(k, s, round(t * 1e6), float(v), last_point[k]) for k, s, t, v in rows]
    return spark.createDataFrame(data, "k int, signal string, offset_us long, value double, last_point long")


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7))


@pytest.mark.parametrize("wide_steps", [64, 1])
@pytest.mark.parametrize("closed", [False, True])
def test_windows_match_direct_evaluation(spark, monkeypatch, closed, wide_steps):
    monkeypatch.setattr(grids, "WIDE_STEPS", wide_steps)
    rng = random.Random(11)
    rows, last = [], {}
    for k in range(4):
        last[k] = rng.randint(2, 40)
        for s in ("x", "y"):
            seen = set()
            for _ in range(300 if k == 0 else rng.randint(0, 25)):
                # a third exactly on grid points, so that window edges are hit
                t = float(rng.randint(0, last[k])) * H if rng.random() < 0.33 else round(rng.random() * (last[k] + 1) * H, 3)
                if t not in seen:
                    seen.add(t)
                    rows.append((k, s, t, rng.choice([rng.random() * 100, 36.6, 200_000.0])))
    df = sample_table(spark, rows, last)
    got = {(r.k, r.signal, r.i): r.asDict() for r in grids.grid_windows(df, ["k"], hour_us, {"fine": 3, "coarse": 12}, closed=closed).collect()}
    seen = 0
    for k in last:
        grid = [i * H for i in range(last[k] + 1)]
        for s in ("x", "y"):
            own = [(t, v) for kk, ss, t, v in rows if kk == k and ss == s]
            for scope, width in (("fine", 3 * H), ("coarse", 12 * H)):
                want = window_reference(own, grid, width, 3, closed)
                for i in range(last[k] + 1):
                    row = got.get((k, s, i))
                    if i not in want:
                        assert row is None or row[f"{scope}_n"] == 0
                        continue
                    for stat in ("n", *grids.STATS):
                        assert same(row[f"{scope}_{stat}"], want[i].get(stat)), (k, s, i, scope, stat, row, want[i])
                        seen += 1
    assert seen > 2000


def test_window_edges_and_few_samples(spark):
    df = sample_table(spark, [(1, "x", 0.0, 5.0), (1, "x", 1.0, 7.0), (1, "x", 3 * H, 9.0)], {1: 3})
    got = {r.i: r for r in grids.grid_windows(df, ["k"], hour_us, {"w": 3}).collect()}
    # at g = 3 h the sample at g - 3 h is out, the next second is in
    assert (got[3].w_n, got[3].w_first, got[3].w_last) == (2, 7.0, 9.0)
    assert got[3].w_min == 7.0 and got[3].w_mean is None and got[3].w_median is None and got[3].w_delta is None
    closed = {r.i: r for r in grids.grid_windows(df, ["k"], hour_us, {"w": 3}, closed=True).collect()}
    assert closed[3].w_n == 3 and closed[3].w_mean == 7.0 and closed[3].w_median == 7.0


def test_constant_values_have_no_spread(spark):
    rows = [(1, "x", float(t), 123456.78) for t in range(0, 7200, 60)]
    out = grids.grid_windows(sample_table(spark, rows, {1: 1}), ["k"], hour_us, {"w": 3}).collect()
    assert [(r.w_std, r.w_slope_linfit) for r in out if r.w_n >= 3] == [(0.0, 0.0)]


def test_merged_windows_with_history_and_chosen_points(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, "x", round(rng.random() * 80 * H, 3), rng.random()) for k in range(3) for _ in range(40)]
    df = sample_table(spark, rows, {k: 80 for k in range(3)})
    args = (["k"], hour_us, {"a": 2, "b": 9})
    repeated = {(r.k, r.i): r for r in grids.grid_windows(df, *args, history=True).collect()}
    points = spark.createDataFrame([(k, i) for k in range(3) for i in range(0, 81, 7)], "k int, i long")
    monkeypatch.setattr(grids, "WIDE_STEPS", 1)
    merged = {(r.k, r.i): r for r in grids.grid_windows(df, *args, history=True).collect()}
    assert merged.keys() == repeated.keys()
    for key, row in merged.items():
        assert all(same(a, b) for a, b in zip(row[3:], repeated[key][3:])), (row, repeated[key])
    chosen = {(r.k, r.i): r for r in grids.grid_windows(df, *args, history=True, points=points).collect()}
    assert chosen == {key: row for key, row in merged.items() if key[1] % 7 == 0}


@pytest.mark.parametrize("wide_steps", [64, 1])
def test_slope_far_from_origin(spark, monkeypatch, wide_steps):
    monkeypatch.setattr(grids, "WIDE_STEPS", wide_steps)
    start = 5 * 365 * 24 * H
    rows = [(1, "x", start + 60.0 * t, 100 + 0.25 * t) for t in range(120)]
    out = {r.i: r for r in grids.grid_windows(sample_table(spark, rows, {1: 5 * 365 * 24 + 2}), ["k"], hour_us, {"w": 3}).collect()}
    assert out[5 * 365 * 24 + 2].w_slope_linfit * 60 == pytest.approx(0.25, rel=1e-9)


def test_grids(spark):
    spans = spark.createDataFrame([(1, 0, 2 * hour_us), (2, 0, 0), (3, 5, 5 + hour_us + 1)], "k int, s long, e long")
    closed = [(r.k, r.i) for r in grids.closed_grid(spans, ["k"], "s", "e", hour_us).orderBy("k", "i").collect()]
    assert closed == [(1, 0), (1, 1), (1, 2), (2, 0), (3, 0), (3, 1)]
    opened = [(r.k, r.i) for r in grids.open_grid(spans, ["k"], "s", "e", hour_us).orderBy("k", "i").collect()]
    assert opened == [(1, 0), (1, 1), (3, 0), (3, 1)]


def test_last_value_has_no_age_limit(spark):
    df = sample_table(spark, [(1, "x", 10.0, 5.0), (1, "x", 2 * H, 6.0), (1, "x", 2 * H + 1, 8.0)], {1: 50})
    got = {r.i: (r.last_value, r.last_offset_us) for r in grids.grid_last(df, ["k"], hour_us).collect()}
    assert 0 not in got and got[1] == (5.0, 10 * second_us) and got[2] == (6.0, 2 * hour_us) and got[50] == (8.0, 2 * hour_us + second_us)


def test_baseline_falls_back_to_the_first_value(spark):
    df = sample_table(spark, [(1, "x", 0.0, 4.0), (1, "x", 1800.0, 6.0), (1, "x", 1801.0, 60.0), (1, "y", 7200.0, 3.0), (1, "y", 7300.0, 9.0)], {1: 5})
    got = {r.signal: r.baseline for r in grids.baseline(df, ["k"], 30 * minute_us).collect()}
    assert got == {"x": 5.0, "y": 3.0}


# ------------------------------------------------------------------ labels of snapshots
def pre_dose(grid, doses, window):
    """(kept snapshots, label, trigger) by the rule's own steps."""
    if not doses:
        return [(g, 0, None) for g in grid]
    hit = {}
    for d in sorted(doses):
        before = [g for g in grid if g <= d]
        if before and before[-1] < d and d - before[-1] <= window:
            hit[before[-1]] = d
    return [(g, int(g in hit), hit.get(g)) for g in grid if g < min(doses) or g in hit]


@pytest.mark.parametrize("seed", range(3))
def test_last_snapshot_before_dose(spark, seed):
    rng = random.Random(seed)
    spans, doses, want = [], [], {}
    for k in range(25):
        n, start = rng.randint(0, 8), rng.randint(0, 10**6) * second_us
        spans.append((k, start, start + n * hour_us + rng.randint(0, 3599) * second_us))
        own = []
        for _ in range(rng.randint(0, 4)):
            step = rng.randint(-1, n + 2) * hour_us
            own.append(start + step + rng.choice([0, 1, 1800 * second_us, hour_us - 1]))
        doses += [(k, d) for d in own]
        grid = [start + i * hour_us for i in range((spans[-1][2] - start) // hour_us + 1)]
        want[k] = pre_dose(grid, own, hour_us)
    bounds = spark.createDataFrame(spans, "k int, start_us long, end_us long")
    events = spark.createDataFrame(doses, "k int, d long").select("k", grids.from_micros("d").alias("dose_time"))
    grid = grids.closed_grid(bounds, ["k"], "start_us", "end_us", hour_us)
    got = {}
    for r in labels.label_last_before_event(grid, bounds, events, ["k"], hour_us).orderBy("snapshot_us").collect():
        got.setdefault(r.k, []).append((r.snapshot_us, r.label, us(r.trigger_dose_time) if r.trigger_dose_time else None))
    for k, rows in want.items():
        assert got.get(k, []) == rows


def test_after_dose_window_is_closed(spark):
    snaps = times(spark, [("a", 1, at(t)) for t in (99, 100, 100 + 3 * H, 101 + 3 * H)] + [("b", 1, at(5))], "id string, episode_idx int, snapshot_time timestamp")
    doses = times(spark, [("a", 1, at(100)), ("a", 2, at(99))], "id string, episode_idx int, dose_time timestamp")
    got = {(r.id, r.snapshot_time): (r.label, r.trigger_dose_time) for r in labels.label_after_event(snaps, doses, ["id", "episode_idx"]).collect()}
    assert [got["a", at(t)][0] for t in (99, 100, 100 + 3 * H, 101 + 3 * H)] == [0, 1, 1, 0]
    assert got["a", at(100)][1] == at(100) and got["b", at(5)] == (0, None)
    labels.assert_binary(labels.label_after_event(snaps, doses, ["id", "episode_idx"]))
    with pytest.raises(ValueError):
        labels.assert_binary(spark.createDataFrame([(2,)], "label int"))


# ------------------------------------------------------------------ after delivery
def test_postpartum_flow(spark):
    rows = [("m", at(t), at(0), s, h, o) for t, s, h, o in [
        (0.0, 100.0, None, 0), (600.0, 110.0, 12.0, 0), (900.0, None, None, 1), (3600.0, 130.0, None, 0), (-60.0, 500.0, None, 1), (30 * H, 90.0, None, 0)]]
    df = times(spark, rows, "hashed_mother_id string, event_time_abs timestamp, birth_datetime timestamp, sistol double, HGB double, OXYTOCIN int")
    settings = PostpartumSettings(labs=("HGB", "PLT"), drugs=("OXYTOCIN", "MISOPROSTOL"))
    clean = plan.standardize(df, labs=settings.labs, drugs=settings.drugs)
    assert clean.count() == 5 and {"sbp", "spo2", "MISOPROSTOL", "mother_id"} <= set(clean.columns)
    out = {r.snapshot_time: r for r in plan.postpartum_features(clean, settings=settings).collect()}
    assert len(out) == 24  # six hours at 15 minutes, right end open
    first, quarter, hour = out[at(0)], out[at(900)], out[at(3600)]
    assert first.sbp_last_abs == 100.0 and first.hgb_measured == 0 and first.hgb_recency_s == 7 * 24 * H
    assert first.oxytocin_given == 0 and first.time_since_oxytocin_min == math.inf
    assert quarter.oxytocin_given == 1 and quarter.time_since_oxytocin_min == 0.0 and quarter.hgb_recency_s == 300.0
    assert quarter.misoprostol_given == 0 and quarter.time_since_misoprostol_min == math.inf
    assert hour.sbp_baseline == 105.0 and hour.sbp_delta_last == 25.0 and hour.sbp_mean_abs == pytest.approx(340 / 3)
    assert hour.sbp_slope_abs == pytest.approx(30 / 3600) and hour.sbp_std_abs == pytest.approx(12.472191)
    late = out[at(5 * H)]
    assert late.sbp_mean_abs is None and late.sbp_last_abs == 130.0 and late.sbp_recency_s == 4 * H
    assert late.hr_measured == 0 and late.hr_recency_s == 12 * H and late.hr_last_abs is None and late.hgb_baseline == 12.0


def test_sequence_shape(spark):
    rows = [("m", at(t), at(0), v) for t, v in [(0.0, 10.0), (601.0, 20.0), (4 * H, 30.0), (40 * H, 1.0)]]
    df = times(spark, rows, "mother_id string, ts timestamp, delivery_time timestamp, sbp double")
    from gapline.config import SequenceSettings

    out = plan.episode_sequences(df, SequenceSettings(channels=("sbp",), cap=60)).first()
    assert out.T_used == 60 and len(out.x) == 60 and out.episode_idx == 0
    assert out.x[0] == [10.0, -5.0] and out.x[2] == [10.0, -5.0] and out.x[3] == [20.0, 5.0] and out.x[59] == [30.0, 15.0]


def test_lookback_must_fit_the_step(spark):
    with pytest.raises(ValueError):
        postpartum.vital_features(spark.range(1), ["k"], 7, 100, 1, 1.0)


def test_labels_without_doses_keep_all(spark):
    bounds = spark.createDataFrame([(1, 0, 3 * hour_us)], "k int, start_us long, end_us long")
    grid = grids.closed_grid(bounds, ["k"], "start_us", "end_us", hour_us)
    none = bounds.select("k", F.lit(None).cast("timestamp_ntz").alias("dose_time"))
    out = labels.label_last_before_event(grid, bounds, none, ["k"], hour_us).collect()
    assert len(out) == 4 and all(r.label == 0 and r.trigger_dose_time is None for r in out)


def test_tasks_read_a_bounded_part_of_a_shuffle(spark):
    """Window stages multiply what a task reads: its part is bounded, smaller settings stay."""
    from gapline.session import TASK_MB, configure

    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    try:
        for given, want in (("64m", f"{TASK_MB}m"), ("67108864b", f"{TASK_MB}m"), ("1g", f"{TASK_MB}m"), ("1m", "1m"), ("16k", "16k")):
            spark.conf.set(key, given)
            assert configure(spark).conf.get(key) == want
    finally:
        spark.conf.set(key, old)

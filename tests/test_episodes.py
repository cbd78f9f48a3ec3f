import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gapline.functions.clock import day_us, second_us
from gapline.operators import episodes as ep
from gapline.operators import nearest, reshape
from tests.helpers import at, hot_rows, times

DAY = 86400.0


def clusters(rows, gap, at_equal=False):
    out, last, n = {}, {}, {}
    for k, t in sorted(rows):
        new = k not in last or (t - last[k] >= gap if at_equal else t - last[k] > gap)
        n[k] = n.get(k, 0) + int(new)
        last[k] = t
        out[k, t] = n[k]
    return out


def test_gap_bound(spark):
    rows = [("a", at(0)), ("a", at(183 * DAY)), ("b", at(0)), ("b", at(183 * DAY + 1)), ("c", None)]
    df = times(spark, rows, "id string, ts timestamp")
    got = {(r.id, r.ts): r.episode_idx for r in ep.gap_episodes(df, ["id"], "ts").collect()}
    assert got == {("a", at(0)): 1, ("a", at(183 * DAY)): 1, ("b", at(0)): 1, ("b", at(183 * DAY + 1)): 2}
    bounds = ep.gap_episode_bounds(df, ["id"], "ts").filter("id = 'a'").collect()
    assert [(r.ep_start, r.ep_end) for r in bounds] == [(at(0), at(183 * DAY))]


@pytest.mark.parametrize("gap", [0.4, 3.0])
@pytest.mark.parametrize("at_equal", [False, True])
def test_short_gaps_with_hot_entity(spark, gap, at_equal):
    rows = hot_rows(800, spread=9000.0)
    df = times(spark, [(k, at(t)) for k, t in rows], "id int, ts timestamp")
    got = ep.gap_episodes(df, ["id"], "ts", int(gap * second_us), at_equal).collect()
    want = {(k, at(t)): n for (k, t), n in clusters([(k, round(t, 6)) for k, t in rows], gap, at_equal).items()}
    assert {(r.id, r.ts): r.episode_idx for r in got} == want


def test_delivery_gap_splits_at_equality(spark):
    rows = [("b", 1, at(0)), ("b", 2, at(183 * DAY)), ("a", 3, at(0)), ("a", 4, at(100 * DAY)), ("a", 5, at(283 * DAY - 1)),
            ("c", 6, at(5))]
    df = times(spark, rows, "id string, n int, d timestamp")
    got = {r.n: r.episode_idx for r in ep.delivery_episodes(df, ["id"], "d").collect()}
    assert got == {3: 0, 4: 0, 5: 0, 1: 1, 2: 2, 6: 3}


def nearest_birth(start, end, births):
    inside = [b for b in births if start <= b <= end]
    if inside:
        return min(inside)
    return min(births, key=lambda b: (abs((b - start).total_seconds()), -b.timestamp())) if births else None


def test_birth_match_cases(spark):
    bounds = times(spark, [(k, 1, at(1000), at(2000)) for k in "abcde"], "id string, episode_idx int, ep_start timestamp, ep_end timestamp")
    births = times(spark, [("a", at(1500)), ("a", at(900)), ("a", at(1200)), ("b", at(400)), ("c", at(2600)), ("c", at(9000)),
                           ("d", at(0)), ("d", at(2000.5))], "id string, birth_datetime timestamp")
    got = {r.id: r.birth_datetime for r in ep.match_births(bounds, births, ["id"]).collect()}
    # d: 1000 s before against 1000.5 s after
    assert got == {"a": at(1200), "b": at(400), "c": at(2600), "d": at(0), "e": None}


def test_birth_tie_goes_to_the_later(spark):
    bounds = times(spark, [("a", 1, at(1000), at(1100))], "id string, episode_idx int, ep_start timestamp, ep_end timestamp")
    births = times(spark, [("a", at(500)), ("a", at(1500))], "id string, birth_datetime timestamp")
    assert ep.match_births(bounds, births, ["id"]).first().birth_datetime == at(1500)


def test_birth_match_random(spark):
    rng = random.Random(2)
    eps, births = [], []
    for k in range(12):
        t = 0.0
        for e in range(rng.randint(1, 4)):
            t += rng.randint(1, 4000)
            length = rng.randint(0, 900)
            eps.append((k, e, at(t), at(t + length)))
            t += length
        births += [(k, at(rng.randint(0, 12000))) for _ in range(0 if k == 3 else 60 if k == 0 else rng.randint(1, 4))]
    bounds = times(spark, eps, "id int, episode_idx int, ep_start timestamp, ep_end timestamp")
    own = times(spark, births, "id int, birth_datetime timestamp")
    got = {(r.id, r.episode_idx): r.birth_datetime for r in ep.match_births(bounds, own, ["id"], slice_us=700 * second_us).collect()}
    for k, e, s, f in eps:
        assert got[k, e] == nearest_birth(s, f, [b for i, b in births if i == k])


def test_containment_is_closed(spark):
    bounds = times(spark, [("a", 1, at(10), at(20)), ("a", 2, at(40), at(50))], "id string, episode_idx int, ep_start timestamp, ep_end timestamp")
    probe = times(spark, [("a", at(t)) for t in (9, 10, 20, 21, 40, 50, 51)] + [("z", at(15))], "id string, ts timestamp")
    got = {(r.id, r.ts): r.episode_idx for r in ep.contain_in_episode(probe, bounds, ["id"], "ts", ["episode_idx"], slice_us=7 * second_us).collect()}
    assert [got["a", at(t)] for t in (9, 10, 20, 21, 40, 50, 51)] == [None, 1, 1, None, 2, 2, None]
    assert got["z", at(15)] is None


def test_nearest_other_row(spark):
    rows = [("a", at(0), 1.0, None), ("a", at(10), 2.0, 5.0), ("a", at(20), 3.0, 7.0), ("b", at(0), 1.0, 1.0)]
    df = times(spark, rows, "id string, ts timestamp, s double, t double")
    got = {r.ts: (r.s, r.t) for r in nearest.nearest_other_row(df, ["id"], "ts", ["s"], ["t"]).collect()}
    # the middle row ties and takes the earlier neighbour, which has no target
    assert got == {at(0): (1.0, 5.0), at(20): (3.0, 5.0)}


def test_near_duplicates_chain(spark):
    rows = [("a", at(0.0), 1.0, None, 0), ("a", at(0.5), None, 4.0, 1), ("a", at(1.4), 3.0, None, 0), ("b", at(0.0), 1.0, None, 0),
            ("b", at(1.0), 2.0, None, 0)]
    df = times(spark, rows, "id string, ts timestamp, x double, y double, f int")
    got = sorted(tuple(r) for r in reshape.collapse_near_duplicates(df, ["id"], "ts", ["x", "y"], ["f"]).select("id", "ts", "x", "y", "f").collect())
    assert got == [("a", at(0), 3.0, 4.0, 1), ("b", at(0), 1.0, None, 0), ("b", at(1), 2.0, None, 0)]


def test_prune_sides(spark):
    df = spark.createDataFrame([(-7200.0,), (0.0,), (7200.0,), (None,)], "t_from_birth_sec double")
    assert ep.prune_around_birth(df, None, None).count() == 4
    assert ep.prune_around_birth(df, 1, None).count() == 2
    assert ep.prune_around_birth(df, None, 1).count() == 2
    assert ep.prune_around_birth(df, 2, 2).count() == 3


def test_twins_use_two_indexes(spark):
    df = times(spark, [("a", 1, at(5)), ("a", 2, at(5)), ("a", 3, at(2))], "id string, n int, b timestamp")
    got = {r.n: r.pregnancy_index for r in ep.birth_index(df, ["id"], "b", ["n"]).collect()}
    assert got == {3: 1, 1: 2, 2: 3}


def test_static_index_nulls_last(spark):
    rows = [("a", None, 1, 1), ("a", 2, None, 2), ("a", 2, 3, 3), ("a", 1, 9, 4), ("a", 2, 3, 5)]
    df = spark.createDataFrame(rows, "id string, f int, g int, seq long")
    got = {r.seq: r.pregnancy_index for r in ep.static_index(df, ["id"], ["f", "g"], "seq").collect()}
    assert got == {4: 1, 3: 2, 5: 3, 2: 4, 1: 5}


def test_pivot_keeps_last_even_if_null(spark):
    rows = [("a", "x", 1.0, 1), ("a", "x", None, 2), ("a", "y", None, 1), ("a", "y", 4.0, 2), ("b", "z", 1.0, 1)]
    df = spark.createDataFrame(rows, "id string, n string, v double, seq int")
    assert [tuple(r) for r in reshape.pivot_last(df, ["id"], "n", "v", "seq", ["x", "y"]).collect()] == [("a", None, 4.0)]
    first = {tuple(r) for r in reshape.pivot_first(df, ["id"], "n", "v", "seq", ["x", "y", "z"]).collect()}
    assert first == {("a", 1.0, 4.0, None), ("b", None, None, 1.0)}


def test_unique_check(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
    assert reshape.assert_unique(df, ["a", "b"]) is df
    with pytest.raises(ValueError):
        reshape.assert_unique(df, ["a"])


def test_melt_times_needs_no_column(spark):
    df = spark.createDataFrame([(1, "x")], "id int, other string")
    assert reshape.melt_times(df, ["id"]).count() == 0
    wide = spark.createDataFrame([(1, "2024-01-01 00:00:00", "NaT"), (1, "2024-01-01 00:00:00", "bad")], "id int, Blood_Dose_1 string, blood_product_1 string")
    assert [r.dose_time for r in reshape.melt_times(wide, ["id"]).collect()] == [dt.datetime(2024, 1, 1)]


def test_masks(spark):
    df = spark.createDataFrame([("a", 300.0), ("a", 100.0), ("b", 999.0)], "signal string, value double")
    assert [r.value for r in reshape.mask_implausible_long(df, {"a": (40, 250)}).collect()] == [None, 100.0, 999.0]
    wide = spark.createDataFrame([(300.0, 1.0)], "a double, b double")
    assert tuple(reshape.mask_implausible(wide, {"a": (40, 250), "zz": (0, 1)}).first()) == (None, 1.0)


def test_any_case_rename(spark):
    df = spark.createDataFrame([(1, 2)], "`Blood Dose` int, x int")
    assert reshape.rename(df, {"blood dose": "blood_dose"}, any_case=True).columns == ["blood_dose", "x"]
    assert reshape.ensure_columns(df, ["x", "y"]).select(F.col("y")).first()[0] is None

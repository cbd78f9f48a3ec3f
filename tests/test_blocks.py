"""Block-wise operators against plain evaluation, with an entity that owns half of all rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.functions.clock import cell
from gapline.operators import blocks


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out, used = [], set()
    while len(out) < 500:
        k = 0 if rng.random() < 0.5 else rng.randint(1, 5)
        t = rng.randint(0, 5000)
        if (k, t) not in used:
            used.add((k, t))
            out.append((k, t, rng.randint(1, 9)))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "k int, t long, v int").withColumn("b", cell("t", 300))


def per_key(rows):
    groups = {}
    for k, t, v in rows:
        groups.setdefault(k, []).append((t, v))
    return {k: sorted(g) for k, g in groups.items()}


def test_running_sum_and_rank(table, rows):
    got = {(r.k, r.t): r for r in blocks.running_sum(table, ["k"], "b", "t", {"s": "v"}, total=True).collect()}
    ranked = {(r.k, r.t): r for r in blocks.block_rank(table, ["k"], "b", "t", "rn", "n").collect()}
    for k, g in per_key(rows).items():
        total = 0
        for i, (t, v) in enumerate(g, 1):
            total += v
            assert got[k, t].s == total and got[k, t].s_total == sum(x[1] for x in g)
            assert ranked[k, t].rn == i and ranked[k, t].n == len(g)


def test_whole_table_rank(table, rows):
    got = [r.rn for r in blocks.block_rank(table, [], "b", ["t", "k"], "rn").orderBy("t", "k").collect()]
    assert got == list(range(1, len(rows) + 1))


def test_neighbours_cross_blocks(table, rows):
    got = {(r.k, r.t): r for r in blocks.neighbours(table, ["k"], "b", "t", ["t", "v"]).collect()}
    for k, g in per_key(rows).items():
        for i, (t, _) in enumerate(g):
            before, after = got[k, t]._prev, got[k, t]._next
            assert (None if before is None else tuple(before)) == (g[i - 1] if i else None)
            assert (None if after is None else tuple(after)) == (g[i + 1] if i + 1 < len(g) else None)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, table, rows, forward, strict):
    rng = random.Random(9)
    probes = [(rng.randint(0, 6), rng.randint(-50, 5200)) for _ in range(300)] + [(k, t) for k, t, _ in rows[:60]]
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(probes)], "id int, k int, at long")
    got = {r.id: r._match for r in blocks.asof(left, table, ["k"], "at", "t", ["t", "v"], slice_us=170, forward=forward, strict=strict).collect()}
    groups = per_key(rows)
    assert len(got) == len(probes)
    for i, (k, at) in enumerate(probes):
        g = groups.get(k, [])
        if forward:
            hits = [x for x in g if (x[0] > at if strict else x[0] >= at)]
            want = hits[0] if hits else None
        else:
            hits = [x for x in g if (x[0] < at if strict else x[0] <= at)]
            want = hits[-1] if hits else None
        assert (None if got[i] is None else tuple(got[i])) == want


@pytest.mark.parametrize("q", [0.5, 0.1, 0.0, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(3)
    data = {"flat": [4.0] * 31, "heavy": list(np.exp(rng.normal(size=800) * 6)), "one": [2.5], "two": [1.0, 9.0],
            "mixed": list(rng.integers(0, 5, 100).astype(float)) + [1e12]}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.quantile for r in blocks.exact_quantile(df, ["g"], "x", q, buckets=8).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        assert got[k] == pytest.approx(float(np.quantile(xs, q)), rel=1e-12)
    whole = blocks.exact_quantile(df, [], "x", q).collect()
    assert whole[0][0] == pytest.approx(float(np.quantile([x for xs in data.values() for x in xs], q)))


def test_measured_slice_shrinks(table):
    wide = blocks.measured_slice(table.withColumn("t", F.col("t") * 1_000_000), ["k"], "t", 8_000_000_000, 100)
    assert wide < 8_000_000_000

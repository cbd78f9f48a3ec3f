"""Boosted trees, greedy folds and curve corners against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gapline.config import TrainingSettings
from gapline.operators import boosting, evaluate, matrix
from gapline.plans import training
from gapline.sources.writers import materialize

FEATURES = ["a", "b", "c"]
CUTS = {"a": [1.0, 2.0, 3.0, 4.0], "b": [1.0, 2.0], "c": [5.0]}


def made_rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = float(rng.randrange(5)), float(rng.randrange(3))
        a = None if rng.random() < 0.2 else a
        b = math.nan if rng.random() < 0.1 else b
        c = float(rng.randrange(10))
        y = int((a is None or a >= 3) != (b == 1.0)) if rng.random() < 0.85 else rng.randrange(2)
        out.append((i, a, b, c, y))
    return out + [(n, 1.0, 1.0, 1.0, None)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int").repartition(parts)


def plain_tree(rows, margins, depth, l2=1.0, child_weight=8.0, step=0.3, pos_weight=1.0):
    """(feature, cut, missing_left) or leaf weight by node, by trying every cut of every feature on the rows."""
    nodes = {}

    def stats(members):
        g = h = 0.0
        for r in members:
            p = 1 / (1 + math.exp(-margins[r[0]]))
            w = pos_weight if r[4] == 1 else 1.0
            g, h = g + w * (p - r[4]), h + w * p * (1 - p)
        return g, h

    def missing(x):
        return x is None or math.isnan(x)

    def grow(at, members, left_levels):
        g, h = stats(members)
        best = None
        if left_levels:
            for f, name in enumerate(FEATURES):
                for cut in [*CUTS[name], math.inf]:
                    for missing_left in (False, True):
                        left = [r for r in members if (missing_left if missing(r[1 + f]) else r[1 + f] < cut)]
                        right = [r for r in members if r not in left]
                        if not left or not right:
                            continue
                        (gl, hl), (gr, hr) = stats(left), stats(right)
                        if min(hl, hr) < child_weight:
                            continue
                        gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - g * g / (h + l2)
                        if best is None or gain > best[0] + 1e-6:
                            best = (gain, name, cut, missing_left, left, right)
        if best is None or best[0] <= 0:
            nodes[at] = -g / (h + l2) * step
            return
        nodes[at] = best[:4]
        grow(2 * at + 1, best[4], left_levels - 1)
        grow(2 * at + 2, best[5], left_levels - 1)

    grow(0, [r for r in rows if r[4] is not None], depth)
    return nodes


def plain_leaf(nodes, row, at=0):
    if isinstance(nodes[at], float):
        return nodes[at]
    _, name, cut, missing_left = nodes[at]
    x = row[1 + FEATURES.index(name)]
    left = missing_left if x is None or math.isnan(x) else x < cut
    return plain_leaf(nodes, row, 2 * at + (1 if left else 2))


def test_two_trees_of_two_levels_equal_brute_force(spark):
    rows = made_rows()
    model = boosting.fit_boosted(
        frame(spark, rows), FEATURES, "y", trees=2, depth=2, step=0.3, subsample=1.0, columns=1.0, pos_weight=2.0, cuts=CUTS
    )
    margins = {r[0]: 0.0 for r in rows}
    for tree in range(2):
        want = plain_tree(rows, margins, 2, pos_weight=2.0)
        got = {n.node: n for n in model.nodes if n.tree == tree}
        assert set(got) == set(want)
        for i, node in want.items():
            if isinstance(node, float):
                assert got[i].feature is None and got[i].weight == pytest.approx(node, abs=1e-5)
            else:
                assert (got[i].feature, got[i].gain) == (node[1], pytest.approx(node[0], abs=1e-3))
        margins = {r[0]: margins[r[0]] + plain_leaf(want, r) for r in rows}
    for r in model.score(frame(spark, rows)).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-margins[r["id"]])), abs=1e-5)


def test_same_trees_for_any_partitioning_and_store(spark, tmp_path):
    def store(table, name):
        return materialize(spark, f"{tmp_path}/{name}", lambda: table, force=True)

    rows = made_rows()
    fit = dict(trees=10, depth=2, step=0.3, ids=["id"], columns=0.67, bins=16)
    one = boosting.fit_boosted(frame(spark, rows, 2), FEATURES, "y", **fit)
    two = boosting.fit_boosted(frame(spark, rows[::-1], 7), FEATURES, "y", store=store, **fit)
    assert one.nodes == two.nodes
    roots = {n.n_rows for n in one.nodes if n.node == 0}
    assert len(roots) > 1 and all(280 < n < 360 for n in roots)  # 0.8 of 400, another part for each tree
    assert len({n.feature for n in one.nodes if n.node == 0}) > 1


def test_trees_find_a_signal_with_gaps(spark):
    rows = frame(spark, made_rows(1200))
    model = boosting.fit_boosted(rows, FEATURES, "y", ["id"], trees=8, depth=3, step=0.3)
    areas = evaluate.ranking_metrics(model.score(rows), "y", "score").first()
    assert areas["roc_auc"] > 0.85


def test_present_against_missing_and_edges(spark):
    rows = [(i, None if i % 2 else 1.0, 1.0, None, i % 2) for i in range(80)]
    model = boosting.fit_boosted(frame(spark, rows), FEATURES, "y", trees=1, depth=3, subsample=1.0, columns=1.0)
    root = model.nodes[0] if model.nodes[0].node == 0 else next(n for n in model.nodes if n.node == 0)
    assert (root.feature, root.cut) == ("a", math.inf)
    scores = {r["y"]: r["score"] for r in model.score(frame(spark, rows)).collect()}
    assert scores[0] < 0.5 < scores[1]
    empty = boosting.fit_boosted(frame(spark, rows).filter("id < 0"), FEATURES, "y", ["id"], trees=3)
    assert empty.nodes == [] and empty.score(frame(spark, rows)).agg(F.max("score")).first()[0] == 0.5
    with pytest.raises(ValueError):
        boosting.fit_boosted(frame(spark, rows), FEATURES, "y")


def test_importances_are_aggregates_of_nodes(spark):
    model = boosting.fit_boosted(frame(spark, made_rows()), FEATURES, "y", ["id"], trees=4, depth=3, step=0.3)
    got = boosting.importances(model.node_table(spark)).collect()
    splits = [n for n in model.nodes if n.feature]
    assert [r["gain"] for r in got] == sorted((r["gain"] for r in got), reverse=True)
    assert sum(r["weight"] for r in got) == len(splits)
    for r in got:
        own = [n for n in splits if n.feature == r["feature"]]
        assert r["total_gain"] == pytest.approx(sum(n.gain for n in own))
        assert r["cover"] == pytest.approx(sum(n.cover for n in own) / len(own))


def test_folds_of_trees_with_their_report(spark, tmp_path):
    rows = [(f"m{i % 30}", i % 30 % 2, i, a, b, c, y) for i, a, b, c, y in made_rows(300)[:300]]
    df = spark.createDataFrame(rows, "hashed_mother_id string, episode_idx int, id int, a double, b double, c double, y int")
    settings = TrainingSettings(trees=2, depth=2, step=0.3, folds=3)
    report = training.train_boosted_folds(df, FEATURES, ["id"], settings, f"{tmp_path}/work")
    assert report.metrics.count() == 3
    assert report.scores.count() == 300 and report.scores.select("fold", "hashed_mother_id").distinct().count() == 30
    assert [r["count"] for r in report.scores.groupBy("fold").count().collect()] == [100] * 3
    assert set(report.importance.columns) == {"feature", "gain", "weight", "cover", "total_gain", "total_cover"}
    # positives weigh as many times as negatives outnumber them in the training rows, so both classes pull alike
    root = next(n for n in report.model.nodes if n.node == 0)
    assert 0 < root.n_rows < 200


# ------------------------------------------------------------------ folds
def plain_deal(sizes, k):
    loads = [0] * k
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    return loads


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_dealt_like_single_groups(seed):
    rng = random.Random(seed)
    for k in (1, 2, 3, 5, 8):
        sizes = [rng.choice((1, 2, 3, 7, 7, 50, 1000)) for _ in range(rng.randrange(1, 60))]
        runs = sorted({s: sizes.count(s) for s in sizes}.items(), reverse=True)
        loads = [0] * k
        for (size, many), (_, stretches) in zip(runs, matrix.deal_runs(runs, k)):
            ends = [at for at, _ in stretches[1:]] + [many]
            for (at, turn), end in zip(stretches, ends):
                for j in range(at, end):
                    f = turn[(j - at) % len(turn)]
                    assert loads[f] == min(loads) and f == loads.index(min(loads))
                    loads[f] += size
        assert loads == plain_deal(sizes, k)


def test_greedy_folds_balance_rows_of_a_hot_group(spark):
    rng = random.Random(5)
    sizes = [300, *[rng.randrange(1, 12) for _ in range(120)]]
    rows = [(None if g == 7 else g, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int")
    out = matrix.greedy_folds(df, ["g"], 4)
    assert out.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    loads = {r["fold"]: r["count"] for r in out.groupBy("fold").count().collect()}
    assert [loads[f] for f in range(4)] == plain_deal(sizes, 4)
    assert matrix.greedy_folds(df.filter("i < 0"), ["g"], 4).count() == 0


# ------------------------------------------------------------------ curves
@pytest.mark.parametrize("rule", ["steps", "slopes"])
def test_corners_of_curves(spark, rule):
    rng = random.Random(11)
    rows = []
    for key in ("p", "q"):
        for s in range(60):
            pos, neg = rng.choice([(1, 0), (1, 0), (0, 1), (2, 2), (1, 1), (0, 2)])
            rows += [(key, s / 60, 1)] * pos + [(key, s / 60, 0)] * neg
    df = spark.createDataFrame(rows, "k string, s double, y int")
    want = set()
    for key in ("p", "q"):
        scores = sorted({r[1] for r in rows if r[0] == key}, reverse=True)
        steps = [tuple(sum(1 for r in rows if r[:2] == (key, s) and r[2] == c) for c in (1, 0)) for s in scores]
        for i, s in enumerate(scores):
            if i in (0, len(scores) - 1):
                want.add((key, s))
                continue
            (p, n), (p2, n2) = steps[i], steps[i + 1]
            if ((p, n) != (p2, n2)) if rule == "steps" else (p * n2 != n * p2):
                want.add((key, s))
    got = evaluate.roc_points(df, "y", "s", ["k"], simplify=rule).collect()
    assert {(r["k"], r["threshold"]) for r in got if r["threshold"] != math.inf} == want
    assert sum(r["threshold"] == math.inf for r in got) == 2
    assert len(want) < 100
    # a curve of corners has the same area
    whole = evaluate.roc_points(df, "y", "s", ["k"]).collect()

    def area(points, key):
        at = sorted((r["fpr"], r["tpr"]) for r in points if r["k"] == key)
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(at, at[1:]))

    for key in ("p", "q"):
        assert area(got, key) == pytest.approx(area(whole, key))
    with pytest.raises(ValueError):
        evaluate.roc_points(df, "y", "s", simplify="other")

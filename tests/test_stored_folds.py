"""Folds are dealt once, fits of folds share their scans, and only asked-for statistics are formed."""

import random

import pytest
from pyspark.sql import functions as F

from gapline.operators import matrix, models
from gapline.suite import all_queries


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(i, i % 40, rng.random(), None if i % 7 == 0 else rng.random()) for i in range(400)]
    return spark.createDataFrame([(i, g, a, b, int(a > 0.5)) for i, g, a, b in made], "id int, g int, a double, b double, y int")


def test_groups_are_joined_by_their_columns(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 5, None if i % 3 == 0 else "x") for i in range(60)], "id int, g int, t string")
    for folded in (matrix.group_folds(df, ["g", "t"], 3), matrix.greedy_folds(df, ["g", "t"], 3), matrix.group_holdout(df, ["g", "t"])):
        assert "structstojson" not in plan_of(folded).lower()
        out = folded.collect()
        own = {}
        for r in out:
            own.setdefault((r.g, r.t), set()).add(r[-1])
        assert len(out) == 60 and len(own) == 10 and all(len(x) == 1 for x in own.values())


def test_imputation_reads_stored_folds(spark, small_dir):
    assert "Window" not in plan_of(all_queries()["fold_imputation"].run(spark, small_dir))


def test_tree_fits_read_stored_folds(spark, small_dir, monkeypatch):
    seen = []

    def fit(df, *args, **kwargs):
        seen.append(plan_of(df))
        raise RuntimeError("seen")

    monkeypatch.setattr(models, "fit_trees", fit)
    with pytest.raises(RuntimeError):
        all_queries()["trees_cross_validated"].run(spark, small_dir)
    assert len(seen) == 1 and "Window" not in seen[0]


def test_plain_training_rows_are_not_copied(rows):
    stored = []

    def store(table, name):
        stored.append(name)
        return table.localCheckpoint()

    learner = models.boosted_learner("y", [], trees=1, depth=1, subsample=1.0, columns=1.0)
    _, scores, _ = models.cross_validate(rows, ["a", "b"], "y", ["g"], 3, learner=learner, store=store)
    assert scores.count() == 400 and stored == ["folds", "scores", "metrics"]


def test_deltas_form_no_other_statistic(spark, small_dir):
    plan = plan_of(all_queries()["personalized_deltas"].run(spark, small_dir))
    assert "fine_abs_from_prebirth_last" in plan
    assert "coarse" not in plan and "median" not in plan and "shock_index" not in plan


@pytest.mark.parametrize("groups", [40, 2])
def test_one_fit_for_all_folds(rows, groups, monkeypatch):
    """Also with more folds than groups."""
    calls = []

    def fit(df, features, fold=None, *args):
        calls.append(fold)
        return matrix.fit_scalers(df, features, fold, *args)

    monkeypatch.setattr(models, "fit_scalers", fit)
    monkeypatch.setattr(models, "fit_scaler", lambda df, features: fit(df, features))
    df = rows.withColumn("g", F.col("g") % groups)
    _, scores, metrics = models.cross_validate(df, ["a", "b"], "y", ["g"], k=3, fill=True, store=lambda t, _: t.localCheckpoint(), trees=1, depth=1, step=0.3)
    assert scores.count() == 400 and {r.fold for r in metrics.collect()} == set(range(min(groups, 3)))
    assert calls == (["fold"] if groups == 40 else ["fold", None])

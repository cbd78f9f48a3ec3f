"""Model fits on Spark ML: boosted trees, cross-validation, score fusion, permutation importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from gapline.functions.scalar import hash_rank
from gapline.operators.boosting import BoostedTrees, fit_boosted
from gapline.operators.blocks import block_rank, hash_block, one_row
from gapline.operators.evaluate import ranking_metrics, threshold_metrics
from gapline.operators.matrix import add_missing_mask, apply_scaler, class_weights, downsample_even, fit_scaler, fit_scalers, greedy_folds, group_folds


def assemble(df: DataFrame, features: Sequence[str], out: str = "_x") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def weight_rows(df: DataFrame, label: str, cap: float | None = None, out: str = "_w") -> DataFrame:
    """Positives get the class weight of the rows at hand, negatives 1."""
    weights = one_row(class_weights(df, label, cap=cap).select("pos_weight"))
    weighted = df.withColumn("_pw", weights["pos_weight"])
    return weighted.withColumn(out, F.when(F.col(label) == 1, F.col("_pw")).otherwise(1.0)).drop("_pw")


def fit_trees(df: DataFrame, features: Sequence[str], label: str, trees: int = 400, depth: int = 5,
              step: float = 0.05, subsample: float = 0.8, seed: int = 42, weight: str = "_w"):
    """Boosted trees on imputed features, with row weights."""
    learner = GBTClassifier(
        featuresCol="_x", labelCol=label, weightCol=weight, maxIter=trees, maxDepth=depth, stepSize=step,
        subsamplingRate=subsample, seed=seed,
    )
    return learner.fit(assemble(df, features))


def score(model, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Rows with the probability of the positive class."""
    scored = model.transform(assemble(df, features))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "_x", "probability", "rawPrediction", "prediction"
    )


def prepare(train: DataFrame, rows: DataFrame, features: Sequence[str], mask: bool = True, scaler: DataFrame | None = None):
    """Filled and scaled training rows and other rows, fitted on the training rows alone; and the feature names.

    `scaler` is the fit of the training rows where it is known already.
    """
    scaler = fit_scaler(train, features) if scaler is None else scaler
    names = [*features, *([f"{c}_missing" for c in features] if mask else [])]

    def ready(df: DataFrame) -> DataFrame:
        return apply_scaler(add_missing_mask(df, features) if mask else df, scaler, features)

    return ready(train), ready(rows), names


def boosted_learner(label: str, ids: Sequence[str], store: Callable[[DataFrame, str], DataFrame] | None = None,
                    **settings) -> Callable[[DataFrame, Sequence[str]], BoostedTrees]:
    """A learner of second-order trees on unfilled features; positives weigh as many times as negatives outnumber them."""

    def learn(train: DataFrame, features: Sequence[str]) -> BoostedTrees:
        weight = class_weights(train, label).first()
        return fit_boosted(train, features, label, ids, pos_weight=weight["pos_weight"] if weight else 1.0, store=store, **settings)

    return learn


def cross_validate(df: DataFrame, features: Sequence[str], label: str, group: Sequence[str], k: int = 5,
                   seed: int = 42, even: bool = False, ids: Sequence[str] = (), threshold: float = 0.5,
                   fill: bool = False, store: Callable[[DataFrame, str], DataFrame] | None = None,
                   learner: Callable[[DataFrame, Sequence[str]], Callable[[DataFrame], DataFrame]] | None = None,
                   greedy: bool = False, **trees):
    """(best model, validation scores with `fold`, metrics per fold): one fit per group fold, best ROC area kept.

    With `fill`, medians, means and deviations come from each fold's own training rows, after they are balanced, and
    missing flags are added; validation rows shape nothing.  Without `even` the same scans fit all folds.
    `store(table, name)` keeps tables that are read often; training rows that are a filter of the folds are not kept again.
    `learner(training rows, features)` returns a model that adds `score` to a table, in the place of the weighted trees
    of Spark ML.  `greedy` deals each group to the lightest fold.
    """
    keep = store or (lambda table, _: table)
    folded = keep((greedy_folds if greedy else group_folds)(df, group, k, seed), "folds")
    own_rows = keep if fill or even else lambda table, _: table
    scalers = fit_scalers(folded, features, "fold") if fill and not even else None
    fitted = {r["fold"] for r in scalers.select("fold").distinct().collect()} if scalers is not None else set()
    fits, parts = [], []
    for fold in range(k):
        train, rest = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold)
        if even:
            train = downsample_even(train, label, ids or group, seed)
        names = list(features)
        if fill:
            # a fold without rows is in no fit of others
            known = scalers.filter(F.col("fold") == fold).drop("fold") if fold in fitted else None
            train, rest, names = prepare(train, rest, features, scaler=known)
        if learner:
            model = learner(own_rows(train, f"train{fold}"), names)
            scored = model(rest)
        else:
            model = fit_trees(own_rows(weight_rows(train, label), f"train{fold}"), names, label, seed=seed, **trees)
            scored = score(model, rest, names)
        fits.append(model)
        parts.append(scored.select(*df.columns, "fold", "score"))
    scores = keep(reduce(DataFrame.unionByName, parts), "scores")
    metrics = keep(
        ranking_metrics(scores, label, "score", ["fold"]).join(threshold_metrics(scores, label, "score", threshold, ["fold"]), "fold"), "metrics"
    )
    rows = metrics.select("fold", "roc_auc").collect()  # one row per fold
    usable = [r for r in rows if r["roc_auc"] is not None]
    if not usable:
        raise ValueError("no fold holds both classes")
    best = max(usable, key=lambda r: r["roc_auc"])["fold"]
    return fits[best], scores, metrics


def fold_report(folded: DataFrame, label: str, scored: str = "score") -> DataFrame:
    """Per fold: training and validation rows, positive weight of the training part, areas on the validation part."""
    own = folded.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_validation"), F.sum((F.col(label) == 1).cast("long")).alias("_p"), F.sum((F.col(label) == 0).cast("long")).alias("_n")
    )
    total = folded.agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) == 0).cast("long")).alias("n")
    )
    counts = own.withColumn("_t", one_row(total)).select(
        "fold", (F.col("_t.rows") - F.col("n_validation")).alias("n_train"), "n_validation",
        ((F.col("_t.n") - F.col("_n")) / F.greatest(F.col("_t.p") - F.col("_p"), F.lit(1)).cast("double")).alias("pos_weight"),
    )
    return counts.join(ranking_metrics(folded, label, scored, ["fold"]), "fold")


def importance_table(model, features: Sequence[str], spark) -> DataFrame:
    """(feature, importance), most important first; one row per feature."""
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return spark.createDataFrame(values, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def most_important(model, features: Sequence[str], n: int) -> list[str]:
    """The n features with the highest importance, as a prefilter of permutations; one number per feature."""
    values = sorted(zip(features, model.featureImportances.toArray()), key=lambda x: (-x[1], x[0]))
    return [f for f, _ in values[:n]]


def fit_fusion(df: DataFrame, label: str, scores: Sequence[str] = ("static_score", "sequence_score"), c: float = 1.0,
               max_iter: int = 200):
    """Logistic regression on two scores with inverse regularisation C over summed losses."""
    n = max(df.count(), 1)
    learner = LogisticRegression(
        featuresCol="_x", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False,
        maxIter=max_iter, tol=1e-12,
    )
    return learner.fit(assemble(df, scores))


def permuted(df: DataFrame, ids: Sequence[str], features: Sequence[str], tested: Sequence[str], repeats: int, seed) -> DataFrame:
    """Every row once for each (feature, turn), with that feature's value taken from another row, as a double.

    Rows are ranked once by a hash.  In turn t of a feature all its values move on by the same distance in that order,
    drawn from a hash of feature and turn: a permutation without a fixed row.  Each value is sent to the rank that takes
    it, so one shuffle carries (rank, feature, turn, value); the whole row moves once, to its own rank, and is repeated
    there, in the task that scores it.
    """
    ranked = df.withColumn("_h", hash_rank(seed, *ids)).withColumn("_block", hash_block("_h"))
    ranked = block_rank(ranked, [], "_block", ["_h", *ids], "_rank", total="_rows").drop("_h", "_block")
    values = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in tested])
    sent = ranked.select("_rank", "_rows", F.explode(values).alias("_v")).select("_rank", "_rows", "_v.*")
    turns = F.array(*[F.lit(t) for t in range(repeats)])
    sent = sent.withColumn("turn", F.explode(turns))
    drawn = F.conv(F.substring(hash_rank(seed, F.col("feature"), F.col("turn")), 1, 12), 16, 10).cast("long")
    step = F.pmod(drawn, F.greatest(F.col("_rows") - 1, F.lit(1))) + 1
    sent = sent.select((F.pmod(F.col("_rank") - 1 - step, F.col("_rows")) + 1).alias("_rank"), "feature", "turn", "value")
    # one value per tested feature and turn
    taken = sent.groupBy("_rank").agg(F.collect_list(F.struct("feature", "turn", "value")).alias("_taken"))
    mixed = ranked.drop("_rows").join(taken, "_rank").withColumn("_t", F.explode("_taken")).drop("_taken")
    changed = {f: F.when(F.col("_t.feature") == f, F.col("_t.value")).otherwise(F.col(f).cast("double")) for f in tested}
    return mixed.select(
        *[c for c in df.columns if c not in changed], *[x.alias(f) for f, x in changed.items()],
        F.col("_t.feature").alias("feature"), F.col("_t.turn").alias("turn"),
    )


def permutation_importance(scorer, df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str],
                           repeats: int = 5, tested: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Mean and std of the loss in average precision when one feature is shuffled.

    `scorer` is a fitted tree model or a function that adds `score` to a table.  All features and turns are one plan.
    """
    add = scorer if callable(scorer) else lambda rows: score(scorer, rows, features)
    rows = df.select(*ids, label, *features)
    whole = one_row(ranking_metrics(add(rows), label, "score").select("average_precision"))
    mixed = add(permuted(rows, ids, features, list(tested or features), repeats, seed))
    runs = ranking_metrics(mixed.select(label, "score", "feature", "turn"), label, "score", ["feature", "turn"])
    loss = F.col("_base") - F.col("average_precision")
    return runs.withColumn("_base", whole["average_precision"]).groupBy("feature").agg(
        F.avg(loss).alias("importance_mean"), F.stddev_pop(loss).alias("importance_std")
    )

"""Model matrix: labels, splits, sampling, imputation, scaling and weights."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapline.functions.scalar import hash_rank, matrix_float, nan_to_null
from gapline.operators.blocks import block_rank, first_in_blocks, hash_block, one_row
from gapline.operators.quantiles import column_statistics


# ---------------------------------------------------------------- cells and columns
def project_matrix(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[matrix_float(f"`{c}`").alias(c) for c in features])


def binarize(df: DataFrame, label: str, positive: Sequence[int] = (1, 2), out: str = "y") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.col(label).isin(*positive), F.lit(False)).cast("int"))


def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep, feature, value) rows, nulls included."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for c in features])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.feature", "_p.value")


def feature_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample variance per feature, one aggregation over all columns."""
    one = df.agg(*[F.var_samp(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(features)])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(features)])
    return one.select(F.explode(pairs).alias("_p")).select("_p.*")


def varying_features(df: DataFrame, features: Sequence[str], least: float = 1e-12) -> list[str]:
    """Features whose variance is above the limit; one number per feature reaches the driver."""
    kept = {r["feature"] for r in feature_variance(df, features).filter(F.col("variance") > least).collect()}
    return [c for c in features if c in kept]


def add_missing_mask(df: DataFrame, features: Sequence[str], suffix: str = "_missing") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": F.col(f"`{c}`").isNull().cast("float") for c in features})


# ---------------------------------------------------------------- imputation and scaling
def fit_scalers(df: DataFrame, features: Sequence[str], fold: str | None = None, least_std: float = 1e-8, work=None) -> DataFrame:
    """(fold, feature, median, mean, std): median of the values, mean and population std after filling with it.

    With `fold`, each fold gets the fit of all rows outside it.  Two scans fit all features of all folds: medians are
    exact, and filled moments follow from the moments of the values and the number of nulls.  The result is a small table
    of constants, one row per fold and feature, so it is not fitted again on every use and can be stored.
    """
    fitted = []
    for s in column_statistics(df, features, 0.5, fold, work):
        holes, median = s["rows"] - s["n"], s["quantile"]
        mean = std = None
        if s["n"]:
            mean = (s["n"] * s["mean"] + holes * median) / s["rows"]
            spread = s["n"] * (s["variance"] + (s["mean"] - mean) ** 2) + holes * (median - mean) ** 2
            std = math.sqrt(spread / s["rows"])
        else:
            mean = 0.0
        fitted.append((s["fold"] if fold else None, s["column"], median, mean, None if std is None else 1.0 if std < least_std else std))
    kind = df.schema[fold].dataType.simpleString() if fold else "int"
    table = df.sparkSession.createDataFrame(fitted, f"fold {kind}, feature string, median double, mean double, std double")
    return table if fold else table.drop("fold")


def fit_scaler(df: DataFrame, features: Sequence[str], least_std: float = 1e-8) -> DataFrame:
    """(feature, median, mean, std) of all rows."""
    return fit_scalers(df, features, None, least_std)


def apply_fold_scalers(df: DataFrame, scalers: DataFrame, features: Sequence[str], fold: str = "fold") -> DataFrame:
    """Fill and scale the rows of every fold by the fit of the other folds."""
    fit = [F.max(F.when(F.col("feature") == c, F.struct("median", "mean", "std"))).alias(f"f{i}") for i, c in enumerate(features)]
    per = scalers.groupBy(F.col("fold").alias(fold)).agg(*fit)
    per = per.select(fold, F.struct(*[f"f{i}" for i in range(len(features))]).alias("_fit"))
    new = {c: (F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"_fit.f{i}.median")) - F.col(f"_fit.f{i}.mean")) / F.col(f"_fit.f{i}.std") for i, c in enumerate(features)}
    wide = df.join(per, fold)
    return wide.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def apply_scaler(df: DataFrame, scaler: DataFrame, features: Sequence[str], standardize: bool = True) -> DataFrame:
    """Fill nulls with the median, then subtract the mean and divide by the std."""
    fitted = one_row(
        scaler.agg(*[F.max(F.when(F.col("feature") == c, F.struct("median", "mean", "std"))).alias(f"f{i}")
                     for i, c in enumerate(features)])
    )
    new = {}
    for i, c in enumerate(features):
        x = F.coalesce(F.col(f"`{c}`").cast("double"), F.col(f"_fit.f{i}.median"))
        new[c] = (x - F.col(f"_fit.f{i}.mean")) / F.col(f"_fit.f{i}.std") if standardize else x
    wide = df.withColumn("_fit", fitted)
    return wide.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[x.alias(c) for c, x in new.items()])


def median_fill(df: DataFrame, features: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Infinite values to null, nulls to the median of the fitted rows, float precision."""
    clean = df.select(*[matrix_float(f"`{c}`").alias(c) if c in features else F.col(f"`{c}`") for c in df.columns])
    source = clean if fit_on is None else project_matrix(fit_on, features)
    return apply_scaler(clean, fit_scalers(source, features), features, False)


# ---------------------------------------------------------------- classes
def class_weights(df: DataFrame, label: str, keys: Sequence[str] = (), cap: float | None = None) -> DataFrame:
    """Positives, negatives and the positive weight negatives / max(positives, 1)."""
    pos = F.sum((F.col(label) == 1).cast("long"))
    neg = F.sum((F.col(label) == 0).cast("long"))
    agg = df.groupBy(*keys).agg(pos.alias("n_pos"), neg.alias("n_neg"))
    weight = F.col("n_neg") / F.greatest(F.col("n_pos"), F.lit(1)).cast("double")
    if cap is not None:
        weight = F.least(weight, F.lit(float(cap)))
    return agg.withColumn("pos_weight", weight)


def _hash_ranked(df: DataFrame, keys: Sequence[str], ids: Sequence[str], seed, total: str | None = None) -> DataFrame:
    rows = df.withColumn("_hash", hash_rank(seed, *ids)).withColumn("_block", hash_block("_hash"))
    return block_rank(rows, keys, "_block", ["_hash", *ids], "_rank", total).drop("_hash", "_block")


def balanced_sample(df: DataFrame, label: str, ids: Sequence[str], n: int, seed: int = 111) -> DataFrame:
    """At most n rows of every class, the same ones in every run; ids identify a row."""
    return _first_by_hash(df, label, ids, seed, n)


def _first_by_hash(df: DataFrame, label: str, ids: Sequence[str], seed, n) -> DataFrame:
    rows = df.withColumn("_hash", hash_rank(seed, *ids)).withColumn("_block", hash_block("_hash"))
    return first_in_blocks(rows, [label], "_block", ["_hash", *ids], n).drop("_hash", "_block").select(*df.columns)


def sample_per_class(df: DataFrame, label: str, ids: Sequence[str], n: int, seed: int, classes=(0, 1)) -> DataFrame:
    """n rows per class; a class without rows is an error."""
    found = {r[0] for r in df.groupBy(label).count().select(label).collect()}
    if not set(classes) <= found:
        raise ValueError(f"no rows with {label} in {sorted(set(classes) - found)}")
    return balanced_sample(df, label, ids, n, seed)


def downsample_even(df: DataFrame, label: str, ids: Sequence[str], seed: int = 123) -> DataFrame:
    """As many rows of every class as the smallest class has."""
    least = df.groupBy(label).count().agg(F.min("count").alias("_least"))
    return _first_by_hash(df, label, ids, seed, one_row(least)["_least"])


def _hash_number(seed: str, *cols) -> Column:
    return F.conv(F.substring(hash_rank(seed, *cols), 1, 12), 16, 10).cast("long")


def resample_balanced(df: DataFrame, label: str, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """As many draws with replacement as there are rows, each class with the same weight.

    Draw d picks a class and a position in it from hashes of d; positions are the hash
    ranks of the class, so draws find their rows by an equality join.
    """
    ranked = _hash_ranked(df, [label], ids, f"{seed}r", total="_in_class")
    # label classes are few
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size")).agg(
        F.array_sort(F.collect_list(F.struct(label, "_size"))).alias("_classes")
    )
    draws = df.select(*[F.col(c).alias(f"draw_{c}") for c in ids]).withColumn("_classes", one_row(classes)["_classes"])
    own = [f"draw_{c}" for c in ids]
    pick = F.pmod(_hash_number(f"{seed}c", *own), F.size("_classes")).cast("int")
    draws = draws.withColumn("_class", F.get("_classes", pick))
    rank = F.pmod(_hash_number(f"{seed}p", *own), F.col("_class._size")) + 1
    draws = draws.select(*own, F.col(f"_class.{label}").alias(label), rank.alias("_rank"))
    return draws.join(ranked, [label, "_rank"]).drop("_rank", "_in_class")


# ---------------------------------------------------------------- splits
def group_holdout(df: DataFrame, group: Sequence[str], fraction: float = 0.2, seed: int = 42,
                  out: str = "is_validation") -> DataFrame:
    """0/1 column: whole groups go to validation, ceil(fraction * groups) of them and at least one.

    With fewer than two groups nothing goes there.  A null in the group columns is a value like any other.
    """
    groups = df.select(*group).distinct()
    ranked = _hash_ranked(groups, [], group, seed, total="_groups")
    wanted = F.greatest(F.lit(1), F.ceil(F.col("_groups") * F.lit(float(fraction))))
    chosen = ranked.withColumn(out, ((F.col("_groups") >= 2) & (F.col("_rank") <= wanted)).cast("int"))
    return _with_group_column(df, chosen, group, out)


def _with_group_column(df: DataFrame, groups: DataFrame, group: Sequence[str], out: str) -> DataFrame:
    """Rows with a column of their group; a null in the group columns is a value like any other."""
    names = [f"_g{i}" for i in range(len(group))]
    found = groups.select(*[F.col(c).alias(g) for c, g in zip(group, names)], out)
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group, names)])
    return df.join(found, same).drop(*names)


def group_folds(df: DataFrame, group: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number per row; groups stay together and folds get groups of like sizes.

    Groups are ranked by size (largest first) and dealt out back and forth: groups of one size in hash blocks, after
    the number of larger groups.  A null in the group columns is a value like any other.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    sizes = sizes.withColumn("_hash", hash_rank(seed, *group)).withColumn("_block", hash_block("_hash"))
    # one row per distinct size
    larger = Window.orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("_many")).select(
        "_size", F.coalesce(F.sum("_many").over(larger), F.lit(0)).alias("_larger")
    )
    ranked = block_rank(sizes, ["_size"], "_block", ["_hash", *group], "_inside").join(before, "_size")
    ranked = ranked.withColumn("_rank", F.col("_inside") + F.col("_larger"))
    at = F.pmod(F.col("_rank") - 1, F.lit(k))
    round_ = F.floor((F.col("_rank") - 1) / k)
    fold = F.when(F.pmod(round_, F.lit(2)) == 0, at).otherwise(k - 1 - at)
    return _with_group_column(df, ranked.withColumn(out, fold.cast("int")), group, out)


def deal_runs(runs: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[tuple[int, list[int]]]]]:
    """Runs of (size, number of groups), largest size first, dealt to the lightest fold first; ties to the lowest fold.

    Inside a run the j-th group goes to the fold of the j-th smallest of all (load + t * size, fold).  In whole sizes
    a fold with load q * size + r takes part from level q on, and a level is taken in the order of (r, fold): so a run
    is a few stretches, at most k, in which the same folds take turns.  Per run: (start, folds in turn) of each.
    """
    loads = [0] * k
    plan = []
    for size, many in runs:
        levels = [(load // size, load % size, f) for f, load in enumerate(loads)]
        starts = sorted({q for q, _, _ in levels})
        at, stretches = 0, []
        for level, following in zip(starts, [*starts[1:], None]):
            turn = [f for _, f in sorted((r, f) for q, r, f in levels if q <= level)]
            room = many - at if following is None else min(many - at, (following - level) * len(turn))
            if room > 0:
                stretches.append((at, turn))
                rounds, rest = divmod(room, len(turn))
                for place, f in enumerate(turn):
                    loads[f] += size * (rounds + (place < rest))
                at += room
        plan.append((size, stretches))
    return plan


def greedy_folds(df: DataFrame, group: Sequence[str], k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold number per row; groups stay together, and each goes to the lightest fold so far, largest groups first.

    Groups of one size follow each other by hash.  Only one (size, number) pair per distinct size reaches the driver,
    at most sqrt(2 * rows) of them; loads are carried from size to size, never from group to group.  A null in the
    group columns is a value like any other.
    """
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    runs = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()
    plan = deal_runs(sorted(((r["_size"], r["n"]) for r in runs), reverse=True), k)
    dealt = df.sparkSession.createDataFrame(plan, "_size long, _turns array<struct<at: long, folds: array<int>>>")
    sizes = sizes.withColumn("_hash", hash_rank(seed, *group)).withColumn("_block", hash_block("_hash"))
    ranked = block_rank(sizes, ["_size"], "_block", ["_hash", *group], "_inside").join(dealt, "_size")
    place = F.col("_inside") - 1
    turn = F.element_at(F.filter("_turns", lambda t: t["at"] <= place), -1)
    ranked = ranked.withColumn("_turn", turn)
    fold = F.get("_turn.folds", F.pmod(place - F.col("_turn.at"), F.size("_turn.folds")).cast("int"))
    return _with_group_column(df, ranked.withColumn(out, fold), group, out)


def dataset_summary(df: DataFrame, entity: str, episode: Sequence[str], label: str) -> DataFrame:
    """Rows, positives, their share, entities and episodes.

    Entities and episodes are made distinct first, so no task gathers all of them.
    """
    per = df.groupBy(*episode).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col(label) > 0).cast("long")).alias("p")
    )
    entities = per.groupBy(entity).agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("e")
    )
    both = entities.agg(
        F.sum("n").alias("n_rows"), F.sum("p").alias("n_positive"), F.sum("e").alias("n_episodes"),
        F.count(F.lit(1)).alias("n_entities"),
    )
    return both.withColumn("positive_share", F.try_divide(F.col("n_positive").cast("double"), F.col("n_rows")))


def frequency_filter(
    df: DataFrame, entity: str, ts: str, vitals: Sequence[str], doses: DataFrame | None, least: float
) -> DataFrame:
    """Rows of entities with a dose, or whose most frequent signal reaches the least number per measured hour."""
    shown = [c for c in vitals if c in df.columns]
    if least <= 0 or not shown:
        return df
    hourly = df.groupBy(entity, F.date_trunc("hour", ts).alias("_h")).agg(
        *[F.count(nan_to_null(F.col(f"`{c}`").cast("double"))).alias(f"_n{i}") for i, c in enumerate(shown)]
    )
    per = hourly.groupBy(entity).agg(
        F.count("_h").alias("_hours"), *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(shown))]
    )
    best = F.greatest(*[F.col(f"_n{i}") for i in range(len(shown))]) if len(shown) > 1 else F.col("_n0")
    frequent = per.filter(F.try_divide(best.cast("double"), F.col("_hours")) >= least).select(entity)
    if doses is not None:
        frequent = frequent.unionByName(doses.select(entity)).distinct()
    return df.join(frequent, [entity], "left_semi")


def dose_presence(episodes: DataFrame, doses: DataFrame, keys: Sequence[str], out: str = "has_dose") -> DataFrame:
    marked = doses.select(*keys).distinct().withColumn(out, F.lit(1))
    return episodes.join(marked, list(keys), "left").withColumn(out, F.coalesce(out, F.lit(0)))

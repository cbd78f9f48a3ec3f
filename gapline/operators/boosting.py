"""Boosted trees for a binary label, of second order, on histograms: one aggregation per tree level.

Each level counts gradients and hessians per (node, feature, bin) with map-side combine; cuts are chosen from these
counts by windows over bins.  Only the chosen cuts (at most 2 ** depth rows a level) reach the driver.  Missing values
are a bin of their own and follow the side that gains more.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Gradients and hessians are summed as whole multiples of this, so that sums do not depend on the order of tasks.
#: Rows of weight 100 overflow a long beyond 8e10 rows.
UNIT = 2.0**-20
#: Trees after which the margins of the training rows are stored again.
STORE_EVERY = 8
NODE_SCHEMA = (
    "tree int, node int, feature string, cut double, missing_left boolean, gain double, cover double, n_rows long, weight double"
)


@dataclass(frozen=True)
class Node:
    """A node of a tree; children of node i are 2 i + 1 (below the cut) and 2 i + 2.  A leaf has no feature.

    An infinite cut parts present values from missing ones.
    """

    tree: int
    node: int
    feature: str | None
    cut: float | None
    missing_left: bool | None
    gain: float
    cover: float
    n_rows: int
    weight: float
    bin: int | None = None


def _values(features: Sequence[str]) -> list[Column]:
    """Features as doubles; NaN is missing."""
    return [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in features]


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int = 256) -> dict[str, list[float]]:
    """Cut points per feature, from quantiles of its present values: one aggregation, `bins` numbers a feature.

    A feature with few distinct values gets all of those that own at least one in `bins` rows, and its highest.
    """
    shares = [i / bins for i in range(1, bins)] + [1.0]
    found = df.select(*[x.alias(f"_{i}") for i, x in enumerate(_values(features))]).agg(
        *[F.percentile_approx(f"_{i}", shares, 20 * bins).alias(f"_{i}") for i in range(len(features))]
    ).first()
    return {c: sorted(set(found[i] or ())) for i, c in enumerate(features)}


def binned(df: DataFrame, features: Sequence[str], cuts: Mapping[str, Sequence[float]], out: str = "_b") -> DataFrame:
    """Rows with an array of bins: the number of cut points at or below the value, null for a missing one."""
    values = [f"_v{i}" for i in range(len(features))]
    places = [f"_p{i}" for i in range(len(features))]
    splits = [[-math.inf, *cuts[c], math.inf] if cuts[c] else [-math.inf, 0.0, math.inf] for c in features]
    rows = df.select("*", *[F.coalesce(x, F.lit(math.nan)).alias(v) for x, v in zip(_values(features), values)])
    rows = Bucketizer(inputCols=values, outputCols=places, splitsArray=splits, handleInvalid="keep").transform(rows)
    bins = [F.when(~F.isnan(v), F.col(p).cast("int")) for v, p in zip(values, places)]
    return rows.withColumn(out, F.array(*bins)).drop(*values, *places)


def _route(nodes: Mapping[int, Node], at: int, features: Mapping[str, int], array: str, binwise: bool,
           leaf: Callable[[int, Node | None], str]) -> str:
    """SQL text that leads a row from a node to the end of the tree as far as it is grown."""
    node = nodes.get(at)
    if node is None or node.feature is None:
        return leaf(at, node)
    x = f"{array}[{features[node.feature]}]"
    if math.isinf(node.cut):  # present values against missing ones
        test = f"if({x} IS NULL, NULL, true)"
    else:
        test = f"{x} <= {node.bin}" if binwise else f"{x} < {node.cut!r}D"
    left, right = (_route(nodes, child, features, array, binwise, leaf) for child in (2 * at + 1, 2 * at + 2))
    return f"if(coalesce({test}, {'true' if node.missing_left else 'false'}), {left}, {right})"


def _leaf_weight(at: int, node: Node | None) -> str:
    return f"{node.weight!r}D"


def sampled_features(features: Sequence[str], share: float, tree: int, seed: int, spark: SparkSession) -> list[int]:
    """Positions of the features of a tree: those with the smallest hash of seed, tree and name."""
    many = max(1, round(share * len(features)))
    if many >= len(features):
        return list(range(len(features)))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(features)], "i int, c string")
    ranked = names.orderBy(F.xxhash64(F.lit(seed), F.lit(tree), "c"), "i").limit(many).collect()
    return sorted(r["i"] for r in ranked)


def histogram(rows: DataFrame, picked: Sequence[int]) -> DataFrame:
    """(`_node`, feature position `_f`, bin `_k`): gradients, hessians in units, rows."""
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.get("_b", F.lit(i)).alias("k")) for i in picked])
    long = rows.select("_node", "_g", "_h", F.explode(cells).alias("_c")).select("_node", "_g", "_h", "_c.f", "_c.k")
    return long.groupBy("_node", F.col("f").alias("_f"), F.col("k").alias("_k")).agg(
        F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count(F.lit(1)).alias("n")
    )


def best_cuts(counts: DataFrame, l2: float, child_weight: float) -> DataFrame:
    """The best cut of every node: one row per node, without a cut where no side may be split off.

    Gain is G_l^2/(H_l + l2) + G_r^2/(H_r + l2) - G^2/(H + l2).  Ties go to the first feature, then to the lowest cut,
    then to missing values on the right.
    """
    one = Window.partitionBy("_node", "_f")
    upto = one.orderBy(F.asc_nulls_first("_k")).rowsBetween(Window.unboundedPreceding, 0)
    sums = [*[F.sum(x).over(one).alias(f"{x}_all") for x in "ghn"], *[F.sum(x).over(upto).alias(f"{x}_with") for x in "ghn"]]
    lost = [F.coalesce(F.sum(F.when(F.col("_k").isNull(), F.col(x))).over(one), F.lit(0)).alias(f"{x}_lost") for x in "ghn"]
    rows = counts.select("*", *sums, *lost)

    def side(left: bool) -> Column:
        g, h, n = (F.col(f"{x}_with") - (F.lit(0) if left else F.col(f"{x}_lost")) for x in "ghn")
        return F.struct(
            F.lit(left).alias("missing_left"), (g * UNIT).alias("gl"), (h * UNIT).alias("hl"), n.alias("nl"),
            ((F.col("g_all") - g) * UNIT).alias("gr"), ((F.col("h_all") - h) * UNIT).alias("hr"), (F.col("n_all") - n).alias("nr"),
        )

    both = F.explode(F.array(side(False), side(True)))
    rows = rows.select("_node", "_f", "_k", (F.col("g_all") * UNIT).alias("g"), (F.col("h_all") * UNIT).alias("h"), "n_all", both.alias("s"))
    rows = rows.select("_node", "_f", "_k", "g", "h", "n_all", "s.*")

    def part(g: str, h: str) -> Column:
        return F.col(g) * F.col(g) / (F.col(h) + l2)

    fair = F.col("_k").isNotNull() & (F.col("nl") > 0) & (F.col("nr") > 0) & (F.least("hl", "hr") >= child_weight)
    rows = rows.withColumn("gain", F.when(fair, part("gl", "hl") + part("gr", "hr") - part("g", "h")))
    order = F.struct("gain", (-F.col("_f")).alias("f"), (-F.col("_k")).alias("k"), (~F.col("missing_left")).alias("r"))
    kept = F.struct("_f", "_k", "missing_left", "gain", "gl", "hl", "nl", "gr", "hr", "nr")
    return rows.groupBy("_node").agg(
        F.max("g").alias("g"), F.max("h").alias("h"), F.max("n_all").alias("n"),
        F.max_by(F.when(F.col("gain").isNotNull(), kept), F.when(F.col("gain").isNotNull(), order)).alias("cut"),
    )


@dataclass
class BoostedTrees:
    features: list[str]
    nodes: list[Node]
    step: float

    def node_table(self, spark: SparkSession) -> DataFrame:
        """One row per node; gains and weights as fitted, a leaf's weight already times the step."""
        rows = [(n.tree, n.node, n.feature, n.cut, n.missing_left, n.gain, n.cover, n.n_rows, n.weight) for n in self.nodes]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    def margin(self) -> str:
        """SQL text of the summed leaf weights over the array column `_x`."""
        at = {c: i for i, c in enumerate(self.features)}
        grown: dict[int, dict[int, Node]] = {}
        for n in self.nodes:
            grown.setdefault(n.tree, {})[n.node] = n
        trees = [_route(tree, 0, at, "_x", False, _leaf_weight) for tree in grown.values()]
        return f"aggregate(array({', '.join(trees)}), 0D, (a, x) -> a + x)" if trees else "0D"

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Rows with the probability of the positive class; features need no filling."""
        rows = df.withColumn("_x", F.array(*_values(self.features)))
        return rows.withColumn(out, 1.0 / (1.0 + F.exp(-F.expr(self.margin())))).drop("_x")

    __call__ = score


def fit_boosted(
    df: DataFrame, features: Sequence[str], label: str, ids: Sequence[str] = (), trees: int = 400, depth: int = 5,
    step: float = 0.05, subsample: float = 0.8, columns: float = 0.8, l2: float = 1.0, least_gain: float = 0.0,
    child_weight: float = 8.0, bins: int = 256, pos_weight: float = 1.0, seed: int = 42,
    cuts: Mapping[str, Sequence[float]] | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None,
) -> BoostedTrees:
    """Trees on features with gaps; rows without a label take no part.

    `ids` name the rows for subsampling: a row is in a tree by a hash of seed, tree and ids, so a task that runs again
    sees the same rows.  `pos_weight` weighs positives.  `store(table, name)` keeps the binned rows and, every few
    trees, their margins; without it they are computed again for each level.
    """
    if subsample < 1 and not ids:
        raise ValueError("subsampling needs ids")
    if trees < 1 or depth < 1:
        raise ValueError("trees and depth start at 1")
    features, spark = list(features), df.sparkSession
    cuts = {c: sorted(cuts[c]) for c in features} if cuts is not None else quantile_cuts(df, features, bins)
    at = {c: i for i, c in enumerate(features)}
    y = F.col(f"`{label}`").cast("double")
    rows = binned(df.filter(y.isNotNull()), features, cuts)
    rows = rows.select("_b", y.alias("_y"), F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in ids]).alias("_id"), F.lit(0.0).alias("_m"))
    rows = store(rows, "binned") if store else rows
    nodes: list[Node] = []
    pending: list[str] = []
    for tree in range(trees):
        if store and len(pending) >= STORE_EVERY:
            rows, pending = store(_moved(rows, pending), f"margins{tree // STORE_EVERY % 2}"), []
        p = 1.0 / (1.0 + F.exp(-F.col("_m")))
        weight = F.when(F.col("_y") == 1, F.lit(float(pos_weight))).otherwise(1.0)
        steep = _moved(rows, pending).select(
            "_b", "_id", F.round(weight * (p - F.col("_y")) / UNIT).cast("long").alias("_g"),
            F.round(weight * F.greatest(p * (1.0 - p), F.lit(1e-16)) / UNIT).cast("long").alias("_h"),
        )
        if subsample < 1:
            drawn = F.pmod(F.xxhash64(F.lit(tree), "_id"), F.lit(1_000_000))
            steep = steep.filter(drawn < round(subsample * 1_000_000))
        grown = _grow(steep, tree, features, at, cuts, sampled_features(features, columns, tree, seed, spark), depth, step, l2, least_gain, child_weight)
        if not grown:
            break  # no rows
        nodes += grown.values()
        pending.append(_route(grown, 0, at, "_b", True, _leaf_weight))
    return BoostedTrees(features, nodes, step)


def _moved(rows: DataFrame, pending: Sequence[str]) -> DataFrame:
    """Rows whose margins include the trees grown since they were stored."""
    if not pending:
        return rows
    return rows.withColumn("_m", F.expr(f"aggregate(array({', '.join(pending)}), _m, (a, x) -> a + x)"))


def _grow(rows: DataFrame, tree: int, features, at, cuts, picked, depth: int, step: float, l2: float, least_gain: float, child_weight: float):
    """One tree, level by level; nodes by number."""
    grown: dict[int, Node] = {}
    sides: dict[int, tuple[float, float, int]] = {}

    def leaf(i: int, g: float, h: float, n: int) -> Node:
        return Node(tree, i, None, None, None, 0.0, h, n, -g / (h + l2) * step)

    for level in range(depth):
        open_nodes = [0] if level == 0 else list(sides)
        if not open_nodes:
            break
        place = _route(grown, 0, at, "_b", True, lambda i, node: str(i) if node is None else "-1")
        here = rows.withColumn("_node", F.expr(place)).filter("_node >= 0")
        sides = {}
        for r in best_cuts(histogram(here, picked), l2, child_weight).collect():  # at most 2 ** level rows
            i, cut = r["_node"], r["cut"]
            if cut is None or cut["gain"] <= least_gain:
                grown[i] = leaf(i, r["g"], r["h"], r["n"])
                continue
            name = features[cut["_f"]]
            edge = [*cuts[name], math.inf][cut["_k"]]
            grown[i] = Node(tree, i, name, float(edge), cut["missing_left"], cut["gain"], r["h"], r["n"], 0.0, cut["_k"])
            sides[2 * i + 1] = (cut["gl"], cut["hl"], cut["nl"])
            sides[2 * i + 2] = (cut["gr"], cut["hr"], cut["nr"])
    for i, (g, h, n) in sides.items():
        grown[i] = leaf(i, g, h, n)
    return grown


def importances(nodes: DataFrame) -> DataFrame:
    """Per feature of a node table: splits (`weight`), mean and total gain, mean and total cover; features that never
    split have no row.  Sorted by gain; without any gain by splits, then cover."""
    used = nodes.filter(F.col("feature").isNotNull()).groupBy("feature").agg(
        F.avg("gain").alias("gain"), F.count(F.lit(1)).cast("double").alias("weight"), F.avg("cover").alias("cover"),
        F.sum("gain").alias("total_gain"), F.sum("cover").alias("total_cover"),
    )
    return used.orderBy(F.desc("gain"), F.desc("weight"), F.desc("cover"), "feature")

"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Units are groups of equal texts (by their 64-bit hash); a unit is never cut.  A unit has a weight (the bytes of all its
documents) and four dimensions: text size, language, source (as hash codes, so that equal names stay together) and the
text hash itself.  A node is cut along its widest dimension (weighted deviation relative to that of all units) at the
weighted median, or at the matching share for an odd number of leaves, until the wanted number of leaves is reached.

The median is found by distributed histograms: units are summed per (node, bin), the bin that holds the wanted weight
is opened again, until it is narrow.  Only one row per node reaches the driver; the order inside equal values of a
dimension is that of the text hash, so one huge language or source is cut as well.

Nulls: a null text weighs 1 byte and equals other null texts, null names are empty names.  Repeated rows are rows of
their own in the shard of their text.  An empty table gives an empty result.  A group of equal texts heavier than a
shard makes that shard larger, as groups are kept whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gapline.operators.blocks import block_rank

DIMENSIONS = ("d_size", "d_lang", "d_source", "d_hash")
HALF = 31
#: Bits of the order key that one histogram round resolves.
ROUND_BITS = 13
KEY_BITS = 63


def rows_of(docs: DataFrame) -> DataFrame:
    """The few columns that placing needs: texts are read once and left behind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1)
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col("text").isNull(), text).alias("text_hash"),
        code("lang").alias("lang"), code("source").alias("source"),
    )


def units_of(rows: DataFrame) -> DataFrame:
    code = F.shiftrightunsigned("text_hash", 33)
    return rows.groupBy("text_hash").agg(
        F.sum("size").alias("weight"), F.min("size").alias("d_size"), F.min("lang").alias("d_lang"), F.min("source").alias("d_source")
    ).withColumn("d_size", F.least("d_size", F.lit(2**HALF - 1))).withColumn("d_hash", code)


def _case(node: Column, values: dict, build) -> Column:
    out = None
    for n, v in values.items():
        out = F.when(node == n, build(v)) if out is None else out.when(node == n, build(v))
    return out


def _order_key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), 32).bitwiseOR(F.shiftrightunsigned("text_hash", 32))


def _spreads(units: DataFrame) -> dict[int, dict]:
    """Weight and weighted deviation of every dimension per node (one row per node)."""
    w, sums = F.col("weight").cast("double"), [F.sum("weight").alias("weight")]
    for d in DIMENSIONS:
        x = F.col(d) / float(2**HALF)
        sums += [F.sum(w * x).alias(f"{d}_1"), F.sum(w * x * x).alias(f"{d}_2")]
    out = {}
    for r in units.groupBy("node").agg(*sums).collect():
        spread = {d: math.sqrt(max(0.0, r[f"{d}_2"] / r["weight"] - (r[f"{d}_1"] / r["weight"]) ** 2)) for d in DIMENSIONS}
        out[r["node"]] = {"weight": r["weight"], "spread": spread}
    return out


def _cuts(units: DataFrame, nodes: dict[int, dict], tolerance: float) -> dict[int, int]:
    """Per node the largest order key of its left side."""
    state = {n: {"lo": 0, "before": 0, "want": x["weight"] * x["share"]} for n, x in nodes.items()}
    cuts: dict[int, int] = {}
    shift = KEY_BITS
    keyed = units.where(F.col("node").isin(list(nodes))).withColumn("key", _case(F.col("node"), {n: x["dimension"] for n, x in nodes.items()}, _order_key))
    while state and shift > 0:
        width, shift = shift, max(0, shift - ROUND_BITS)
        lo = _case(F.col("node"), {n: s["lo"] for n, s in state.items()}, lambda v: F.lit(v).cast("bigint"))
        part = keyed.where(F.col("node").isin(list(state))).withColumn("off", F.col("key") - lo)
        if width < KEY_BITS:
            part = part.where((F.col("off") >= 0) & (F.col("off") < F.lit(1 << width)))
        bins = part.groupBy("node", F.shiftright("off", shift).alias("bin")).agg(
            F.sum("weight").alias("w"), F.min("key").alias("least"), F.max("key").alias("most")
        )
        order = Window.partitionBy("node").orderBy("bin")
        want = _case(F.col("node"), {n: s["want"] - s["before"] for n, s in state.items()}, lambda v: F.lit(float(v)))
        last = Window.partitionBy("node")
        found = (
            bins.withColumn("upto", F.sum("w").over(order)).withColumn("want", want)
            .withColumn("end", F.max("bin").over(last))
            .where((F.col("upto") >= F.col("want")) | (F.col("bin") == F.col("end")))
            .groupBy("node").agg(F.min_by(F.struct("bin", "w", "upto", "least", "most"), "bin").alias("b"))
        )
        for r in found.collect():
            n, b, s = r["node"], r["b"], state[r["node"]]
            total = s["before"] + b["upto"]
            if b["least"] == b["most"] or b["w"] <= tolerance * nodes[n]["weight"] or shift == 0:
                inside = total - s["want"] <= s["want"] - (total - b["w"])
                cuts[n] = b["most"] if inside else b["least"] - 1
                del state[n]
            else:
                s["lo"], s["before"] = s["lo"] + (b["bin"] << shift), total - b["w"]
    return cuts


def tree(units: DataFrame, leaves: int, tolerance: float = 2e-4) -> Column:
    """The shard of a unit as one expression over its dimensions: `leaves` - 1 comparisons in a tree."""
    shape = {0: (0, leaves)}  # node: first leaf, number of leaves
    path: dict[int, tuple[str, int, int, int]] = {}
    whole, node = None, F.lit(0)
    while any(n > 1 for _, n in shape.values()):
        placed = units.withColumn("node", node)
        spreads = _spreads(placed)
        whole = whole or spreads.get(0)
        nodes = {}
        for n, (_, count) in shape.items():
            if count > 1 and n in spreads:
                wide = lambda d: spreads[n]["spread"][d] / whole["spread"][d] if whole["spread"][d] else 0.0
                nodes[n] = {"weight": spreads[n]["weight"], "share": (count // 2) / count, "dimension": max(DIMENSIONS, key=wide)}
        cuts = _cuts(placed, nodes, tolerance) if nodes else {}
        grown = {}
        for n, (first, count) in shape.items():
            if count == 1:
                grown[n] = (first, 1)
            else:
                left, right = 2 * n + 1, 2 * n + 2
                path[n] = (nodes[n]["dimension"], cuts[n], left, right) if n in cuts else (DIMENSIONS[0], 2**KEY_BITS - 1, left, right)
                grown[left], grown[right] = (first, count // 2), (first + count // 2, count - count // 2)
        shape, node = grown, _descend(path, 0, lambda n: F.lit(n))
    return _descend(path, 0, lambda n: F.lit(shape[n][0])) if path else F.lit(0)


def _descend(path: dict, n: int, leaf) -> Column:
    if n not in path:
        return leaf(n)
    dimension, cut, left, right = path[n]
    return F.when(_order_key(dimension) <= F.lit(cut).cast("bigint"), _descend(path, left, leaf)).otherwise(_descend(path, right, leaf))


def shard(steps, docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, block_rows: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row.  Give the number of leaves, or their target bytes."""
    rows = steps.store(rows_of(docs))
    units = steps.store(units_of(rows))
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, math.ceil(total / target_bytes))
    placed = units.select("text_hash", tree(units, leaves).cast("int").alias("shard"))
    found = rows.join(placed, "text_hash")
    blocks = rows.count() // (leaves * block_rows) + 1
    found = found.withColumn("_block", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(blocks)))
    ranked = block_rank(found, ["shard"], "_block", ["doc_id", "text_hash"], "_rank")
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).cast("bigint").alias("slot"))

"""Merkle manifest of a table: one tree per group, one tree over the groups' roots, a proof for every row.

A leaf is the sha256 of a row's fields.  In each group the leaves ascend by their key; `arity` consecutive nodes (the last
run may hold fewer, even one) become their hash until one node remains, the group's subroot.  Subroots, ordered by group
(null first), make the root in the same way.  All hash inputs are lower-case hex digests, concatenated.

Method: rows of a group are numbered, and cut into aligned chunks of `arity ** LEVELS` positions, so a group of any size
is spread over tasks.  Inside a chunk every level is a pair of fixed-offset `lag` / `lead` columns over one window
specification: the row of a node's first leaf carries its digest, siblings lie whole steps before and after it, masked by
the node's slot in its run and by the number of nodes of the level.  First-child rows hash the parents; the other rows
take the siblings of the nodes above them from the last first-child row.  The digests left of the chunks are the next
round's nodes, and the rounds' paths are joined.  Rows move once to their range, once to their chunk.

Defined results.  Null fields hash as `-`.  Null keys come first in their group; rows with equal keys are ordered by their
leaf, and rows equal in all fields are interchangeable.  A null group is a group.  An empty table has no rows and no root.
Other columns are ignored.  Numbers hash as decimals; an increment never overflows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Levels of a tree that one round climbs.
LEVELS = 10


def field_text(field: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def group_text(group: Column) -> Column:
    """A group key without nulls in the same order: null first, then by UTF-8 bytes."""
    value = group.cast("string")
    return F.when(value.isNull(), "0").otherwise(F.concat(F.lit("1"), value))


def number(steps, leaves: DataFrame) -> DataFrame:
    """Add `pos` (from 0) and `n` per `g`, ascending by (key, digest); `leaves` is stored and holds `g`, `key`, `digest`, `row`.

    Rows are dealt by ranges of the whole order, so a hot group takes many tasks; places inside a range come from the
    sorted task, those before it from one count per (range, group).
    """
    order = ["g", "key", "digest", "row"]
    ranged = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("m", F.monotonically_increasing_id())
    ranged = steps.store(ranged.withColumn("range", F.shiftright("m", 33)))
    per = ranged.groupBy("g", "range").agg(F.min("m").alias("least"), F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "g", "range", (F.coalesce(F.sum("rows").over(w), F.lit(0)) - F.col("least")).alias("move"),
        F.sum("rows").over(Window.partitionBy("g")).alias("n"),
    )
    return ranged.join(per, ["g", "range"]).withColumn("pos", F.col("m") + F.col("move")).drop("range", "m", "move", "row")


def _div(a: Column | str, b: int) -> Column:
    """Whole quotient of two non-negative integers."""
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.lit(b))


def _round(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """`nodes` (g, pos, n, digest, others) with `chunk`, `path` (siblings per level) and `top` (the chunk's node)."""
    rows = nodes.withColumn("chunk", _div("pos", arity**levels)).withColumnRenamed("digest", "d0")
    w = Window.partitionBy("g", "chunk").orderBy("pos")
    kept = [c for c in rows.columns if c != "d0"]
    sides = range(1, arity)
    for k in range(levels):
        step, digest = arity**k, F.col(f"d{k}")
        node, count = _div("pos", step), _div(F.col("n") + (step - 1), step)
        slot = node % arity
        rows = rows.select(
            *rows.columns, *[F.lag(digest, j * step).over(w).alias(f"before{j}") for j in sides],
            *[F.lead(digest, j * step).over(w).alias(f"after{j}") for j in sides],
        )
        none = F.lit("")
        left = F.concat(*[F.when(slot >= j, F.col(f"before{j}")).otherwise(none) for j in reversed(sides)])
        right = F.concat(*[F.when((slot + j < arity) & (node + j < count), F.col(f"after{j}")).otherwise(none) for j in sides])
        parent = F.when(count > 1, F.sha2(F.concat(digest, right), 256)).otherwise(digest)
        siblings = F.struct(F.unhex(left).alias("left"), F.unhex(right).alias("right"))
        rows = rows.select(
            *kept, "d0", *[f"s{i}" for i in range(k)],
            F.when((F.col("pos") % step == 0) & (count > 1), siblings).alias(f"s{k}"),
            F.when(F.col("pos") % (step * arity) == 0, parent).alias(f"d{k + 1}"),
        )
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    path = F.filter(F.array(*[F.last(f"s{k}", ignorenulls=True).over(upto) for k in range(levels)]), lambda s: s.isNotNull())
    return rows.select(*kept, F.col("d0").alias("digest"), path.alias("path"), F.first(f"d{levels}").over(upto).alias("top"))


def climb(steps, nodes: DataFrame, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """Nodes (g, pos, n, digest, others) with `path`, the siblings from here to the top, and `top`, the group's last node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds = []
    while True:
        height = next(k for k in range(1, levels + 1) if k == levels or arity**k >= most)
        span = arity**height
        rounds.append(steps.store(_round(nodes, arity, height)))
        most = -(-most // span)
        if most <= 1:
            break
        firsts = rounds[-1].where(F.col("pos") % span == 0)
        nodes = firsts.select("g", F.col("chunk").alias("pos"), _div(F.col("n") + (span - 1), span).alias("n"), F.col("top").alias("digest"))
    rows = rounds.pop()
    for below in reversed(rounds):
        up = rows.select("g", F.col("pos").alias("chunk"), F.col("path").alias("further"), F.col("top").alias("last"))
        joined = below.join(up, ["g", "chunk"])
        rows = joined.withColumns({"path": F.concat("path", "further"), "top": F.col("last")}).drop("further", "last")
    return rows.drop("chunk")


def manifest(steps, leaves: DataFrame, arity: int = 2, levels: int = LEVELS) -> DataFrame:
    """`leaves` (`group`, `key`, `leaf`, others in one column `extra`) with `subroot`, `root` and `path`.

    `path` lists the siblings of every level from the leaf to the root: the digests left and right of the own node, as
    bytes.  `fold` recomputes the root from a leaf with it.
    """
    made = leaves.select(
        group_text(F.col("group")).alias("g"), "key", F.col("leaf").alias("digest"), "extra", F.monotonically_increasing_id().alias("row")
    )
    rows = climb(steps, number(steps, steps.store(made)), arity, levels)
    rows = steps.store(rows.select("g", "key", "extra", F.col("digest").alias("leaf"), "path", F.col("top").alias("subroot")))
    groups = rows.groupBy("g").agg(F.first("subroot").alias("digest"))
    groups = groups.select(F.lit("").alias("g"), F.col("g").alias("key"), "digest", F.lit(0).alias("row"))
    over = climb(steps, number(steps, steps.store(groups)), arity, levels)
    over = over.select(F.col("key").alias("g"), F.col("path").alias("over"), F.col("top").alias("root"))
    return rows.join(over, "g").select("key", "extra", "leaf", "subroot", "root", F.concat("path", "over").alias("path"))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(_hex(s["left"]), node, _hex(s["right"])), 256))


def path_hash(path: Column) -> Column:
    """sha256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: _hex(F.concat(s["left"], s["right"]))), ""), 256)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of a documents table; `extra` is the leaf after one more on `n_chars`, where 7 divides the id's CRC-32."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = leaf_hash([more if f == "n_chars" else F.col(f) for f in fields])
    return docs.select(
        F.col("lang").alias("group"), F.col("doc_id").alias("key"), leaf_hash([F.col(f) for f in fields]).alias("leaf"),
        F.when(hit, tampered).alias("extra"),
    )


def audit(rows: DataFrame) -> DataFrame:
    """Every row of a manifest with its proof checked against the leaf in `extra`, or its own where that is null."""
    folded = fold(F.coalesce("extra", "leaf"), F.col("path"))
    out = rows.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", path_hash(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprint: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, three-word shingles with repeats (fewer words: the whole
sequence; none: fingerprint zero), XXH64 of each with seed 42; a bit is one if it is one in over half of them.

Linking, on distinct fingerprints only, so copies cost nothing:

1. Bit and bit-pair counts of all fingerprints (64 x 64 sums) give correlations.  For each number of partitions the
   most correlated bits are grouped, and the number of candidate pairs of a partition at each threshold is estimated
   from the chain of its pair counts.
2. Dynamic programming gives each partition its own threshold (-1: not used), so that the thresholds plus one add up to
   4, one more than the distance.  Then any two fingerprints at 3 or fewer bits agree within the threshold in at least
   one partition.  The cheapest plan by rows and candidates is used.
3. Each fingerprint goes into the bucket of its own value in each partition, and into the buckets of all larger values
   within the threshold.  Buckets are compared in sorted runs; every bucket gives a spanning forest of its links, never
   all its pairs.  Buckets over `HOT_ROWS` are cut again by 4 x 16 other bits, which loses no link.
4. Connected components of the links.

All fingerprints take part.  Nulls: a null text has no words; a null id is a document like any other, but never the
smallest of its component.  Repeated rows share their fingerprint and stay rows of their own.  An empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gapline.llm.common import add_struct, free_name, narrow_rows
from gapline.llm.graph import components

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Cost of one candidate pair in bucket rows, for the choice of a plan.
PAIR_COST = 0.05
#: Rows of a bucket that is cut again before it is compared.
HOT_ROWS = 20_000
#: Up to this size all pairs of a bucket are compared by shifted columns; above, by a search from node to node.
SMALL = 32
LOW = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """Signed 64-bit value of the fingerprint."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    width = min(SHINGLE, len(words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :])], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp: nothing of the texts leaves the scan but their hashes."""
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = add_struct(slim, "text", "s", "fp bigint", lambda texts: [[fingerprint(t) for t in texts]])
    return rows.select("doc_id", "text_hash", "s.fp")


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have both bits, for all 64 x 64 pairs of bits.

    Every task sums its own rows; the sums of the 4,096 pairs are what reaches the driver.
    """

    def run(batches):
        total = np.zeros((64, 64), dtype=np.int64)
        rows = 0
        for batch in batches:
            bits = np.unpackbits(
                batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
            ).astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            rows += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(4097), pa.int32()), pa.array([*total.reshape(-1).tolist(), rows], pa.int64())], ["pair", "n"]
        )

    sums = dict(fps.select("fp").mapInArrow(run, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect())
    return sums.get(4096, 0), np.array([sums.get(i, 0) for i in range(4096)], dtype=np.float64).reshape(64, 64)


def _group_bits(correlation: np.ndarray, parts: int) -> list[list[int]]:
    """Nearly equal groups; each takes the free bit that correlates most with it."""
    free, groups = list(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(free, key=lambda b: (correlation[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (correlation[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def make_plan(n: int, both: np.ndarray, most_parts: int = 8) -> Plan:
    n1 = np.diag(both)
    n = max(n, 1)
    p = np.clip(n1 / n, 1e-6, 1 - 1e-6)
    p11, p10 = both / n, (n1[:, None] - both) / n
    p01, p00 = p10.T, 1 - (n1[:, None] + n1[None, :] - both) / n
    agree = p**2 + (1 - p) ** 2
    agree_both = np.clip(p11**2 + p10**2 + p01**2 + p00**2, 1e-12, 1.0)
    spread = np.sqrt(p * (1 - p))
    correlation = np.abs(p11 - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 0.0)
    best = None
    for m in range(1, most_parts + 1):
        groups = _group_bits(correlation, m)
        costs = []
        for group in groups:
            equal = agree[group[0]]
            for a, b in zip(group, group[1:]):
                equal *= min(1.0, agree_both[a, b] / agree[a])
            odds = [(1 - agree[b]) / agree[b] for b in group]
            price = {-1: 0.0}
            pairs, layer = equal, [1.0] + [0.0] * DISTANCE  # elementary symmetric sums of the odds
            for o in odds:
                for k in range(DISTANCE, 0, -1):
                    layer[k] += layer[k - 1] * o
            for t in range(DISTANCE + 1):
                pairs = equal * sum(layer[: t + 1])
                rows = 1 + sum(math.comb(len(group), k) for k in range(1, t + 1)) / 2
                price[t] = n * rows + PAIR_COST * n * n / 2 * min(1.0, pairs)
            costs.append(price)
        table = {0: (0.0, ())}
        for price in costs:
            grown: dict[int, tuple[float, tuple]] = {}
            for used, (cost, chosen) in table.items():
                for t, c in price.items():
                    if used + t + 1 <= DISTANCE + 1:
                        new = (cost + c, (*chosen, t))
                        if used + t + 1 not in grown or new < grown[used + t + 1]:
                            grown[used + t + 1] = new
            table = grown
        cost, chosen = table[DISTANCE + 1]
        if best is None or cost < best.cost:
            best = Plan(tuple(map(tuple, groups)), chosen, cost)
    return best


def _value(fps: np.ndarray, bits) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _mix(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit bucket number. Two values in one bucket by accident cost a comparison, nothing else."""
    x = values + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _buckets(plan: Plan):
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint64)
            for part, (bits, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
                if t < 0:
                    continue
                own = _value(fps, bits)
                for k in range(t + 1):
                    for flipped in itertools.combinations(range(len(bits)), k):
                        value = own ^ np.uint64(sum(1 << f for f in flipped))
                        probes = value >= own if k == 0 else value > own
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(_mix(value[probes], part).view(np.int64)), pa.array(fps[probes].view(np.int64))], ["bucket", "fp"]
                        )

    return run


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _search(fps: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Components of one large bucket: the waiting values are compared with each newly reached one."""
    waiting, out = fps, []
    while len(waiting) > 1:
        root, waiting = waiting[0], waiting[1:]
        front = [np.array([root])]
        while front and len(waiting):
            reached = front.pop()
            for at in range(0, len(reached), 64):
                near = (_popcount(reached[at : at + 64, None] ^ waiting[None, :]) <= DISTANCE).any(axis=0)
                if near.any():
                    found, waiting = waiting[near], waiting[~near]
                    out.append((found, root))
                    front.append(found)
                if not len(waiting):
                    break
    return out


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside buckets; keys are sorted, and fps are sorted and distinct in each bucket."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    for shift in range(1, int(min(SMALL, sizes.max(initial=1)))):
        same = (keys[shift:] == keys[:-shift]) & small[shift:]
        at = np.flatnonzero(same)
        at = at[_popcount(fps[at] ^ fps[at + shift]) <= DISTANCE]
        left.append(fps[at + shift])
        right.append(fps[at])
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        for found, root in _search(fps[s : s + n]):
            left.append(found)
            right.append(np.full(len(found), root))
    if not left:
        return fps[:0], fps[:0]
    return np.concatenate(left), np.concatenate(right)


def _compare(batches):
    """Whole buckets of a sorted partition; the last one of a batch waits for the next batch."""
    empty = np.zeros(0, dtype=np.int64)
    keys, fps = empty, empty

    def links(k, f):
        keep = np.r_[True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])]
        a, b = bucket_links(k[keep], f[keep].view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False)])
        whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        if whole:
            yield links(keys[:whole], fps[:whole])
            keys, fps = keys[whole:], fps[whole:]
    if len(keys):
        yield links(keys, fps)


def _cut_again(batches):
    """Buckets by four other groups of 16 bits: two values within 3 bits agree in one of them."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(4):
            value = _value(fps, range(k, 64, 4))
            yield pa.RecordBatch.from_arrays(
                [pa.array(_mix(keys ^ _mix(value, 100 + k), 200 + k).view(np.int64)), pa.array(fps.view(np.int64))], ["bucket", "fp"]
            )


def links(steps, fps: DataFrame, plan: Plan | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within the distance. `fps` is stored."""
    plan = plan or make_plan(*bit_counts(fps))
    rows = steps.store(fps.select("fp").mapInArrow(_buckets(plan), "bucket bigint, fp bigint"))
    hot = rows.groupBy("bucket").count().where(F.col("count") > hot_rows).select("bucket")
    hot = steps.store(hot)
    cool = rows.join(hot, "bucket", "left_anti")
    again = rows.join(hot, "bucket", "left_semi").mapInArrow(_cut_again, "bucket bigint, fp bigint")
    dealt = cool.unionByName(again).repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInArrow(_compare, "a bigint, b bigint").distinct()


def near_duplicates(steps, docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, component_id for every row."""
    rows = steps.store(fingerprints(docs))
    distinct = steps.store(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    with narrow_rows(docs.sparkSession):
        found = components(steps, links(steps, distinct))
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    member = steps.store(member)
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(member.join(smallest, "root").select("fp", "component_id"), "fp")


def fingerprint_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def stage(steps, docs: DataFrame) -> DataFrame:
    """Columns of `docs`; of each component the row with the smallest (doc_id, text hash) stays, null ids last."""
    found = near_duplicates(steps, docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp")))
    # two hashes without nulls: the join and the removal of repeated rows share one shuffle of the texts
    its_id, its_hash = free_name(docs, "_id"), free_name(docs, "_hash")
    id_hash = lambda c: F.xxhash64(F.isnull(c), c)
    kept = found.groupBy(group.alias("g")).agg(F.min(key).alias("k")).select(
        id_hash(F.col("k.doc_id")).alias(its_id), F.col("k.text_hash").alias(its_hash)
    )
    rows = docs.withColumns({its_id: id_hash(F.col("doc_id")), its_hash: F.xxhash64("text")}).join(kept, [its_id, its_hash])
    return rows.dropDuplicates([its_id, its_hash]).select(*docs.columns)

"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`, distinct three-word shingles; fewer words: the whole
sequence as one shingle; none: empty and linked with nothing.  Documents link at a Jaccard similarity of 85 percent or
more, confirmed on the full sets.

1. One pass gives every document the digest of its set, its size and a signature of `PLACES` places: the lowest `BITS` bits
   of a min-hash each.  Equal sets are one node from here on, so exact copies cost nothing.
2. Two signatures within `DISTANCE` different places must agree in one of `CHUNKS` chunks up to `ERRORS` places, as
   CHUNKS * (ERRORS + 1) > DISTANCE.  The allowed errors are enumerated: a chunk gives one key for each choice of places
   left out.  Nodes that share a key are candidates; no pair within the distance is missed.  At a similarity of 0.85 a
   pair lies beyond the distance with probability 4e-6 (binomial tail).
3. Candidates are never all pairs of a bucket: a bucket gives a spanning forest of its nodes within the distance and of
   possible sizes, found by a search from node to node.  Large buckets are cut into blocks, and pairs of blocks are
   searched in tasks of their own.  The components of all forests are clusters, and every similar pair is inside one.
4. The full sets of clustered nodes are read again from one document each.  Every node meets the set of its cluster's
   pivot.  What is not linked to the pivot is compared with the whole cluster, again in pairs of bounded blocks that give
   spanning forests of confirmed links.  Their components are the result.

Shingles, sets and keys are 64-bit hashes.  Defined results: a null text is empty; documents without words are components
of their own; a null id takes part but is never the smallest of its component (a component of null ids has a null
component_id).  Repeated rows share their set.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gapline.llm.common import add_struct, narrow_rows, text_bytes
from gapline.llm.filters import bit_filter, passes
from gapline.llm.graph import components

SHINGLE = 3
#: Smallest similarity of a link, in percent.
PERCENT = 85
#: Places of a signature, bits of a place, and the largest number of places that two signatures of a pair may differ in.
PLACES, BITS, DISTANCE = 64, 16, 23
CHUNKS, ERRORS = 12, 1
#: Nodes of a bucket's block, and shingles of a cluster's block, that are compared at a time.
BUCKET, BLOCK = 2_048, 1 << 19
#: Distinct words that a task keeps.
CACHE = 500_000

_RANDOM = np.random.default_rng(20_24)
SEEDS = _RANDOM.integers(0, 1 << 32, PLACES, dtype=np.uint32)
FACTORS = _RANDOM.integers(0, 1 << 32, PLACES, dtype=np.uint32) | np.uint32(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes, words: dict) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    ids = np.fromiter(map(words.__getitem__, text.lower().split()), dtype=np.uint64)
    if not len(ids):
        return ids
    width = min(SHINGLE, len(ids))
    count = len(ids) - width + 1
    h = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        h = _mix(h + ids[k : k + count])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PLACES b-bit values for every non-empty set."""
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    low = np.concatenate(sets).astype(np.uint32)
    out = np.zeros((len(sets), PLACES), dtype=np.uint16)
    for k in range(PLACES):
        v = (low ^ SEEDS[k]) * FACTORS[k]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(v, starts) & np.uint32((1 << BITS) - 1)
    return out


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of id and text), n, node (digest of the set), sig: nothing of the texts leaves the scan but hashes."""
    words = None

    def compute(texts):
        nonlocal words
        words = _Words() if words is None else words
        sets = [shingle_hashes(t, words) for t in texts]
        full = [s for s in sets if len(s)]
        n = [len(s) for s in sets]
        node, sig = [0] * len(sets), [None] * len(sets)
        if full:
            starts = np.cumsum([0, *[len(s) for s in full[:-1]]])
            digest = _mix(np.add.reduceat(_mix(np.concatenate(full)), starts) + np.array([len(s) for s in full], dtype=np.uint64))
            rows = signatures(full)
            for at, d, r in zip((i for i, s in enumerate(sets) if len(s)), digest.view(np.int64).tolist(), rows):
                node[at], sig[at] = d, r.tobytes()
        return [n, node, sig]

    slim = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    rows = add_struct(slim, "text", "s", "n bigint, node bigint, sig binary", compute)
    return rows.select("doc_id", "row", "s.n", "s.node", "s.sig")


def _chunks() -> list[list[int]]:
    return [part.tolist() for part in np.array_split(np.arange(PLACES), CHUNKS)]


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), PLACES)


def _keys(batches):
    """(key, node): one key for every chunk and every choice of ERRORS places left out of it."""
    for batch in batches:
        node, sig = batch.column("node"), _matrix(batch.column("sig")).astype(np.uint64)
        for c, chunk in enumerate(_chunks()):
            for j, out in enumerate(itertools.combinations(chunk, ERRORS)):
                key = np.full(len(node), (c << 32) + j + 1, dtype=np.uint64)
                for place in chunk:
                    if place not in out:
                        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, place])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node], ["key", "node"])


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sets of these sizes can be similar enough."""
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def _near_forest(node: np.ndarray, n: np.ndarray, sig: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Spanning forest of one bucket: pairs within the distance and of possible sizes."""
    out, waiting = [], np.arange(len(node))
    while len(waiting) > 1:
        root, waiting = waiting[0], waiting[1:]
        front = [root]
        while front and len(waiting):
            u = front.pop()
            near = ((sig[waiting] != sig[u]).sum(axis=1) <= DISTANCE) & _sizes_fit(n[waiting], n[u])
            if near.any():
                found, waiting = waiting[near], waiting[~near]
                out.append((node[found], node[u]))
                front += found.tolist()
    return out


def _runs(batches, columns, work):
    """Call `work` with the arrays of each run of equal keys of a sorted partition; whole runs are held, they are bounded."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        key = table.column("key").to_numpy()
        if not len(key):
            continue
        whole = int(np.searchsorted(key, key[-1]))
        if whole:
            yield from work(table.slice(0, whole), key[:whole])
        held = table.slice(whole)
    if held is not None and len(held):
        yield from work(held, held.column("key").to_numpy())


def _edges(found: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    a = np.concatenate([f for f, _ in found]) if found else np.zeros(0, dtype=np.int64)
    b = np.concatenate([np.full(len(f), r, dtype=np.int64) for f, r in found]) if found else a
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _bucket_edges(batches):
    def work(table, key):
        node, n, sig = table.column("node").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("sig"))
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        found = []
        for s, e in zip(starts, [*starts[1:], len(key)]):
            if e - s == 2:
                if (sig[s] != sig[s + 1]).sum() <= DISTANCE and _sizes_fit(n[s], n[s + 1]):
                    found.append((node[s + 1 : e], node[s]))
            elif e - s > 2:
                found += _near_forest(node[s:e], n[s:e], sig[s:e])
        yield _edges(found)

    return _runs(batches, ("node", "n", "sig"), work)


def _cut(rows: DataFrame, blocks: str, node: str = "node") -> DataFrame:
    """Rows of a group of `blocks` blocks, once for every pair of blocks they belong to; `key` is salted with the pair."""
    own = F.pmod(F.xxhash64(node), F.col(blocks)).cast("int")
    pair = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)).alias("other")
    rows = rows.withColumn("own", own).select("*", pair)
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return rows.withColumn("key", F.when(F.col(blocks) > 1, cell).otherwise(F.col("key"))).drop("own", "other", blocks)


def cluster_edges(steps, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all nodes whose signatures are within the distance; `nodes` (node, n, sig) is stored."""
    keys = steps.store(nodes.select("node", "sig").mapInArrow(_keys, "key bigint, node bigint"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = shared.select("key", F.ceil(F.col("rows") / BUCKET).alias("blocks"))
    members = keys.join(shared, "key").join(nodes, "node").select("key", "node", "n", "sig", "blocks")
    dealt = _cut(members, "blocks").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(_bucket_edges, "a bigint, b bigint").distinct()


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (node, row, others) with `shingles`, the sorted hashes of the set."""
    bits = bit_filter(wanted, F.col("row"))

    def run(batches):
        words = _Words()
        for batch in batches:
            part = batch.filter(pa.array(passes(bits, batch.column("row").to_numpy())))
            sets = [shingle_hashes(t, words) for t in text_bytes(part.column("text"))]
            offsets = pa.array(np.cumsum([0, *[len(s) for s in sets]]), pa.int32())
            values = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))], ["row", "shingles"])

    slim = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text")
    return slim.mapInArrow(run, "row bigint, shingles array<bigint>").join(wanted, "row").dropDuplicates(["node"]).drop("row")


def _similar(inside: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inside >= PERCENT * (a + b - inside)


def link_forest(node: np.ndarray, sets: list[np.ndarray], linked: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Spanning forest of confirmed links; nodes that are `linked` belong together already."""
    size = np.array([len(s) for s in sets])
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(size)]
    seen = np.zeros(len(universe), dtype=np.int64)
    own = lambda i: flat[starts[i] : starts[i + 1]]

    def similar(u: int, others: np.ndarray) -> np.ndarray:
        fit = others[_sizes_fit(size[others], size[u])]
        if not len(fit):
            return fit
        seen[own(u)] = 1
        inside = np.add.reduceat(seen[np.concatenate([own(i) for i in fit])], np.r_[0, np.cumsum(size[fit])[:-1]])
        seen[own(u)] = 0
        return fit[_similar(inside, size[fit], size[u])]

    out = []
    front, waiting = np.flatnonzero(linked).tolist(), np.flatnonzero(~linked)
    while len(waiting):
        if not front:
            front, waiting = [waiting[0]], waiting[1:]
        elif len(front) > len(waiting):  # ask from the smaller side
            met, front = np.array(front), []
            for w in waiting:
                hit = similar(w, met)
                if len(hit):
                    out.append((node[[w]], node[hit[0]]))
                    front.append(w)
            waiting = np.setdiff1d(waiting, front)
            continue
        u = front.pop()
        found = similar(u, waiting)
        if len(found):
            out.append((node[found], node[u]))
            waiting = np.setdiff1d(waiting, found)
            front += found.tolist()
    return out


def _link_edges(batches):
    def work(table, key):
        node, linked = table.column("node").to_numpy(), table.column("linked").to_numpy()
        lists = table.column("shingles").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        found = []
        for s, e in zip(starts, [*starts[1:], len(key)]):
            if e - s > 1:
                found += link_forest(node[s:e], [flat[offsets[i] : offsets[i + 1]] for i in range(s, e)], linked[s:e])
        yield _edges(found)

    return _runs(batches, ("node", "linked", "shingles"), work)


def links(steps, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between nodes that connect all pairs at the similarity; `nodes` (node, n, sig, row) is stored."""
    with narrow_rows(docs.sparkSession, 4_096):
        clusters = components(steps, cluster_edges(steps, nodes.select("node", "n", "sig")))
        wanted = steps.store(nodes.select("node", "n", "row").join(clusters, "node"))
    sets = steps.store(full_sets(docs, wanted))
    pivot = sets.where(F.col("node") == F.col("root")).select("root", F.col("n").alias("pn"), F.col("shingles").alias("ps"))
    inside = F.size(F.array_intersect("shingles", "ps"))
    linked = 100 * inside >= PERCENT * (F.col("n") + F.col("pn") - inside)
    star = steps.store(sets.select("root", "node", "n", "shingles").join(pivot, "root").select("root", "node", linked.alias("linked")))
    rest = sets.join(star.where(~F.col("linked")).select("root").distinct(), "root", "left_semi").join(star.select("node", "linked"), "node")
    sizes = rest.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    cells = rest.join(sizes, "root").select(F.col("root").alias("key"), "node", "linked", "shingles", "blocks")
    dealt = _cut(cells, "blocks").repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_link_edges, "a bigint, b bigint")
    return found.unionByName(star.where(F.col("linked") & (F.col("node") != F.col("root"))).select(F.col("node").alias("a"), F.col("root").alias("b")))


def near_duplicates(steps, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node and component_id for every row."""
    rows = steps.store(measured(docs))
    nodes = rows.where("n > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("row").alias("row")
    )
    nodes = steps.store(nodes)
    edges = steps.store(links(steps, docs, nodes.drop("least")))
    with narrow_rows(docs.sparkSession):
        found = components(steps, edges)
    member = nodes.join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    member = steps.store(member)
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    of = member.join(smallest, "root").select("node", "component_id")
    full = rows.where("n > 0").join(of, "node").select("doc_id", F.col("n").alias("n_shingles"), "node", "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("node"), F.col("doc_id").alias("component_id"))
    return full.unionByName(none)

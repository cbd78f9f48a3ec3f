"""Merkle manifests, phrases and MinHash links against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapline.llm import filters, merkle, minhash, phrases
from gapline.llm.common import Steps, prepare


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


# --- merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes, arity):
    """Last node and, per leaf, the siblings of every level as (left, right)."""
    paths, place, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for leaf, at in enumerate(place):
            run = level[at // arity * arity : at // arity * arity + arity]
            paths[leaf].append(("".join(run[: at % arity]), "".join(run[at % arity + 1 :])))
        place = [at // arity for at in place]
        level = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)]
    return level[0], paths


@pytest.mark.parametrize("arity,levels", [(2, 10), (2, 2), (3, 2)])
def test_manifest_equals_plain_trees(spark, arity, levels):
    rng = random.Random(arity)
    sizes = {None: 1, "": 2, "a": 29, "b": 64, "\u00e9": 3}
    rows = [(g, k if rng.random() > 0.1 else None, sha(f"{g}{k}")) for g, n in sizes.items() for k in rng.sample(range(1000), n)]
    rows += [("a", 5, sha("same")), ("a", 5, sha("same")), ("a", 5, sha("other"))]
    df = spark.createDataFrame(rows, "group string, key long, leaf string").withColumn("extra", F.lit(None).cast("string"))
    got = merkle.manifest(Steps(spark), df, arity, levels)
    got = got.select("key", "leaf", "subroot", "root", merkle.path_hash(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    trees, want = {}, []
    for g in sorted(sizes, key=lambda g: (g is not None, (g or "").encode())):
        leaves = sorted(((k is not None, k or 0, leaf) for gg, k, leaf in rows if gg == g))
        trees[g] = ([(k if known else None, leaf) for known, k, leaf in leaves], *climb([leaf for _, _, leaf in leaves], arity))
    root, over = climb([t[1] for t in trees.values()], arity)
    for (leaves, subroot, paths), above in zip(trees.values(), over):
        want += [(k, leaf, subroot, root, sha("".join(a + b for a, b in path + above)), root) for (k, leaf), path in zip(leaves, paths)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_tampering_is_found_only_where_it_is(spark):
    docs = spark.createDataFrame([(i, "s", "en", i if i % 9 else None, f"text {i}") for i in range(200)] + [(201, None, None, 2**63 - 1, None)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.audit(merkle.manifest(Steps(spark), merkle.document_leaves(docs))).collect()
    import zlib

    for r in rows:
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and (r.doc_id % 9 != 0 or r.doc_id == 201)
        assert r.verified == (not hit) and (r.folded_root == r.root) == r.verified
    assert {r.verified for r in rows} == {True, False}


# --- phrases


def brute_phrases(rows, least, top, share=80, most=4):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, most + 1):
                own.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, own in counts.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * f >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f in cand.items()):
                continue
            score, k = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("top,of_round,batch", [(10_000, 4_000, 100_000), (25, 40, 60)])
def test_phrases_equal_brute_force(spark, top, of_round, batch):
    rng = random.Random(top)
    words = ["a", "b", "c", "d", "\u00e9", "B", "=", "x%", "of", "the"]
    fixed = ["new york city hall", "as well as", "a b a b a b"]
    rows = []
    for i in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(0, 25))]
        rows.append(("".join(p + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", " ! "]) for p in parts), rng.choice(["en", "de", None, "und"])))
    rows += [(None, "en"), ("", "fr"), ("...", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = phrases.mine(Steps(spark), df, least=4, top=top, of_round=of_round, batch_rows=batch).collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, 4, top)


def test_ratio_beyond_64_bits(spark):
    big = 3_000_000_000_000_000_000
    row = spark.range(1).select(phrases._ratio(F.lit(big), F.lit(big), F.lit(big + 1)).alias("x")).first()
    assert row.x == 2_000_000 * big // (2 * big + 1)


def test_word_slices_lose_nothing(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 7)
    text = b"one two,three  " + b"x" * 40 + b". four"
    assert [t for s in phrases._slices(text) for t in phrases.TOKEN.findall(s)] == phrases.TOKEN.findall(text)


def test_filter_keeps_what_was_put_in(spark):
    values = [random.Random(1).getrandbits(64) - 2**63 for _ in range(500)]
    bits = filters.bit_filter(spark.createDataFrame([(v,) for v in values], "v long"), F.col("v"))
    others = np.array([random.Random(2).getrandbits(63) for _ in range(1)] + list(range(1000)), dtype=np.int64)
    assert filters.passes(bits, np.array(values, dtype=np.int64)).all() and filters.passes(bits, others).mean() < 0.01


# --- minhash


def brute_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    return out


def brute_components(texts):
    sets = brute_sets(texts)
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 85 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def variants(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("bucket,block", [(2_048, 1 << 19), (8, 2_000)])
def test_links_equal_brute_force(spark, monkeypatch, bucket, block):
    """A group around the limit (many pairs just below it), chains, copies, short texts; also with blocks cut small."""
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(bucket)
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "a b c d", "a b c d", "x y z x y z", "x y z"]
    for _ in range(3):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.randint(90, 160))]
        texts += [" ".join(base)] * 4 + list(variants(rng, base, 40, (1, 5)))
    step = [f"c{i}" for i in range(80)]
    for i in range(12):  # a chain: neighbours link, ends do not
        texts.append(" ".join(step))
        step[i * 6] = f"n{i}"
    texts += [" ".join(rng.choice(["of", "the", "and", "to"]) for _ in range(50)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(Steps(spark), df).collect())
    roots, sizes = brute_components(texts)
    assert got == [(i, n, r) for i, (n, r) in enumerate(zip(sizes, roots))]
    assert len(set(roots)) < len(roots) - 60


def test_pairs_within_the_distance_share_a_key():
    """The pigeonhole guarantee at the largest distance, wherever the differing places are."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    for _ in range(60):
        a = rng.integers(0, 1 << 16, minhash.PLACES).astype(np.uint16)
        b = a.copy()
        b[rng.choice(minhash.PLACES, minhash.DISTANCE, replace=False)] += 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([a.tobytes(), b.tobytes()])], ["node", "sig"])
        keys = [r.column("key").to_pylist() for r in minhash._keys([batch])]
        assert any(x == y for x, y in keys)
    assert minhash.CHUNKS * (minhash.ERRORS + 1) > minhash.DISTANCE


def test_forests_connect_what_all_pairs_connect():
    rng = random.Random(4)
    base = rng.sample(range(10**6), 200)
    sets = []
    for _ in range(60):
        own = set(base)
        for x in rng.sample(base, rng.randint(0, 30)):
            own.remove(x)
            own.add(rng.randrange(10**6, 10**9))
        sets.append(np.array(sorted(own), dtype=np.int64))
    node = np.arange(60) + 100
    for linked in (np.zeros(60, dtype=bool), np.arange(60) < 45):
        edges = [(int(a), int(r)) for found, r in minhash.link_forest(node, sets, linked) for a in found]
        want = [(i, j) for i, j in itertools.combinations(range(60), 2) if 100 * (both := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (400 - both)]
        known = [(i, int(np.flatnonzero(linked)[0])) for i in np.flatnonzero(linked)]

        def parts(pairs):
            root = list(range(60))
            for a, b in [*pairs, *known]:
                ra, rb = root[a], root[b]
                root = [ra if x == rb else x for x in root]
            return {frozenset(i for i in range(60) if root[i] == r) for r in set(root)}

        assert parts([(a - 100, b - 100) for a, b in edges]) == parts(want)
        assert len(edges) < 60

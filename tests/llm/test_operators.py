"""Operators against brute force, exact round trips and planted cases."""

import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
import tokenizers
import xxhash
from pyspark.sql import functions as F

from gapline.llm import chat, decontaminate, graph, line_dedup, quality, secret_scan, sentencepiece_bridge, sharding, simhash, substring_dedup, token_files
from gapline.llm.common import Steps, prepare
from tests.llm import tables

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module", autouse=True)
def ready(spark):
    prepare(spark)


def docs_of(spark, texts, **extra):
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def groups(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in graph.components(Steps(spark), df).collect()}
    want = groups(edges, {x for e in edges if e[0] != e[1] for x in e})
    assert got == want


# --- chat


def test_chat_round_trip_of_hard_texts(spark):
    parts = ["", "<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\\\/INST]", "%0A", "%", "\n", "x"]
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["user", "assistant", "system", "".join(rng.choices(parts, k=2))])
            rows.append((conv, turn, role, "".join(rng.choices(parts, k=rng.randint(0, 6)))))
    done = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in done.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("back")).collect():
        own = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [(b.role, b.text) for b in r.back] == own
        inside = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        undo = [re.sub(r"\[\\(\\*/?INST\])", r"[\1", re.sub(r"<\\(\\*/?s>)", r"<\1", t)) for t in inside]
        assert undo == [t for role, t in own if role == "assistant"]
        assert not any(re.search(chat.CONTROL, t) for t in inside)


# --- secrets


def test_secret_spans_and_owners(spark):
    texts = ["é token=abcdef1234567890 x", "api-key: no, apikey:'k9k9k9'", "AKIA" + "A1" * 8 + " and ABCDEF1234567890abcd", "token=shared12345678901234"] + ["say shared12345678901234"] * 5
    rows = secret_scan.per_document(secret_scan.scan(Steps(spark), docs_of(spark, texts))).orderBy("doc_id").collect()
    assert rows[0].spans == "assign:2:24,owned:8:24"
    assert rows[1].spans == "assign:13:27" or rows[1].n_assign == 1
    assert rows[2].n_access == 1 and "owned:25:45" in rows[2].spans
    assert rows[3].spans == "assign:0:26" and all(r.spans == "" for r in rows[4:])  # widely copied: under three owners


# --- sharding


@pytest.mark.parametrize("leaves", [1, 3, 16])
def test_shards_are_gapless_near_equal_and_keep_groups(spark, leaves):
    rng = random.Random(1)
    texts = ["x" * rng.randint(1, 400) for _ in range(900)] + ["copy of this"] * 60 + [None] * 3
    rows = sharding.shard(Steps(spark), docs_of(spark, texts), leaves=leaves, block_rows=20).collect()
    assert len(rows) == len(texts)
    sizes = {}
    for s in range(leaves):
        own = sorted(r.slot for r in rows if r.shard == s)
        assert own == list(range(len(own)))
        sizes[s] = sum(r["size"] for r in rows if r.shard == s)
    assert max(sizes.values()) - min(sizes.values()) <= 0.25 * sum(sizes.values()) / leaves + 800
    assert len({r.shard for r in rows if r.text_crc32 == rows[900].text_crc32}) == 1 or leaves > 1
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(v) == 1 for v in by_text.values())


def test_target_bytes_gives_the_number_of_leaves(spark):
    rows = sharding.shard(Steps(spark), docs_of(spark, ["a" * 99] * 40 + [f"{i:099d}" for i in range(60)]), target_bytes=2500)
    assert {r.shard for r in rows.select("shard").distinct().collect()} == {0, 1, 2, 3}


# --- simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ["", "One", "A b", "É ü x Ä", "a b c d e a b c " * 9, " \x0b\x1f z "]:
        assert simhash.fingerprint(text.encode()) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("thresholds", [None, (1, 1), (3,), (2, 0), (0, 0, 0, 0), (1, 0, 0), (2, 0, -1)])
@pytest.mark.parametrize("hot_rows", [20_000, 5])
def test_links_connect_what_brute_force_connects(spark, thresholds, hot_rows):
    rng = random.Random(7)
    centre = rng.getrandbits(64)
    near = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    values = {rng.getrandbits(64) for _ in range(60)} | {near(centre, rng.randint(0, 3)) for _ in range(150)}
    values |= {near(v, rng.randint(1, 4)) for v in list(values)[:60]}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    plan = None
    if thresholds:
        cuts = np.array_split(np.random.default_rng(0).permutation(64), len(thresholds))
        plan = simhash.Plan(tuple(tuple(int(b) for b in c) for c in cuts), thresholds, 0.0)
    if thresholds == (3,):
        values = values[:40]
        fps = spark.createDataFrame([(v,) for v in values], "fp long")
    got = groups([(r.a, r.b) for r in simhash.links(Steps(spark), fps, plan, hot_rows).collect()], values)
    want = groups([(a, b) for a, b in itertools.combinations(values, 2) if ((a ^ b) % (1 << 64)).bit_count() <= 3], values)
    assert got == want


def test_plan_thresholds_follow_the_principle():
    for n in (10, 10**5, 10**8, 10**11):
        plan = simhash.make_plan(n, np.full((64, 64), n / 4) + np.eye(64) * n / 4)
        assert sum(t + 1 for t in plan.thresholds) == 4
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
    assert max(simhash.make_plan(10**11, np.full((64, 64), 10**11 / 4) + np.eye(64) * 10**11 / 4).thresholds) >= 1


def test_simhash_stage_keeps_one_of_each_component(spark):
    docs = docs_of(spark, ["the same text is here"] * 5 + ["something else entirely here", None, ""])
    kept = simhash.stage(Steps(spark), docs.union(docs)).collect()
    assert sorted(r.doc_id for r in kept) == [0, 5, 6]


# --- line dedup


def brute_lines(texts):
    seen, out = set(), []
    for t in texts:
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.split() for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_windows_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", "b", "", "c c", " "]) for _ in range(rng.randint(0, 14))) for _ in range(60)]
    rows = line_dedup.dedup_lines(Steps(spark), docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == brute_lines(texts)


# --- decontamination


def brute_hits(words, items, window):
    hit, names = set(), set()
    for name, item in items:
        size = min(window, len(item))
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)} if item else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                names.add(name)
    return hit, names


def test_automaton_against_brute_force():
    rng = random.Random(4)
    for trial in range(120):
        letters = [bytes([97 + k]) for k in range(rng.randint(1, 3))]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(0, 9))]) for i in range(rng.randint(0, 5))]
        automaton = decontaminate.Automaton(items, 4)
        words = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 40))]
        spans, names = automaton.hits(words)
        hit, want = brute_hits(words, items, 4)
        assert {p for s, e in spans for p in range(s, e)} == hit and names == want
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_several_automata_give_the_same_marks(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))) for i in range(12)], "item_id long, text string")
    docs = docs_of(spark, [" ".join(rng.choice("abcd") for _ in range(80)) for _ in range(15)] + [None, ""])
    one = decontaminate.mark(docs, items, Steps(spark)).select("doc_id", "found").collect()
    many = decontaminate.mark(docs, items, Steps(spark), block_words=25).select("doc_id", "found").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_cut_takes_the_passage_out(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = docs_of(spark, [f"Before, {item.upper()}. After!", "clean text", f"{item} " + "x " * 2000])
    texts = [r.text for r in decontaminate.cut(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).orderBy("doc_id").collect()]
    assert texts[:2] == ["Before, . After!", "clean text"] and texts[2].startswith("b0")


# --- quality


def test_counts_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "#", "\x0b", "日"]) for _ in range(rng.randint(0, 80)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(lines)]
        assert [c[0] for c in quality.counts([text.encode()])] == want


def test_binomial_tail():
    for k, n, p in [(0, 1, 0.5), (3, 50, 0.1), (0, 400, 0.004), (40, 100, 0.3), (100, 100, 0.2), (7, 900, 0.004)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(9)
    rows, labels, m = [], [], {}
    for i in range(3000):
        good = int(rng.random() < 0.8)
        symbols = rng.randint(0, 3) if good else rng.randint(0, 120)
        m[i] = (good, symbols)
        rows.append((i, "en" if i % 3 else "de", (100, 500, symbols, 0, 0, 10)))
        labels.append((i, good, 0))
    schema = f"doc_id long, stratum string, m struct<{', '.join(f'{x.split()[0]}: bigint' for x in quality.FIELDS.split(', '))}>"
    got = {r.stratum: r for r in quality.cutoffs(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality long, toxic long"), alpha=0.1).collect() if r.rule == "symbols"}
    for stratum in ("en", "de"):
        own = [m[i] for i, s, _ in rows if s == stratum]
        goods, bads = [s / 100 for g, s in own if g], [s / 100 for g, s in own if not g]
        best, pairs = None, 10
        for j in range(quality.BINS - 1, -1, -1):
            c = j * 0.02
            k = sum(x > c for x in goods)
            if quality.binomial_tail(k, len(goods), 0.1 / len(quality.RULES)) > 0.05 / pairs:
                break
            gain = sum(x > c for x in bads) / len(bads) - k / len(goods)
            if best is None or gain > best[0]:
                best = (gain, c, k)
        assert (got[stratum].cutoff, got[stratum].good_rejected) == (pytest.approx(best[1]), best[2])
        assert got[stratum].good_rejected / len(goods) <= 0.1


def test_repeats_of_a_label_count_once(spark):
    rows = [(i, "en", (100, 500, i % 3 if i < 200 else 90, 0, 0, 10)) for i in range(250)]
    schema = f"doc_id long, stratum string, m struct<{', '.join(f'{x.split()[0]}: bigint' for x in quality.FIELDS.split(', '))}>"
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(250)], "doc_id long, quality long, toxic long")
    chosen = [quality.cutoffs(spark.createDataFrame(rows * n, schema), labels, alpha=a).orderBy("rule").collect() for a in (0.02, 0.3) for n in (1, 20)]
    assert chosen[0] == chosen[1] == []
    assert chosen[2] == chosen[3] and chosen[2] and chosen[2][0].n_good == 200


# --- token files


ODD = [
    "", "  a  b   c\n\n d \t e", "x\n  y", " ", "\n", "\n\n", "a\n", "  b　 c", "it's 'twas  the\r\nend. <|endoftext|> ok", "日本 語\n 中 😀",
    "a \n b", "tab\tx", "  \n\n  x  \n ", "é  è\n", "<s> </s> <unk> <0x0A>", "▁a ▁▁ b", "\x00a\n\x00 b", "\n a", "a \n", "\x1c x\x85 y", "aaa aaaaaa aaaaaaaaaaa",
]


def test_stretches_give_the_ids_of_whole_texts():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.by_stretch
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choice([" ", "\n", "a", "'s", "é", "1", ".", "\t", "\xa0"]) for _ in range(20)) for _ in range(300)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_files_come_back(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = token_files.Encoder(path), tokenizers.Tokenizer.from_file(path)
    rows = [(7, "seven"), (3, "three is here"), (None, "none"), (5, None), (5, "again five"), (5, "again five"), (9, tables.LONG), (11, "x <|endoftext|> y")] + [(100 + i, f"text number {i} " * 20) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = Steps(spark).folder + "/tokens"
    token_files.write(spark, docs, folder, path, end_id=0)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, text in ordered:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert encoder.tokenizer.encode("x <|endoftext|> y", add_special_tokens=False).ids == np.frombuffer(encoder.encode(["x <|endoftext|> y"])[0], "<u2").tolist()
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_index(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    few = {r.doc_id: r.ids for r in token_files.read_documents(spark, folder, [9, 120, 4]).collect()}
    assert set(few) == {9, 120}
    assert few[120] == encoder.tokenizer.encode("text number 20 " * 20, add_special_tokens=False).ids + [0]
    dictionary, digest, _ = token_files.load_dictionary(spark, folder)
    assert dictionary and {r.d for r in spark.read.parquet(f"{folder}/blocks").selectExpr("dictionary_sha256 d").distinct().collect()} == {digest}


# --- sentencepiece


def test_bridge_equals_the_original_model():
    bridge = sentencepiece_bridge.Bridge(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(12)
    texts = ODD + ["".join(rng.choice([" ", "\n", "ab", "the", "é", "1", ".", "\t", "日"]) for _ in range(20)) for _ in range(200)]
    encoded = bridge.encode(texts)
    for text, (ids, differing, whole), back in zip(texts, encoded, bridge.decode([i for i, *_ in encoded]), strict=True):
        assert ids.tolist() == bridge.original.encode(text) and differing == 0 and whole, repr(text)
        assert back == bridge.expected(text) or back == bridge.expected(text).replace("  ", " ")


def _field(number, value):
    def varint(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_bridge_rebuilds_a_unigram_model(tmp_path):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -5.5, 1), ("▁ab", -6.0, 1), ("ba", -6.2, 1), ("aba", -8.9, 1)]
    data = b"".join(_field(1, _field(1, p.encode()) + _field(2, s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1) + _field(35, 1) + _field(4, len(pieces))) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 0))
    path = tmp_path / "unigram.model"
    path.write_bytes(data)
    bridge = sentencepiece_bridge.Bridge(str(path))
    texts = ["ab ba aba", "abab  baab", "é ab", "", "b"]
    assert [(i.tolist(), d, r) for i, d, r in bridge.encode(texts)] == [(bridge.original.encode(t), 0, True) for t in texts]


def test_bridge_tells_a_wrong_rebuild():
    """Ids come from the backend: with the merges of a piece taken away, they differ and parity says so."""
    bridge = sentencepiece_bridge.Bridge(public_tokenizers.path("piece_bpe_32k.model"))
    bridge.opens = bridge.opens.copy()
    piece = bridge.original.encode("the")
    bridge.original, kept = type("Other", (), {"encode": lambda self, texts, num_threads=1: [[i for i in kept.encode(t)][::-1] for t in texts]})(), bridge.original
    (ids, differing, whole), = bridge.encode(["the theoretical"])
    assert ids.tolist() == kept.encode("the theoretical") and ids.tolist()[: len(piece)] == piece
    assert differing >= 1 and whole


# --- substring dedup


@pytest.mark.parametrize("n", [1, 7, 40])
@pytest.mark.parametrize("least", [1, 3, 8])
def test_compact_windows_hold_every_minimum_once(n, least):
    hashes = np.random.default_rng(n).integers(0, 25, n).astype(np.uint64)
    found = [
        ((i, j), int(hashes[c])) for f, c, e in zip(*substring_dedup.compact_windows(hashes, least))
        for i in range(f, c + 1) for j in range(c, e + 1) if j - i + 1 >= least
    ]
    assert len(found) == len(dict(found))
    assert dict(found) == {(i, j): int(hashes[i : j + 1].min()) for i in range(n) for j in range(i + least - 1, n)}


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    passage, long = fresh(51), fresh(200)
    near = list(long)
    near[100] = "changed"
    plans = [fresh(30) + passage + fresh(60), fresh(90) + passage, passage + fresh(10), long, fresh(40) + near, fresh(300), fresh(49) * 2, fresh(20) + passage[:48] + fresh(50)]
    rows = substring_dedup.classes(Steps(spark), docs_of(spark, [" ".join(p) for p in plans] + [None, ""])).orderBy("doc_id").collect()
    assert [r.class_id for r in rows] == [0, 0, 0, 3, 3, 5, 6, 7, 8, 9]
    assert rows[0].spans == "30:81" and rows[2].spans == "0:51"
    assert rows[3].spans and [r.n_links for r in rows[5:]] == [0] * 5


def test_many_copies_stay_linear(spark):
    text = " ".join(f"c{i}" for i in range(120))
    docs = docs_of(spark, [f"{i} x{i} " + text for i in range(400)])
    steps = Steps(spark)
    rows = substring_dedup.keyed(docs)
    links = substring_dedup.window_links(steps, steps.store(substring_dedup.windows(rows)))
    windows = substring_dedup.windows(rows).count()
    assert links.count() <= 2 * windows
    assert {r.class_id for r in substring_dedup.classes(Steps(spark), docs).collect()} == {0}


def test_copies_are_one_node_with_all_their_ids(spark):
    """Equal texts are linked without keys: no neighbour is left out, and none is found twice."""
    text = " ".join(f"c{i}" for i in range(60))
    docs = docs_of(spark, [text] * 90 + ["short text"] * 3 + [text + " more"])
    rows = substring_dedup.classes(Steps(spark), docs).orderBy("doc_id").collect()
    assert [r.class_id for r in rows] == [0] * 90 + [90, 91, 92, 0]
    assert {(r.n_links, r.n_repeated_words, r.spans) for r in rows[:90]} == {(90, 60, "0:60")}
    assert (rows[93].n_links, rows[93].spans) == (1, "0:60")


def test_links_stay_linear_however_many_tasks_cut_a_key(spark):
    text = " ".join(f"c{i}" for i in range(120))
    docs = substring_dedup.keyed(docs_of(spark, [f"{i} x{i} " + text for i in range(400)]))
    found = Steps(spark).store(substring_dedup.windows(docs))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        assert substring_dedup.window_links(Steps(spark), found).count() <= 2 * found.count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_every_window_of_a_long_document_between_two_others_is_linked(spark):
    """The middle document's rows fill whole tasks of the key."""
    row = lambda doc, centre: (7, 0, doc, centre - 50, centre, centre + 50)
    found = spark.createDataFrame([row(1, 60), *[row(2, 60 + i) for i in range(4000)], row(3, 60)], substring_dedup.WINDOWS)
    links, frequent = substring_dedup.key_links(Steps(spark), found)
    near = {r["shift"] for r in links.where("a = 2 AND b = 1 OR a = 1 AND b = 2").collect()}
    assert {abs(x) for x in near} == set(range(4000))
    assert frequent.distinct().count() == frequent.count() == 4002
    alone, rest = substring_dedup.key_links(Steps(spark), found.where("doc = 2"))
    assert alone.count() == rest.count() == 0


def test_passages_behind_frequent_phrases_are_found(spark):
    rng = random.Random(29)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    phrase = fresh(40)
    passage = [*fresh(6), *phrase, *fresh(6)]
    plans = [fresh(30) + phrase + fresh(30) for _ in range(90)] + [fresh(40) + passage + fresh(9), fresh(20) + passage + fresh(70)]
    rows = substring_dedup.classes(Steps(spark), docs_of(spark, [" ".join(p) for p in plans])).orderBy("doc_id").collect()
    assert [r.class_id for r in rows] == [*range(90), 90, 90]
    assert rows[90].spans == "40:92" and rows[91].spans == "20:72"


def test_every_place_of_a_passage_is_reported(spark):
    rng = random.Random(31)
    fresh = lambda n: [f"w{rng.getrandbits(40):x}" for _ in range(n)]
    passage, often = fresh(60), fresh(60)
    plans = [passage + fresh(50) + passage, passage[:55] + fresh(30), fresh(10) + passage]
    plans += [fresh(5) + often + fresh(80) + often + fresh(k) for k in range(1, 41)]
    rows = substring_dedup.classes(Steps(spark), docs_of(spark, [" ".join(p) for p in plans])).orderBy("doc_id").collect()
    assert [r.class_id for r in rows] == [0] * 3 + [3] * 40
    assert [r.spans for r in rows] == ["0:60,110:170", "0:55", "10:70"] + ["5:65,145:205"] * 40


def test_passages_survive_earlier_copies_and_other_text_between():
    fresh = iter(range(1, 10_000))
    more = lambda n: [next(fresh) for _ in range(n)]
    spans = lambda a, b: {x[:4] for x in substring_dedup.passages(np.array(a, np.int32), np.array(b, np.int32), 46)}
    exact = more(56)
    assert (0, 55, 31, 86) in spans(exact, [exact[20], *more(30), *exact])
    assert {(0, 55, 0, 55), (0, 55, 70, 125)} <= spans(exact, exact + more(14) + exact)
    one, two = more(60), more(60)
    edit = lambda x: x[:30] + more(5) + x[35:]
    assert spans(one + two, edit(one) + more(50) + edit(two)) == {(0, 59, 0, 59), (60, 119, 110, 169)}
    assert spans(more(80), more(80)) == set()

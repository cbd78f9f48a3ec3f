"""Phrase collocations by best-first branch-and-bound growth of prefixes.

Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`; all counts are
per language.  A candidate of two or more words occurs `least` times or more.  Its score is the worst of its cuts:
`floor(SCALE * a / (l + r))` with the counts a of the phrase, l of the words before the cut and r of those after it.  A
candidate inside a longer candidate with at least `share` percent of its count is dropped.  The first `top` survivors of
each language are returned.

Growth.  Words and word pairs are counted once, pairs of words that are too rare themselves are left out of the counting.
From there on a phrase is only grown when it may matter: every longer phrase q with the prefix p has
f(q) <= f(p), and r >= f(q) at each cut inside p, so its score is at most `floor(SCALE * f(p) / (f(first word) + f(p)))`,
the bound of p.  Each round takes the open prefixes with the best bounds of every language (at most `ROUND` of a language
and `BATCH` in all, which bounds what is broadcast), counts the words right and left of all their occurrences in one pass
over the stored word hashes, scores the new phrases and settles the old ones: a phrase survives if no neighbour keeps the
share (a longer phrase that contains it is no more frequent than one of them).  The language's `top`-th best survivor is
the threshold; the growth ends where no open prefix of any language reaches it, ties included.  Suffixes of grown prefixes
are grown with them, so the counts of all cuts are known.

Words are 64-bit hashes of (language, word) in the passes and get their texts back at the end.  Every pass counts in
blocks of bounded size before it shuffles, so frequent words and phrases reach the shuffle as a few rows per task.

Defined results.  A null text is empty; a null language is `und`, together with rows that say so.  Repeated rows count
each.  Ties: score, then count, then the phrase in UTF-8 byte order.  An empty table gives no rows.  Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gapline.llm.common import text_bytes
from gapline.llm.filters import bit_filter, passes

SCALE = 2_000_000
LEAST = 30
TOP = 2_000
SHARE = 80
#: Prefixes of one language, and of all languages, that one round grows.
ROUND = 4_000
BATCH = 100_000
#: Words that a task holds before it counts.
BLOCK = 1 << 20
#: Texts are read in slices of about so many bytes.
SLICE = 1 << 20
#: Distinct words that a task keeps.
CACHE = 500_000

TOKEN = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
GAP = re.compile(rb"[\x20\x09.,;:!?\x0A-\x0D]")
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"


def _slices(text: bytes) -> Iterator[bytes]:
    """Parts of a text cut before a separator, so that no word is cut."""
    at = 0
    while len(text) - at > SLICE:
        found = GAP.search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class _Ids(dict):
    """Hashes of the words of one language; breaks are 0."""

    def __init__(self, lang: str):
        super().__init__()
        self.seed = xxhash.xxh64_intdigest(lang.encode())
        self.fill()

    def fill(self):
        self.clear()
        self.update((bytes([b]), 0) for b in BREAKS)

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.fill()
        h = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = h = (h - (1 << 64) if h >> 63 else h) or 1
        return h


def _rows(batch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text")), strict=True):
        yield (UNKNOWN if lang is None else lang), text.lower()


def _word_counts(batches):
    counts: dict[str, Counter] = {}
    held = 0

    def flush():
        for lang, own in counts.items():
            for b in BREAKS:
                own.pop(bytes([b]), None)
            ids, words = _Ids(lang), list(own)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([ids[w] for w in part], pa.int64()), pa.array([w.decode() for w in part], pa.string()),
                     pa.array([own[w] for w in part], pa.int64())], ["lang", "id", "word", "n"]
                )
            total = pa.array([sum(own.values())], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int64()), pa.array([None], pa.string()), total], ["lang", "id", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in _rows(batch):
            own = counts.setdefault(lang, Counter())
            before = len(own)
            for part in _slices(text):
                own.update(TOKEN.findall(part))
            held += len(own) - before
            if held > CACHE:
                yield from flush()
                held = 0
    yield from flush()


def _word_hashes(batches):
    langs: dict[str, _Ids] = {}
    for batch in batches:
        out = []
        for lang, text in _rows(batch):
            if lang not in langs:
                if len(langs) > 64:
                    langs.clear()
                langs[lang] = _Ids(lang)
            of = langs[lang].__getitem__
            parts = [np.fromiter(map(of, TOKEN.findall(part)), dtype=np.int64) for part in _slices(text)]
            ids = np.concatenate([*parts, np.zeros(1, dtype=np.int64)])
            out.append(ids[(ids != 0) | np.r_[True, ids[:-1] != 0]])
        offsets = np.cumsum([0, *[len(x) for x in out]])
        values = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
        column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([column], ["ids"])


def _blocks(batches) -> Iterator[np.ndarray]:
    """The word hashes of whole documents, about BLOCK of them at a time; each document ends with a break."""
    held, size = [], 0
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        held.append(flat)
        size += len(flat)
        if size >= BLOCK:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def _counted(first: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (first, word) pairs and their numbers; `first` counts from 0."""
    words, at = np.unique(word, return_inverse=True)
    keys, n = np.unique(first.astype(np.int64) * len(words) + at, return_counts=True)
    return keys // max(len(words), 1), words[keys % max(len(words), 1)] if len(words) else words, n


def _pair_counts(bits: np.ndarray):
    def run(batches):
        for ids in _blocks(batches):
            ids = np.where((ids != 0) & passes(bits, ids), ids, 0)
            inside = (ids[:-1] != 0) & (ids[1:] != 0)
            words, at = np.unique(ids[:-1][inside], return_inverse=True)
            a, b, n = _counted(at, ids[1:][inside])
            yield pa.RecordBatch.from_arrays([pa.array(words[a]), pa.array(b), pa.array(n, pa.int64())], ["a", "b", "n"])

    return run


def _chain(parts: list[np.ndarray], salt: int) -> np.ndarray:
    h = np.full(len(parts[0]), (salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for part in parts:
        h = (h ^ part.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


class _Prefixes:
    """Phrases of one length, looked up in a stream of word hashes."""

    def __init__(self, phrases: np.ndarray, numbers: np.ndarray):
        self.size = phrases.shape[1]
        self.salt = 0
        while True:  # another salt where two phrases share a hash
            h = _chain([np.ascontiguousarray(c) for c in phrases.T], self.salt)
            if len(np.unique(h)) == len(h):
                break
            self.salt += 1
        order = np.argsort(h)
        self.hashes, self.phrases, self.numbers = h[order], phrases[order], numbers[order]
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of every occurrence."""
        count = len(ids) - self.size + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        h = _chain([ids[k : k + count] for k in range(self.size)], self.salt)
        at = np.flatnonzero(self.seen[(h >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[place] == h[at]
        at, place = at[same], place[same]
        for k in range(self.size):
            equal = ids[at + k] == self.phrases[place, k]
            at, place = at[equal], place[equal]
        return at, self.numbers[place]


def _neighbours(prefixes: list[tuple[np.ndarray, np.ndarray]], bits: np.ndarray):
    """Words right (odd) and left (even) of every occurrence: `side` is twice the prefix's number, plus one on the right."""

    def run(batches):
        tables = [_Prefixes(phrases, numbers) for phrases, numbers in prefixes]
        for ids in _blocks(batches):
            sides, words = [], []
            for table in tables:
                at, number = table.find(ids)
                right = at + table.size < len(ids)
                left = at > 0
                sides += [number[right] * 2 + 1, number[left] * 2]
                words += [ids[at[right] + table.size], ids[at[left] - 1]]
            side, word = np.concatenate(sides), np.concatenate(words)
            use = (word != 0) & passes(bits, word)
            p, w, n = _counted(side[use], word[use])
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(w), pa.array(n, pa.int64())], ["side", "w", "n"])

    return run


def _ratio(a: Column, l: Column, r: Column) -> Column:
    """floor(SCALE * a / (l + r)) in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(8,0)"), wide(l) + wide(r)).cast("long")


def _scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """`phrases` (lang, ws, a, pre) with l, r, score of the worst cut and the bound for everything grown from them.

    `pre` holds the counts of the first 1, 2, ... words; `counts` (ws, f) those of all suffixes.
    """
    m = F.size("ws")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.withColumn("rest", F.slice("ws", F.col("k") + 1, m - F.col("k"))).withColumn("l", F.element_at("pre", F.col("k")))
    met = cuts.join(counts.withColumnRenamed("ws", "rest"), "rest").withColumn("score", _ratio(F.col("a"), F.col("l"), F.col("f")))
    worst = F.min(F.struct("score", "k", "l", F.col("f").alias("r"))).alias("worst")
    rows = met.groupBy("lang", "ws", "a", "pre").agg(worst)
    return rows.select(
        "lang", "ws", "a", F.concat("pre", F.array("a")).alias("pre"), m.alias("m"), "worst.l", "worst.r", "worst.score",
        _ratio(F.col("a"), F.element_at("pre", 1), F.col("a")).alias("bound"),
    )


def _best(rows: DataFrame, top: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def mine(
    steps, docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 4, least: int = LEAST, top: int = TOP,
    share: int = SHARE, of_round: int = ROUND, batch_rows: int = BATCH,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of two to `most_words` words in every language."""
    slim = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    words = slim.mapInArrow(_word_counts, "lang string, id bigint, word string, n bigint").groupBy("lang", "id")
    words = words.agg(F.min("word").alias("word"), F.sum("n").alias("n")).where((F.col("id") == 0) | (F.col("n") >= least))
    words = steps.store(words)
    stream = steps.store(slim.mapInArrow(_word_hashes, "ids array<bigint>"))
    single = words.where("id <> 0").select("lang", F.array("id").alias("ws"), F.col("n").alias("f"), "id")
    bits = bit_filter(single, F.col("id"))

    pairs = stream.mapInArrow(_pair_counts(bits), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = pairs.where(F.col("n") >= least).join(single.select("lang", F.col("id").alias("a"), "f"), "a")
    pairs = pairs.select("lang", F.array("a", "b").alias("ws"), F.col("n").alias("a"), F.array("f").alias("pre"))
    counts = single.select("ws", "f")
    known = steps.store(_scored(pairs, counts))
    settled = None

    while True:
        marked = known.withColumn("dropped", F.lit(None).cast("boolean")) if settled is None else known.join(settled, "ws", "left")
        marked = marked.withColumn("dropped", F.when(F.col("m") == most_words, False).otherwise(F.col("dropped")))
        survivors = marked.where(~F.col("dropped"))
        limits = _best(survivors.select("lang", "score"), top, F.desc("score")).where(F.col("rank") == top).select("lang", F.col("score").alias("limit"))
        # one row per language
        limits = steps.store(limits)
        open_ = marked.where(F.col("dropped").isNull()).join(limits, "lang", "left").drop("dropped")
        wanted = _best(open_.where(F.col("bound") >= F.coalesce("limit", F.lit(-1))), of_round, F.desc("bound"), "ws")
        wanted = steps.store(wanted.orderBy("rank", "lang", "ws").limit(batch_rows).select("lang", "ws", "a", "pre", "m"))
        if wanted.isEmpty():
            break
        suffixes = wanted.where("m > 2").select(F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - 2), lambda k: F.slice("ws", k + 1, F.col("m") - k))).alias("ws"))
        extra = open_.select("lang", "ws", "a", "pre", "m").join(suffixes.distinct(), "ws", "left_semi").join(wanted.select("ws"), "ws", "left_anti")
        batch = steps.store(wanted.unionByName(extra).withColumn("p", F.monotonically_increasing_id()))
        rows = batch.select("ws", "m", "p").toArrow()
        lengths, numbers = rows.column("m").to_numpy(), rows.column("p").to_numpy()
        prefixes = [
            (np.array([ws for ws, m in zip(rows.column("ws").to_pylist(), lengths) if m == size], dtype=np.int64), numbers[lengths == size])
            for size in sorted(set(lengths.tolist()))
        ]
        around = stream.mapInArrow(_neighbours(prefixes, bits), "side bigint, w bigint, n bigint").groupBy("side", "w").agg(F.sum("n").alias("n"))
        around = around.where(F.col("n") >= least).select(F.shiftright("side", 1).alias("p"), (F.col("side") % 2 == 1).alias("right"), "w", "n")
        around = steps.store(around)
        largest = around.groupBy("p").agg(F.max("n").alias("largest"))
        dropped = F.coalesce(F.col("largest") * 100 >= F.col("a") * share, F.lit(False))
        now = batch.join(largest, "p", "left").select("ws", dropped.alias("dropped"))
        grown = around.where("right").join(batch, "p").select("lang", F.concat("ws", F.array("w")).alias("ws"), F.col("n").alias("a"), "pre")
        counts = single.select("ws", "f").unionByName(known.select("ws", F.col("a").alias("f"))).unionByName(grown.select("ws", F.col("a").alias("f")))
        known = steps.store(known.unionByName(_scored(grown, counts)))
        settled = steps.store(now if settled is None else settled.unionByName(now))

    best = survivors.join(limits, "lang", "left").where(F.col("score") >= F.coalesce("limit", F.lit(-1)))
    spoken = best.select("ws", F.posexplode("ws").alias("k", "id")).join(words.select("id", "word"), "id")
    spoken = spoken.groupBy("ws").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    totals = words.where("id = 0").select("lang", F.col("n").alias("n"))
    rows = best.join(spoken, "ws").join(totals, "lang")
    rows = _best(rows, top, F.desc("score"), F.desc("a"), "phrase")
    return rows.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

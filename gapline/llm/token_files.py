"""Token-id files: one zstandard frame per document, all with one dictionary trained on serialised id arrays.

A file set is two Parquet tables, so that any store Spark writes to will do and its commit rules hold for lost tasks:

* `dictionary`: sha256, bytes, width (bytes of one id).
* `blocks`, in ascending order of (part, block): part, block, first_id, last_id, doc_ids, offsets (n + 1), n_tokens,
  dictionary_sha256, frames (the frames of the block end to end).

`part` is the range partition of doc_id, so (part, block, place) is the order of (doc_id, text), null ids first.  One
document is read by the block whose first_id..last_id holds it and its two offsets; nothing else is decompressed.

Every text is encoded by the tokenizers library with its defaults (a special token spelled out in a text becomes its
id) and ends with id `end_id`.  With a byte-level tokenizer, a stretch of white space and what follows it up to the next
white space never shares a token with its neighbours, so such stretches are encoded once per worker and looked up after
that, the different ones of a batch once; a text with other white space than the ASCII kinds or with a special token,
and any other kind of tokenizer, is encoded whole.

The dictionary is fitted on a bounded sample of documents (`sample`, by a hash of the id; of each, `SAMPLE_IDS` ids from
a place that a hash of the id names); it changes sizes only.  A null text is empty and holds the end id alone.  Repeated rows are documents of their
own.  An empty table gives empty files.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

SAMPLE_DOCUMENTS = 2000
SAMPLE_IDS = 16_384
DICTIONARY_BYTES = 65_536
#: Small enough that a batch of blocks fits a worker.
BLOCK_DOCUMENTS = 64
BLOCK_BYTES = 1 << 18
KNOWN_STRETCHES = 1_200_000
#: New stretches handed to the library as one text.
JOINED = 64
#: Put before the first stretch of a text; texts that hold it are encoded whole.
_FIRST = "\x1c"
BLOCKS = (
    "part int, block bigint, first_id bigint, last_id bigint, doc_ids array<bigint>, offsets array<bigint>, "
    "n_tokens array<bigint>, dictionary_sha256 string, frames binary"
)

_STRETCH = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+$")
#: Two white-space characters in a row, or one that is neither a space nor a newline.
_UNUSUAL = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: Controls that only Python takes for white space, and white space beyond ASCII.
_CONTROLS = ("\x1c", "\x1d", "\x1e", "\x1f")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Marks that never share a token with a letter or digit before them.
_ENDS = ".,;:!?"


def _wide(text: str) -> bool:
    return any(c in text for c in _CONTROLS) or (not text.isascii() and _WIDE.search(text) is not None)


def _unusual(text: str) -> bool:
    return any(c in text for c in _UNUSUAL)


class Encoder:
    """Ids of whole texts as little-endian arrays of `width` bytes."""

    loaded: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        pre = settings.get("pre_tokenizer") or {}
        self.by_stretch = (
            settings.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
        )
        self.special = [t["content"] for t in settings.get("added_tokens") or []]
        self.by_stretch = self.by_stretch and all(self.special) and not any(re.search(r"\s", t) for t in self.special)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)  # ids whose text starts with a space
        self.opens[[i for t, i in vocabulary.items() if t[:1] == "Ġ"]] = True
        self.after_space: dict[str, bytes] = {}  # the stretch without its space, or with its newline
        self.whole: dict[str, bytes] = {}
        self.newline = self._library(["\n"])[0]

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if self.width == 2 and sys.byteorder == "little":
            return [array("H", e.ids).tobytes() for e in encoded]
        return [np.array(e.ids, dtype=f"<u{self.width}").tobytes() for e in encoded]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space each: many at once, cut before each id that starts with a space."""
        out: list[bytes] = []
        for i in range(0, len(words), JOINED * 256):
            part = words[i : i + JOINED * 256]
            groups = [part[k : k + JOINED] for k in range(0, len(part), JOINED)]
            for group, raw in zip(groups, self._library([" " + " ".join(g) for g in groups]), strict=True):
                at = (np.flatnonzero(self.opens[np.frombuffer(raw, dtype=f"<u{self.width}")]) * self.width).tolist()
                if len(at) == len(group):
                    out += [raw[s:e] for s, e in zip(at, [*at[1:], len(raw)], strict=True)]
                else:  # an empty word among them
                    out += self._library([" " + w for w in group])
        return out

    def _learn(self, after: set[str], whole: set[str]) -> None:
        """Ids of new stretches: after a space (or with their newline), and as they stand.

        A newline before a stretch and marks after its last letter are tokens of their own, so only what is between
        them is encoded, once for all its neighbours.
        """
        known, plain = self.after_space, self.whole
        words, bare, joined = set(), whole, []
        for part in after:
            if part[:1] == "\n":
                word = part[1:].rstrip(_ENDS)
                if not word or not word[-1].isalnum():
                    word = part[1:]
                joined.append((part, word, part[len(word) + 1 :], plain))
                bare.add(word)
                bare.add(joined[-1][2])
            elif part[-1:] in _ENDS:
                word = part.rstrip(_ENDS)
                if word and word[-1].isalnum():
                    joined.append((part, word, part[len(word) :], known))
                    bare.add(joined[-1][2])
                else:
                    word = part
                words.add(word)
            else:
                words.add(part)
        new = [w for w in words if w not in known]
        known.update(zip(new, self._spaced(new), strict=True))
        new = [w for w in bare if w not in plain]
        plain.update(zip(new, self._library(new), strict=True))
        for part, word, end, table in joined:
            known[part] = (self.newline if table is plain else b"") + table[word] + plain[end]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts of words with one space or newline between them: each different stretch is looked up once, the ids of
        all are put together by their places."""
        lists = pc.split_pattern(pa.array([_FIRST + t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        parts = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        blobs = list(map(self.after_space.get, parts))
        if None in blobs:
            holes = [i for i, b in enumerate(blobs) if b is None]
            firsts = {i: parts[i][1:] for i in holes if parts[i][:1] == _FIRST}
            self._learn({parts[i] for i in holes if i not in firsts}, {p for p in firsts.values() if p not in self.whole})
            for i in holes:
                blobs[i] = self.whole[firsts[i]] if i in firsts else self.after_space[parts[i]]
        size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // self.width
        ids = np.frombuffer(b"".join(blobs), dtype=f"<u{self.width}")
        which = coded.indices.to_numpy(zero_copy_only=False)
        lengths = size[which]
        ends = np.cumsum(lengths)
        moved = np.repeat((np.cumsum(size) - size)[which] - ends + lengths, lengths)
        raw = ids[moved + np.arange(len(moved))].tobytes()
        cuts = (np.r_[0, ends][lists.offsets.to_numpy()] * self.width).tolist()
        return [raw[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_stretch:
            return self._library(texts)
        if len(self.after_space) + len(self.whole) > KNOWN_STRETCHES:
            self.after_space.clear()
            self.whole.clear()
        plain, spaced, odd = [], [], []
        for i, text in enumerate(texts):
            (odd if _wide(text) or any(t in text for t in self.special) else spaced if _unusual(text) else plain).append(i)
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(odd, self._library([texts[i] for i in odd]), strict=True):
            out[i] = ids
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        cut = [_STRETCH.findall(texts[i]) for i in spaced]
        self._learn(set(), {p for parts in cut for p in parts if p not in self.whole})
        for i, parts in zip(spaced, cut, strict=True):
            out[i] = b"".join([self.whole[p] for p in parts])
        return out


def _strings(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def train_dictionary(docs: DataFrame, tokenizer_path: str, sample: int = SAMPLE_DOCUMENTS) -> bytes:
    """Dictionary from about `sample` documents, chosen by a hash of their ids; empty if they are too few."""
    total = docs.count()
    share = min(1.0, sample / total) if total else 0.0
    chosen = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    chosen = chosen.select("text", F.xxhash64("doc_id", F.lit("place")).alias("place"))

    def run(batches):
        encoder = Encoder.of(tokenizer_path)
        for batch in batches:
            size, arrays = SAMPLE_IDS * encoder.width, []
            for ids, place in zip(encoder.encode(_strings(batch.column(0))), batch.column(1).to_pylist(), strict=True):
                at = size * (place % max(1, -(-len(ids) // size)))
                arrays.append(ids[at : at + size])
            yield pa.RecordBatch.from_arrays([pa.array(arrays, pa.binary())], ["ids"])

    samples = [bytes(r["ids"]) for r in chosen.mapInArrow(run, "ids binary").limit(2 * sample).collect() if r["ids"]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too few samples for this size
        return b""


def _compression(dictionary: bytes):
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(spark: SparkSession, docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the file set of all documents into a new folder."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    dictionary = train_dictionary(docs, tokenizer_path)
    digest = hashlib.sha256(dictionary).hexdigest()
    width = Encoder(tokenizer_path).width
    spark.range(1).select(
        F.lit(digest).alias("sha256"), F.lit(bytearray(dictionary)).alias("bytes"), F.lit(width).alias("width")
    ).write.parquet(f"{folder}/dictionary")

    def pack(batches):
        encoder = Encoder.of(tokenizer_path)
        end = np.array([end_id], dtype=f"<u{encoder.width}").tobytes()
        compressor = zstandard.ZstdCompressor(level=3, **_compression(dictionary))
        part, block, held = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []

        def flush():
            offsets = [0, *np.cumsum([len(f) for f in frames]).tolist()]
            given = [i for i in ids if i is not None]
            row = {
                "part": part, "block": block, "first_id": min(given, default=None), "last_id": max(given, default=None),
                "doc_ids": ids, "offsets": offsets, "n_tokens": counts, "dictionary_sha256": digest, "frames": b"".join(frames),
            }
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            for doc_id, array in zip(batch.column(0).to_pylist(), encoder.encode(_strings(batch.column(1))), strict=True):
                ids.append(doc_id)
                frames.append(compressor.compress(array + end))
                counts.append(len(array) // encoder.width + 1)
                held += len(frames[-1])
                if len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_BYTES:
                    yield flush()
                    ids, frames, counts, block, held = [], [], [], block + 1, 0
        if ids:
            yield flush()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(pack, BLOCKS).write.parquet(f"{folder}/blocks")


BLOCK_SCHEMA = pa.schema([
    ("part", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("dictionary_sha256", pa.string()), ("frames", pa.binary()),
])


def load_dictionary(spark: SparkSession, folder: str) -> tuple[bytes, str, int]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = bytes(row["bytes"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary is not the one that the files name")
    return dictionary, row["sha256"], row["width"]


def _decoded(spark: SparkSession, blocks: DataFrame, folder: str, schema: str, emit) -> DataFrame:
    """`emit(doc_id, ids as uint32)` gives the last columns of a row for each document of the blocks."""
    dictionary, digest, width = load_dictionary(spark, folder)
    names = [x.split()[0] for x in schema.split(", ")]
    rows = blocks.select("part", "block", "doc_ids", "offsets", "dictionary_sha256", "frames")

    def run(batches):
        opener = zstandard.ZstdDecompressor(**_compression(dictionary))
        for batch in batches:
            for r in range(batch.num_rows):
                part, block, ids, offsets, named, frames = (batch.column(c)[r].as_py() for c in range(6))
                if named != digest:
                    raise ValueError("a block names another dictionary")
                columns: list[list] = [[] for _ in names]
                for k, doc_id in enumerate(ids):
                    raw = opener.decompress(frames[offsets[k] : offsets[k + 1]])
                    array = np.frombuffer(raw, dtype=f"<u{width}").astype("<u4")
                    for column, value in zip(columns, (part, block, k, doc_id, *emit(array)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names).cast(target)

    target = to_arrow_schema(T.StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its decompressed ids.

    `start` counts the ids of all documents before: blocks are summed per part, parts are summed over the (few) parts.
    """
    blocks = spark.read.parquet(f"{folder}/blocks")
    kept = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before = lambda w, n="n": F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = kept.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    starts = kept.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("before"))
    rows = _decoded(
        spark, blocks, folder, "part int, block bigint, place int, doc_id bigint, n_tokens bigint, ids_crc32 bigint",
        lambda ids: (len(ids), zlib.crc32(ids.tobytes())),
    )
    inside = before(Window.partitionBy("part", "block").orderBy("place"), "n_tokens")
    return rows.withColumn("inside", inside).join(starts, ["part", "block"]).select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_documents(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """doc_id, ids of a few documents: only the blocks whose id range holds one are read, only their frames opened."""
    wanted = F.array(*[F.lit(i).cast("bigint") for i in ids])
    blocks = spark.read.parquet(f"{folder}/blocks").where(
        F.exists(wanted, lambda i: (F.col("first_id") <= i) & (i <= F.col("last_id")))
    )
    places = F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda k: F.array_contains(wanted, F.element_at("doc_ids", k)))
    one = blocks.select("part", "block", "dictionary_sha256", "frames", "doc_ids", "offsets", F.explode(places).alias("k"))
    single = one.select(
        "part", "block", F.array(F.element_at("doc_ids", F.col("k"))).alias("doc_ids"),
        F.array(F.lit(0).cast("bigint"), F.element_at("offsets", F.col("k") + 1) - F.element_at("offsets", F.col("k"))).alias("offsets"),
        "dictionary_sha256",
        F.substring("frames", (F.element_at("offsets", F.col("k")) + 1).cast("int"),
                    (F.element_at("offsets", F.col("k") + 1) - F.element_at("offsets", F.col("k"))).cast("int")).alias("frames"),
    )
    return _decoded(
        spark, single, folder, "part int, block bigint, place int, doc_id bigint, ids array<bigint>", lambda a: (a.tolist(),)
    ).select("doc_id", "ids")

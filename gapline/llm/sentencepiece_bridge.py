"""SentencePiece encoding and decoding with the tokenizers library as the backend.

The model file is parsed field by field and rebuilt: the normaliser (compiled character map, extra white space, dummy
prefix, the metaspace marker), the pieces with their scores (unigram) or the merges that their scores imply (BPE), and
byte fallback.  Control, unknown and unused pieces are never made from text, as in the original.

Texts are normalised whole.  If no piece has the marker after another character, no token crosses the place before a
marker, so a text is encoded stretch by stretch; the stretches that a worker has not met are encoded in one
multithreaded batch.  The ids given out are the backend's.  Parity: the sentencepiece library encodes each of these
stretches as well, and the backend decodes it again; `differing` counts the stretches of a document whose ids are not
the original's, `round_trip` says whether all of them decode to the normalised text.  Any other model is encoded,
compared and decoded text by text.

A null text is empty and has no ids.  Repeated rows are rows of their own, an empty table gives an empty result; extra
columns pass through.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from gapline.llm.common import add_struct

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
KNOWN_STRETCHES = 1_000_000
#: New stretches that go to a library as one text (merges of one stretch do not depend on the next).
JOINED = 64
FIELDS = "n_tokens bigint, ids_crc32 bigint, differing bigint, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and settings of a model file."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normal: dict = {}
        for field, value in _fields(data):
            if field == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.mark_last = bool(trainer.get(24, 0))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.character_map: bytes = normal.get(2, b"")
        self.dummy_prefix = bool(normal.get(3, 1))
        self.fewer_spaces = bool(normal.get(4, 1))
        if self.kind not in (UNIGRAM, BPE) or self.mark_last or any(p[2] == USER for p in self.pieces):
            raise ValueError("only unigram and BPE models without user-defined pieces and with leading markers are rebuilt")

    def merges(self) -> list[tuple[str, str]]:
        """All cuts of each ordinary piece into two pieces, best score first."""
        rank = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}
        found = []
        for piece, i in rank.items():
            for k in range(1, len(piece)):
                left, right = piece[:k], piece[k:]
                if left in rank and right in rank:
                    found.append((-self.pieces[i][1], i, rank[left], rank[right], left, right))
        return [(left, right) for *_, left, right in sorted(found)]


class Bridge:
    loaded: dict[str, "Bridge"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.model = m = Model(f.read())
        vocabulary = [(p, s) for p, s, _ in m.pieces]
        if m.kind == UNIGRAM:
            backend = models.Unigram(vocabulary, m.unknown, m.byte_fallback)
        else:
            backend = models.BPE(
                {p: i for i, (p, _) in enumerate(vocabulary)}, m.merges(), unk_token=m.pieces[m.unknown][0],
                fuse_unk=True, byte_fallback=m.byte_fallback,
            )
        self.tokenizer = Tokenizer(backend)
        steps = [normalizers.Precompiled(m.character_map)] if m.character_map else []
        if m.fewer_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.plain = not steps
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        self.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        self.tokenizer.decoder = decoders.Sequence(
            [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])
        )
        self.original = sentencepiece.SentencePieceProcessor(model_file=path)
        made = [p for p, _, kind in m.pieces if kind == NORMAL]
        self.by_stretch = not any(re.search(f"[^{MARK}]{MARK}", p) for p in made)
        #: newlines stand alone, so a stretch may also be cut before one
        self.cut_lines = self.by_stretch and not any("\n" in p and len(p) > 1 for p in made)
        self.opens = np.array([p[:1] == MARK for p, _, _ in m.pieces], dtype=bool)
        self.known: dict[str, bytes] = {}
        #: stretches of `known` that the original encodes otherwise, and those that decode to another text
        self.differing: set[str] = set()
        self.broken: set[str] = set()

    @classmethod
    def of(cls, path: str) -> "Bridge":
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _normal(self, text: str) -> str:
        if not self.plain:
            return self.normalizer.normalize_str(text)
        return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)

    def _stretches(self, text: str) -> list[str]:
        normal = self._normal(text)
        if not self.by_stretch:
            return [normal] if normal else []
        if self.cut_lines:
            normal = normal.replace("\n", "\x00\n")
            if "\x00\x00" not in normal and "\x00" not in text and MARK * 2 not in normal:
                # every cut is before a single marker or a newline
                return [s for s in normal.replace(MARK, "\x00" + MARK).split("\x00") if s]
            normal = normal.replace("\x00\n", "\n") if "\x00" not in text else self._normal(text)
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", normal)

    def _originals(self, stretches: list[str]) -> list[list[int]]:
        """What the sentencepiece library makes of normalised stretches."""
        prefixed = self.model.dummy_prefix
        texts = [s[1:].replace(MARK, " ") if prefixed and s[0] == MARK else s for s in stretches]
        out = self.original.encode(texts, num_threads=os.cpu_count() or 1)
        for k, s in enumerate(stretches):
            if prefixed and s == MARK:  # the library puts no prefix before an empty text
                out[k] = [self.original.piece_to_id(MARK)]
            elif prefixed and s[0] != MARK:  # a stretch after a cut at a newline: without the prefix's piece
                out[k] = out[k][1:]
        return out

    def _together(self, stretches: list[str]) -> tuple[list[str], list[bytes], list[bytes]]:
        """Stretches of one marker and more, their ids by the backend and by the original: `JOINED` at once, cut before
        each id that starts with a marker."""
        groups = [stretches[k : k + JOINED] for k in range(0, len(stretches), JOINED)]
        texts = ["".join(g) for g in groups]
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        out: tuple[list[str], list[bytes], list[bytes]] = ([], [], [])
        for group, *both in zip(groups, mine, self._originals(texts), strict=True):
            cut = []
            for ids in both:
                array = np.array(ids, dtype="<u4")
                at, raw = (np.flatnonzero(self.opens[array]) * 4).tolist(), array.tobytes()
                cut.append([raw[s:e] for s, e in zip(at, [*at[1:], len(raw)], strict=True)])
            if not len(group) == len(cut[0]) == len(cut[1]):
                cut = self._single(group)
            for column, x in zip(out, (group, *cut), strict=True):
                column += x
        return out

    def _single(self, stretches: list[str]) -> list[list[bytes]]:
        mine = [e.ids for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        return [[np.array(i, dtype="<u4").tobytes() for i in ids] for ids in (mine, self._originals(stretches))]

    def learn(self, stretches: list[str]) -> None:
        """Encode, compare and decode new stretches."""
        simple = [s for s in stretches if s[0] == MARK and MARK not in s[1:] and len(s) > 1] if self.model.kind == BPE and self.by_stretch else []
        rest = [s for s in stretches if not (s[0] == MARK and MARK not in s[1:] and len(s) > 1)] if simple else stretches
        given, mine, original = self._together(simple)
        given += rest
        for column, x in zip((mine, original), self._single(rest), strict=True):
            column += x
        self.known.update(zip(given, mine, strict=True))
        self.differing.update([s for s, x, y in zip(given, mine, original, strict=True) if x != y])
        back = self.decode([np.frombuffer(x, dtype="<u4") for x in mine])
        self.broken.update([s for s, x in zip(given, back, strict=True) if x != self._readable(s)])

    def _readable(self, normal: str) -> str:
        text = normal.replace(MARK, " ")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int, bool]]:
        """(ids, stretches that the original encodes otherwise, round trip) of each text."""
        cut = [self._stretches(t) for t in texts]
        if len(self.known) > KNOWN_STRETCHES:
            for table in (self.known, self.differing, self.broken):
                table.clear()
        known = self.known
        self.learn([s for s in set().union(*cut) if s not in known])
        out = []
        for stretches in cut:
            ids = np.frombuffer(b"".join([known[s] for s in stretches]), dtype="<u4")
            differing = sum(s in self.differing for s in stretches) if self.differing else 0
            out.append((ids, differing, not self.broken or self.broken.isdisjoint(stretches)))
        if not self.by_stretch:
            for table in (self.known, self.differing, self.broken):
                table.clear()  # whole texts are not kept
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([i.tolist() for i in ids], skip_special_tokens=False)

    def expected(self, text: str) -> str:
        """What decoding has to give: the normalised text."""
        normal = self._normal(text).replace(MARK, " ")
        return normal[1:] if self.model.dummy_prefix else normal


def encode(docs: DataFrame, name: str, path: str, with_ids: bool = False) -> DataFrame:
    """All rows and columns of `docs` and a struct: n_tokens, ids_crc32 (little-endian 32-bit ids), differing,
    round_trip, and the ids themselves if asked for.  No shuffle."""

    def compute(texts: list[bytes]) -> list[list]:
        encoded = Bridge.of(path).encode([t.decode() for t in texts])
        columns = [
            [len(ids) for ids, *_ in encoded], [zlib.crc32(ids) for ids, *_ in encoded],
            [d for _, d, _ in encoded], [r for *_, r in encoded],
        ]
        return columns + ([[ids.view(np.int32) for ids, *_ in encoded]] if with_ids else [])

    return add_struct(docs, "text", name, FIELDS + (", ids array<int>" if with_ids else ""), compute)

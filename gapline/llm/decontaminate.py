"""Benchmark decontamination with a generalised suffix automaton over normalised words.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.  The automaton holds every word sequence of the items.
Each document is streamed through it once; the automaton's state keeps the longest stretch of items that ends at the
present word.  Where that stretch has `window` words or more, the words of the stretch are hit, and the items of the
window that ends there are found at its state.  An item of fewer words is one window of its own and hit as a whole.

The automaton is built from items of at most `BLOCK_WORDS` words in all and sent to the tasks; a larger benchmark is cut
into several automata, which are streamed one after another (hits are merged), so what a task holds stays bounded.

Nulls: a null text has no words, a null item id is the id "".  Items with the same id count as one.  Repeated documents
are rows of their own, empty tables give empty results or no hits; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from gapline.llm.common import Steps, add_struct, free_name

WINDOW = 13
#: Words of the items in one automaton (about 0.1 GB in a task at the most).
BLOCK_WORDS = 100_000
FIELDS = "n_words bigint, starts array<int>, ends array<int>, items array<string>"
#: A-Z to lower case, every other ASCII character that is no digit or letter to a space.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Automaton:
    """Suffix automaton of several word lists, with the windows of each list at their states."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.codes.setdefault(w, len(self.codes)) for w in words]) for name, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        #: items whose window of full width ends at this state, and (length, item) of short items that end here
        self.full: dict[int, set[str]] = {}
        short: dict[int, list[tuple[int, str]]] = {}
        for name, words in coded:
            state = 0
            for k, w in enumerate(words):
                state = self.next[state][w]
                if k + 1 >= window:
                    self.full.setdefault(self.narrowed(state), set()).add(name)
            if len(words) < window:
                short.setdefault(state, []).append((len(words), name))
        # what ends at a state also holds for the longer stretches whose suffix it is
        self.short: dict[int, list[tuple[int, str]]] = {}
        if short:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                found = short.get(state, []) + self.short.get(self.link[state], [])
                if found:
                    self.short[state] = found

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._clone(known, last, w)
        state = self._new({}, self.length[last] + 1, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(q, p, w)
        return state

    def _new(self, edges: dict[int, int], length: int, link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, q: int, p: int, w: int) -> int:
        copy = self._new(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def narrowed(self, state: int) -> int:
        """The state of the last `window` words of a longer stretch."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged stretches [start, end) of hit words, in order, and the items they come from."""
        step, link, length, window, short = self.next, self.link, self.length, self.window, self.short
        found: list[tuple[int, int]] = []
        states: set[int] = set()
        items: set[str] = set()
        state = size = 0
        for at, w in enumerate(map(self.codes.get, words), 1):
            if w is None:
                state = size = 0
                continue
            edges = step[state]
            while w not in edges and state:
                state = link[state]
                size = length[state]
                edges = step[state]
            if w not in edges:
                continue
            state = edges[w]
            size += 1
            reach = 0
            if size >= window:
                reach = size
                states.add(state)
            if short and state in short:
                for k, name in short[state]:
                    if k <= size:
                        reach = max(reach, k)
                        items.add(name)
            if reach:
                start = at - reach
                while found and found[-1][1] >= start:
                    start = min(start, found.pop()[0])
                found.append((start, at))
        for s in states:
            items |= self.full[self.narrowed(s)]
        return found, items


def automata(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> Iterator[Automaton]:
    """Automata over blocks of items.  Items reach the driver one partition at a time and leave it with their block."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text"))
    for r in rows.where(F.col("text").isNotNull()).toLocalIterator():
        words = words_of(r["text"].encode())
        if block and held + len(words) > block_words:
            yield Automaton(block, window)
            block, held = [], 0
        block.append((r["item"], words))
        held += len(words)
    yield Automaton(block, window)


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def mark(docs: DataFrame, benchmark: DataFrame, steps=None, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All rows and columns of `docs` and a struct `found`: n_words, starts and ends of hit word stretches, items.

    One automaton is one pass over the batches, without a shuffle.  With several, each pass is stored and the next one
    merges its hits into those found before, so a task never holds more than one automaton.
    """
    name, out = free_name(docs, "found"), None
    for automaton in automata(benchmark, window, block_words):
        if out is not None:
            out = (steps or Steps(docs.sparkSession)).store(out)
        out = _pass(docs if out is None else out, docs.sparkSession.sparkContext.broadcast(automaton), name, out is not None)
    return out


def _pass(rows: DataFrame, shared, name: str, again: bool) -> DataFrame:
    def compute(texts: list[bytes], earlier: list[dict] | None = None) -> list[list]:
        n_words, starts, ends, names = [], [], [], []
        for k, text in enumerate(texts):
            words = words_of(text)
            stretches, items = shared.value.hits(words)
            if earlier:
                stretches = merged([*stretches, *zip(earlier[k]["starts"], earlier[k]["ends"], strict=True)])
                items |= set(earlier[k]["items"])
            n_words.append(len(words))
            starts.append([s for s, _ in stretches])
            ends.append([e for _, e in stretches])
            names.append(sorted(items))
        return [n_words, starts, ends, names]

    if not again:
        return add_struct(rows, "text", name, FIELDS, compute)
    made = add_struct(rows, "text", free_name(rows, name), FIELDS, compute, name)
    return made.withColumnRenamed(made.columns[-1], name)


def n_hit(found: Column) -> Column:
    zipped = F.arrays_zip(found["starts"].alias("s"), found["ends"].alias("e"))
    return F.aggregate(zipped, F.lit(0).cast("bigint"), lambda n, z: n + (z["e"] - z["s"]))


def contaminated(found: Column, hit: Column, share: int = 20) -> Column:
    """Hit words reach one in `share`."""
    return (hit > 0) & (hit * share >= found["n_words"])


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte offsets of the words."""
    plain, out, at = text.translate(LETTERS), [], 0
    for w in plain.split():
        at = plain.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def cut_spans(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    """The text without the stretches of hit words, from the first word's start to the last word's end."""
    words, keep, at = word_spans(text), [], 0
    for s, e in zip(starts, ends, strict=True):
        keep.append(text[at : words[s][0]])
        at = words[e - 1][1]
    return b"".join([*keep, text[at:]])


def cut(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """All rows; in a document over the coverage limit the hit stretches are cut out of the text."""
    name = free_name(docs, "found")
    marked = mark(docs, benchmark, **settings)
    at, columns = docs.columns.index("text"), docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text, f in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True):
                hit = sum(f["ends"]) - sum(f["starts"])
                over = hit > 0 and 20 * hit >= f["n_words"]
                texts.append(cut_spans(text.encode(), f["starts"], f["ends"]).decode() if over else text)
            arrays = list(batch.columns)[: len(columns)]
            arrays[at] = pa.array(texts, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return marked.select(*columns, name).mapInArrow(run, docs.schema)


def stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Columns of `docs`; documents over the coverage limit go."""
    name = free_name(docs, "found")
    marked = mark(docs, benchmark)
    found = F.col(name)
    return marked.where(~contaminated(found, n_hit(found))).select(*docs.columns)

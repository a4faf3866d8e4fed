"""Operator 7: benchmark decontamination with a generalised suffix automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindex.llm.common import bounded_batches, bytes_of

#: ASCII letters to lower case, every other ASCII byte but digits to a space, so
#: that a split gives the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
WORDS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

#: Item words in one automaton: about 200 bytes a word in every Python worker.
BLOCK_WORDS = 150_000
#: Bytes of texts that are held while several automata read them in turn.
HELD_BYTES = 64 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton of items' word sequences.

    Read a document word by word with `matches`: after each word the automaton
    holds the longest suffix read so far that some item contains.
    """

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[tuple[int, int, int]] = []  # (state, words read, item)
        self.items = [i for i, _ in items]
        self.shortest = window
        bigrams = set()
        for at, (_, words) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            bigrams.update(zip(ids, ids[1:]))
            self.shortest = min(self.shortest, len(ids) or window)
            last = 0
            for n, w in enumerate(ids, 1):
                last = self._extend(last, w)
                if n >= window or n == len(ids):
                    ends.append((last, min(n, window), at))
        #: For each state: the occurring windows as (words, items), by way of the link chain.
        self.found: dict[int, list[tuple[int, frozenset[int]]]] = {}
        own: dict[tuple[int, int], set[int]] = {}
        for state, n, at in ends:
            while self.length[self.link[state]] >= n:
                state = self.link[state]
            own.setdefault((state, n), set()).add(at)
        by_state: dict[int, list[tuple[int, frozenset[int]]]] = {}
        for (state, n), at in own.items():
            by_state.setdefault(state, []).append((n, frozenset(at)))
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            here = sorted(by_state.get(state, [])) + (self.found.get(self.link[state], []) if state else [])
            if here:
                self.found[state] = here
        v = max(1, len(self.vocabulary))
        self.bigrams = np.array(sorted(a * v + b for a, b in bigrams), np.int64)

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        return copy

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of a document, as word ids or -1, that could hold a window.

        Elsewhere the longest match is at most one word, or too short.
        """
        if self.shortest < 2:
            fits = (ids >= 0).astype(np.int8)
            need = 1
        else:
            key = ids[:-1] * max(1, len(self.vocabulary)) + ids[1:]
            at = np.searchsorted(self.bigrams, key)
            at[at == len(self.bigrams)] = 0
            fits = ((self.bigrams[at] == key) & (ids[:-1] >= 0) & (ids[1:] >= 0)).astype(np.int8)
            need = self.shortest - 1
        edge = np.flatnonzero(np.diff(fits, prepend=0, append=0))
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= need
        return list(zip(start[long].tolist(), (stop[long] + (self.shortest >= 2)).tolist()))

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word intervals [start, end) hit by windows, merged, and item places."""
        ids = np.fromiter(map(self.vocabulary.get, words, [-1] * len(words)), np.int64, len(words))
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        if not len(self.items) or len(ids) < self.shortest or not len(self.bigrams) and self.shortest > 1:
            return hits, items
        step, link, length, found = self.step, self.link, self.length, self.found
        for start, stop in self.runs(ids):
            state = n = 0
            for at, w in enumerate(ids[start:stop].tolist(), start):
                while state and w not in step[state]:
                    state = link[state]
                    n = length[state]
                if w in step[state]:
                    state = step[state][w]
                    n += 1
                if state in found:
                    longest = 0
                    for size, which in found[state]:
                        if size <= n:
                            longest = max(longest, size)
                            items |= which
                    if longest:
                        a, b = at + 1 - longest, at + 1
                        while hits and hits[-1][1] >= a:
                            a = min(a, hits.pop()[0])
                        hits.append((a, b))
        return hits, items


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """Items as (id, words), gathered a block at a time, each of a bounded size."""
    block, size = [], 0
    for item, text in benchmark.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).toLocalIterator():
        words = words_of((text or "").encode())
        if words:
            if block and size + len(words) > block_words:
                yield block
                block, size = [], 0
            block.append((item, words))
            size += len(words)
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_words: int = BLOCK_WORDS, words_col: str = "n_words", spans_col: str = "hit_spans", items_col: str = "hit_items") -> DataFrame:
    """`docs` with three more columns: number of words, hit spans, matching items.

    A window is `window` consecutive words of an item, or the whole of a shorter
    item.  `hit_spans` are the merged word intervals [start, end) that windows
    cover; `hit_items` the ids of the items whose windows occur, in order.  The
    items go to the executors in automata of `block_words` words at most; with
    more items than that, a task loads one automaton after another, each for
    HELD_BYTES of texts, so it never holds two.  The driver too builds and holds
    one at a time.  There is one pass over the documents and no shuffle.

    Null or wordless text: no words, no hits.  Null item text: no window; null
    item ids count for hits alone.  Repeated rows are treated each; repeated
    items are listed once.  Empty tables give no rows, or no hits.  The new
    columns replace columns of the same names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    out = docs.drop(words_col, spans_col, items_col).withColumns({words_col: F.lit(0).cast("long"), spans_col: F.array().cast(SPANS), items_col: F.array().cast("array<long>")})
    context = spark.sparkContext
    automata = [context.broadcast(SuffixAutomaton(block, window)) for block in item_blocks(benchmark, item_id_col, item_text_col, block_words)]
    return _pass(out, automata or [context.broadcast(SuffixAutomaton([], window))], text_col, words_col, spans_col, items_col)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, automata: list, text_col: str, words_col: str, spans_col: str, items_col: str) -> DataFrame:
    def loaded():
        """The automata, one after another; of several, none is kept."""
        for a in automata:
            yield a.value if len(automata) == 1 else a.load_from_path(a._path)

    def marked(held: list[pa.RecordBatch]):
        texts = [[words_of(t) for t in bytes_of(b, text_col)] for b in held]
        spans: list[list[list]] = [[[] for _ in own] for own in texts]
        items: list[list[set]] = [[set() for _ in own] for own in texts]
        for sam in loaded():
            for own, hits, found in zip(texts, spans, items):
                for i, words in enumerate(own):
                    hit, which = sam.matches(words)
                    if hit:
                        hits[i] += hit
                        found[i].update(sam.items[w] for w in which if sam.items[w] is not None)
        for b, own, hits, found in zip(held, texts, spans, items):
            new = {words_col: [len(w) for w in own], spans_col: [[{"start": s, "end": e} for s, e in merged(h)] for h in hits], items_col: [sorted(f) for f in found]}
            yield pa.RecordBatch.from_arrays([pa.array(new[c], b.column(c).type) if c in new else b.column(c) for c in b.schema.names], schema=b.schema)

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if len(automata) == 1 or size >= HELD_BYTES:
                yield from marked(held)
                held, size = [], 0
        if held:
            yield from marked(held)

    return docs.mapInArrow(run, docs.schema)


def hit_words(spans: Column) -> Column:
    """Words in the spans of `decontaminate`."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """At least one hit word in `one_in`."""
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    if not spans:
        return text
    wanted = {x for start, end in spans for x in (start, end - 1)}
    place: dict[int, tuple[int, int]] = {}
    shown, pos = text.translate(WORDS), 0
    for n, word in enumerate(shown.split()):
        pos = shown.index(word, pos)
        if n in wanted:
            place[n] = (pos, pos + len(word))
        pos += len(word)
    out, done = [], 0
    for start, end in spans:
        out.append(text[done : place[start][0]])
        done = place[end - 1][1]
    out.append(text[done:])
    return b"".join(out)


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", **options) -> DataFrame:
    """`docs` less those contaminated by coverage; hit spans are cut from the rest.

    A document with a hit word in twenty or more goes; in others the hit spans,
    each at least one window long, are cut out of the text, and `length_col`, if
    there is one of that name, gets the length left.  Columns stay as they were,
    as do rows without a hit.
    """
    own = {"words_col": "__n_words", "spans_col": "__hit_spans", "items_col": "__hit_items"}
    found = decontaminate(docs, benchmark, text_col, **own, **options)
    kept = found.filter(~is_contaminated(hit_words(F.col("__hit_spans")), F.col("__n_words")))
    columns = docs.columns

    def run(batches):
        for b in batches:
            new = {c: b.column(c) for c in columns}
            spans = b.column("__hit_spans").to_pylist()
            if any(spans):
                cut = [without_spans(t.encode(), [(x["start"], x["end"]) for x in s]).decode() if s else t for t, s in zip(new[text_col].to_pylist(), spans)]
                new[text_col] = pa.array(cut, new[text_col].type)
                if length_col in new:
                    new[length_col] = pa.array([len(t) if s else n for t, s, n in zip(cut, spans, new[length_col].to_pylist())], new[length_col].type)
            yield pa.RecordBatch.from_arrays(list(new.values()), schema=pa.schema([b.schema.field(c) for c in columns]))

    return kept.mapInArrow(run, docs.schema)

"""Operator 5: fuzzy repeated passages by collinear chains of shared seeds."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spindex.llm.common import FEW_ROWS, bounded_batches, bytes_of, discard, written
from spindex.llm.decontamination import WORDS

#: Words of a seed; a seed is kept if its hash is the least of WINDOW in a row, so
#: that SEED + WINDOW - 1 equal words always share one.
SEED, WINDOW = 5, 8
#: Seeds in a row that are linked as one, too; 36 equal words hold two such runs.
RUN = 3
#: A passage: words on either side, share of them that may be edited.
LEAST_WORDS, MOST_EDITS = 40, 0.2
#: Gap cost of a word between two seeds, against 1 for a seed.
GAP = 0.02
#: Words read beyond a chain on either side, and words in one stored block.
MARGIN, BLOCK = 64, 64
#: Extension: words skipped at once on either side, words that must be equal after that, and how far a score may fall.
SKIP, RESUME, DROP = 3, 3, 8
#: Seeds linked within a task before any are shuffled.
_AT_ONCE = 1 << 20
#: Edits sought diagonal by diagonal; more are sought on all diagonals at once, this many words ahead at most.
FEW, _AHEAD = 24, 256
#: Bytes of texts hashed at once.
_CHUNK = 1 << 19
_SKIPS = sorted((max(p, q), p, q) for p in range(SKIP + 1) for q in range(SKIP + 1) if p or q)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_PLACES = np.random.default_rng(3).integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SEEDS = "hash long, doc long, pos int, center long, center_pos int"
CHAINS = "doc long, d_from int, d_to int, center long, c_from int, c_to int, seeds int, anchors binary"
PASSAGES = "doc_id long, start long, end long, other_id long, other_start long, other_end long, seeds int, edits int, identity double"


def _hashes(shown: bytes, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words of texts that lie side by side in `shown`, words between spaces; each text ends at one of `ends`.

    A hash is the sum of a word's bytes, each times a random odd number of its
    place, mixed: two words have equal ones once in 2**57 times.
    """
    a = np.frombuffer(shown, np.uint8)
    letter = a != 32
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return [np.zeros(0, np.uint64)] * len(ends)
    size = stop - start
    offset = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(offset, size)
    h = np.add.reduceat(a[letter] * _PLACES[place % len(_PLACES)], offset)
    h = (h ^ h >> np.uint64(32)) * _MULTIPLIER
    h ^= h >> np.uint64(29)
    return np.split(h, np.searchsorted(start, ends[:-1]))


def word_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words, of about _CHUNK bytes at once."""
    held, size = [], 0

    def flushed():
        nonlocal held, size
        if held:
            yield from _hashes(b" ".join(held).translate(WORDS), np.cumsum([len(t) + 1 for t in held]))
        held, size = [], 0

    for t in texts:
        if len(t) > _CHUNK:
            yield from flushed()
            shown, parts, at = t.translate(WORDS), [], 0
            while at < len(shown):
                end = shown.find(b" ", min(at + _CHUNK, len(shown)))
                end = len(shown) if end < 0 else end
                parts += _hashes(shown[at:end], np.array([end - at]))
                at = end
            yield np.concatenate(parts)
            continue
        held.append(t)
        size += len(t)
        if size > _CHUNK:
            yield from flushed()
    yield from flushed()


def kept_least(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the values that are the least of some `window` in a row."""
    width = min(window, len(values))
    around = np.lib.stride_tricks.sliding_window_view(values, width)
    at = np.arange(len(values) - width + 1) + around.argmin(1)  # never falls
    return at[np.r_[True, at[1:] != at[:-1]]]


def minimizers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of the kept seeds of a word sequence."""
    n = len(h) - SEED + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    seed = np.zeros(n, np.uint64)
    for j in range(SEED):
        seed = (seed ^ h[j : j + n]) * _MULTIPLIER
        seed ^= seed >> np.uint64(31)
    at = kept_least(seed, WINDOW)
    return seed[at], at


def _mixed(*parts) -> np.ndarray:
    out = np.uint64(RUN)
    for p in parts:
        out = (out ^ p) * _MULTIPLIER
        out ^= out >> np.uint64(31)
    return out


def repeats(seed: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of seeds that come again at equal distances, numbered.

    The k-th seed of such a series has the distance and k in its hash, so that
    periodic passages are linked place by place, not all to one place.
    """
    order = np.argsort(seed, kind="stable")
    seed, at = seed[order], at[order]
    same = seed[1:] == seed[:-1]
    if not same.any():
        return seed[:0], at[:0]
    gap = np.where(same, np.diff(at), 0)
    begins = np.r_[True, gap[1:] != gap[:-1]] | np.r_[True, ~same[:-1]]
    place = np.arange(len(gap))
    number = place - np.maximum.accumulate(np.where(begins, place, 0)) + 1
    return _mixed(seed[1:][same], gap[same].astype(np.uint64), number[same].astype(np.uint64)), at[1:][same]


def seeds_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all that is linked in a word sequence: its minimizers,
    each RUN of them in a row, at its first, and series of equal ones.

    Only holders of the whole run meet under its hash, whatever other documents
    hold its seeds one by one.
    """
    seed, at = minimizers(h)
    n = max(0, len(seed) - RUN + 1)
    runs = _mixed(*(seed[j : j + n] for j in range(RUN)))
    again, again_at = repeats(seed, at)
    return np.r_[seed, runs, again], np.r_[at, at[:n], again_at]


def star(hash_: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Links of equal seeds, in rows sorted by (hash, doc, pos).

    Places (row, partner): each row with the first of its hash and with the one
    just before, where these are other documents'.  The second link keeps groups
    together whose first member has lost some seeds to edits.
    """
    first = np.r_[True, hash_[1:] != hash_[:-1]]
    center = np.flatnonzero(first)[np.cumsum(first) - 1]
    row = np.arange(len(doc))
    to_first = row[doc != doc[center]]
    before = np.maximum(row - 1, 0)
    to_before = row[~first & (doc != doc[before]) & (doc[before] != doc[center])]
    return first, np.r_[to_first, to_before], np.r_[center[to_first], before[to_before]]


def _rows(hash_, doc, pos, center, center_pos) -> pa.RecordBatch:
    n = len(doc)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [none if hash_ is None else pa.array(hash_.view(np.int64)), pa.array(doc, pa.int64()), pa.array(pos, pa.int32()), none if center is None else pa.array(center, pa.int64()), pa.nulls(n, pa.int32()) if center is None else pa.array(center_pos, pa.int32())],
        ["hash", "doc", "pos", "center", "center_pos"],
    )


def local_seeds(docs: DataFrame) -> DataFrame:
    """Seeds of (doc, text), and links between those that meet in one task.

    Rows with a center are links; of equal seeds in a task's buffer only the
    first goes on as a seed, so that a passage of many documents is shuffled
    about once a task.
    """

    def run(batches):
        held: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []
        size = 0

        def linked():
            held.sort(key=lambda x: x[0])  # with a stable sort by hash, rows are in order of (hash, doc, pos)
            h, p = (np.concatenate(x) for x in zip(*(own for _, own in held)))
            d = np.repeat(np.array([doc for doc, _ in held], np.int64), [len(own[0]) for _, own in held])
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            first, row, to = star(h, d, p)
            yield _rows(h[first], d[first], p[first], None, None)
            if len(row):
                _, once = np.unique(_mixed(*(v.astype(np.uint64) for v in (d[row], p[row], d[to], p[to]))), return_index=True)
                row, to = row[once], to[once]  # a run's link may be a seed's
                yield _rows(None, d[row], p[row], d[to], p[to])

        for b in batches:
            for doc, h in zip(b.column("doc").to_pylist(), word_hashes(bytes_of(b, "text"))):
                own = seeds_of(h)
                if len(own[0]):
                    held.append((doc, own))
                    size += len(own[0])
                if size >= _AT_ONCE:
                    yield from linked()
                    held, size = [], 0
        if held:
            yield from linked()

    return docs.mapInArrow(run, SEEDS)


def shared_links(seeds: DataFrame) -> DataFrame:
    """Links of equal seeds of different tasks: all to the least document.

    Seeds come sorted and stream through, whatever the size of a group.
    """

    def run(batches):
        gone_on = []  # first and last row of the group that may go on
        for b in batches:
            h, d, p = (b.column(c).to_numpy() for c in ("hash", "doc", "pos"))
            if not len(h):
                continue
            gone_on = [r for r in gone_on if r[0] == h[0]]
            n = len(gone_on)
            if n:
                h, d, p = (np.r_[np.array([r[i] for r in gone_on], x.dtype), x] for i, x in enumerate((h, d, p)))
            first, row, to = star(h, d, p)
            row, to = row[row >= n], to[row >= n]  # the earlier rows have had their links
            if len(row):
                yield _rows(None, d[row], p[row], d[to], p[to])
            begin = int(np.flatnonzero(first)[-1])
            gone_on = [(h[i], d[i], p[i]) for i in dict.fromkeys((begin, len(h) - 1))]

    return seeds.select("hash", "doc", "pos").repartition("hash").sortWithinPartitions("hash", "doc", "pos").mapInArrow(run, SEEDS)


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Disjoint collinear chains of anchors sorted by (x, y), the best first.

    A chain grows in both coordinates.  Its score is its number of anchors less
    GAP for every word between them; a Fenwick tree over the ranks of y keeps
    the best score before each place, so that n anchors take n log n steps.
    """
    rank = {v: r for r, v in enumerate(sorted(set(y)), 1)}
    size = len(rank)
    tree = [(float("-inf"), -1)] * (size + 1)
    score, back = [0.0] * len(x), [-1] * len(x)
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:  # anchors of one x do not follow each other
            best, at = float("-inf"), -1
            r = rank[y[j]] - 1
            while r > 0:
                if tree[r][0] > best:
                    best, at = tree[r]
                r &= r - 1
            gain = best - GAP * (x[j] + y[j])
            score[j], back[j] = (1 + gain, at) if gain > 0 else (1.0, -1)
            j += 1
        for k in range(i, j):
            value, r = (score[k] + GAP * (x[k] + y[k]), k), rank[y[k]]
            while r <= size:
                if tree[r][0] < value[0]:
                    tree[r] = value
                r += r & -r
        i = j
    out, used = [], [False] * len(x)
    for end in sorted(range(len(x)), key=lambda k: (-score[k], k)):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = back[end]
        if len(chain) > 1:
            out.append(chain[::-1])
    return out


def _groups(batches, keys: list[str], columns: list[str]):
    """(key, {column: array}) of runs of equal keys in sorted batches."""
    held, now = [], None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        data = [b.column(c).to_pylist() if pa.types.is_binary(b.column(c).type) else b.column(c).to_numpy(zero_copy_only=False) for c in keys + columns]
        change = np.zeros(n, bool)
        for k in data[: len(keys)]:
            change[1:] |= k[1:] != k[:-1]
        starts = np.r_[0, np.flatnonzero(change)]
        for s, e in zip(starts, np.r_[starts[1:], n]):
            key = tuple(k[s] for k in data[: len(keys)])
            if key != now:
                if held:
                    yield now, held
                held, now = [], key
            held.append([c[s:e] for c in data[len(keys) :]])
    if held:
        yield now, held


def chained(links: DataFrame, least: int) -> DataFrame:
    """CHAINS of the links of each pair of documents that may cover `least` words."""

    def run(batches):
        out: list[tuple] = []
        for (doc, center), parts in _groups(batches, ["doc", "center"], ["pos", "center_pos"]):
            x, y = (np.concatenate(c) for c in zip(*parts))
            once = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            x, y = x[once].tolist(), y[once].tolist()
            if len(x) < 2:
                continue
            for c in chains(x, y):
                a, b = (x[c[0]], x[c[-1]] + SEED), (y[c[0]], y[c[-1]] + SEED)
                if min(a[1] - a[0], b[1] - b[0]) + 2 * MARGIN >= least:
                    out.append((doc, *a, center, *b, len(c), np.array([[x[k] for k in c], [y[k] for k in c]], "<i4").tobytes()))
            if len(out) > 4096:
                yield _table(out, _CHAIN_TYPES)
                out = []
        if out:
            yield _table(out, _CHAIN_TYPES)

    sorted_links = links.select("doc", "center", "pos", "center_pos").repartition("doc", "center").sortWithinPartitions("doc", "center", "pos", "center_pos")
    return sorted_links.mapInArrow(run, CHAINS)


_CHAIN_TYPES = pa.schema([("doc", pa.int64()), ("d_from", pa.int32()), ("d_to", pa.int32()), ("center", pa.int64()), ("c_from", pa.int32()), ("c_to", pa.int32()), ("seeds", pa.int32()), ("anchors", pa.binary())])
_PASSAGE_TYPES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("other_id", pa.int64()), ("other_start", pa.int64()), ("other_end", pa.int64()), ("seeds", pa.int32()), ("edits", pa.int32()), ("identity", pa.float64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def word_blocks(docs: DataFrame) -> DataFrame:
    """(doc, block, words): BLOCK words' 32-bit hashes at a time."""
    schema = pa.schema([("doc", pa.int64()), ("block", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, h in zip(b.column("doc").to_pylist(), word_hashes(bytes_of(b, "text"))):
                h = (h >> np.uint64(32)).astype("<u4").tobytes()
                out += [(doc, at // (4 * BLOCK), h[at : at + 4 * BLOCK]) for at in range(0, len(h), 4 * BLOCK)]
            if out:
                yield _table(out, schema)

    return docs.mapInArrow(run, "doc long, block int, words binary")


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits between two sequences, or most + 1 if there are more.

    Furthest-reaching points on diagonals: an edit more moves each on by a word,
    and then over all equal words that follow.  No more diagonals than edits are
    reached, so none is left out.
    """
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > most:
        return most + 1
    unequal: dict[int, list[int]] = {}

    def reach(k: int, i: int) -> int:
        """From place i of `a` on diagonal k, the next place where the words differ or end."""
        if k not in unequal:
            first, last = max(0, -k), min(n, m - k)
            unequal[k] = [*(np.flatnonzero(a[first:last] != b[first + k : last + k]) + first).tolist(), max(first, last)]
        at = unequal[k]
        return at[bisect_left(at, i)] if i <= at[-1] else at[-1]

    far = {0: reach(0, 0)}
    for edits in range(min(most, FEW) + 1):
        if far.get(goal, -1) >= n:
            return edits
        moved = {}
        for k in range(max(-edits - 1, -n), min(edits + 1, m) + 1):
            i = max(far.get(k, -2) + 1, far.get(k - 1, -1), far.get(k + 1, -2) + 1)
            if i >= max(0, -k):
                moved[k] = reach(k, i)
        far = moved
    return _many_edits(a, b, most) if most > FEW else most + 1


def _many_edits(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The same for many edits, all diagonals of a step at once."""
    n, m = len(a), len(b)
    goal = m - n
    _, same = np.unique(np.r_[a, b], return_inverse=True)
    counts = [np.bincount(s, minlength=int(same.max()) + 1) for s in (same[:n], same[n:])]
    if max(n, m) - int(np.minimum(*counts).sum()) > most:  # a word without a counterpart is an edit
        return most + 1
    ahead = np.arange(_AHEAD)
    a, b = np.r_[same[:n], np.full(_AHEAD, -1)], np.r_[same[n:], np.full(_AHEAD, -2)]

    def reach(k: np.ndarray, i: np.ndarray) -> np.ndarray:
        going, width = np.arange(len(k)), 1
        while len(going):
            at = i[going, None] + ahead[:width]
            differ = a[at] != b[at + k[going, None]]
            ends = differ.any(1)
            i[going] += np.where(ends, differ.argmax(1), width)
            going, width = going[~ends], min(4 * width, _AHEAD)
        return i

    none = -n - m - 2
    far = np.full(2 * most + 5, none)  # of diagonal k at k + zero
    zero = most + 2
    far[zero] = reach(np.zeros(1, int), np.zeros(1, int))[0]
    for edits in range(most + 1):
        if far[goal + zero] >= n:
            return edits
        left = most - edits - 1  # edits after the next one, to get to the last diagonal
        k = np.arange(max(-edits - 1, -n, goal - left), min(edits + 1, m, goal + left) + 1)
        at = k + zero
        i = np.minimum(np.maximum(np.maximum(far[at] + 1, far[at - 1]), far[at + 1] + 1), np.minimum(n, m - k))
        met = i >= np.maximum(0, -k)
        far = np.full(len(far), none)
        far[at[met]] = reach(k[met], i[met])
    return most + 1


def extension(x: list[int], y: list[int]) -> tuple[int, int]:
    """Words to take in from both sequences: the best prefix pair, an equal word
    counting 1 and an edited one -2, until the score falls DROP below the best."""
    i = j = score = best = 0
    took = (0, 0)
    while i < len(x) and j < len(y) and score > best - DROP:
        if x[i] == y[j]:
            i, j, score = i + 1, j + 1, score + 1
            if score > best:
                best, took = score, (i, j)
            continue
        for skip, p, q in _SKIPS:
            ahead = x[i + p : i + p + RESUME]
            if len(ahead) == RESUME and ahead == y[j + q : j + q + RESUME]:
                i, j, score = i + p, j + q, score - 2 * skip
                break
        else:
            break
    return took


def extensions(a: np.ndarray, b: np.ndarray, span: tuple[int, int, int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
    """Words to take in before and after a span (a0, a1, b0, b1)."""
    a0, a1, b0, b1 = span
    before = extension(a[max(0, a0 - MARGIN) : a0][::-1].tolist(), b[max(0, b0 - MARGIN) : b0][::-1].tolist())
    return before, extension(a[a1 : a1 + MARGIN].tolist(), b[b1 : b1 + MARGIN].tolist())


def align(a: np.ndarray, b: np.ndarray, a_span: tuple[int, int], b_span: tuple[int, int], most_edits: float) -> tuple[int, int, int, int, int]:
    """A chain's ends moved outwards over equal words; then (a0, a1, b0, b1, edits)."""
    a0, a1 = a_span
    b0, b1 = b_span
    before, after = extensions(a, b, (a0, a1, b0, b1))
    a0, a1, b0, b1 = a0 - before[0], a1 + after[0], b0 - before[1], b1 + after[1]
    return a0, a1, b0, b1, edit_distance(a[a0:a1], b[b0:b1], int(most_edits * max(a1 - a0, b1 - b0)))


def stretches(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, least: int, most_edits: float) -> list[tuple[int, int, int, int, int, int]]:
    """(a0, a1, b0, b1, edits, seeds): passages of a chain that has too many edits as a whole.

    Each gap between two anchors costs its edit distance.  Of the stretches of
    the chain within `most_edits` that no longer one holds, so many are taken
    that each anchor of any of them lies in one taken.
    """
    limit = int(most_edits * max(len(a), len(b))) + 1
    over = np.maximum(0, SEED - np.minimum(np.diff(x), np.diff(y)))  # anchors may overlap
    cost = [edit_distance(a[i:j], b[k:m], min(limit, max(j - i, m - k))) for i, j, k, m in zip((x[:-1] + SEED - over).tolist(), x[1:].tolist(), (y[:-1] + SEED - over).tolist(), y[1:].tolist())]
    split = np.flatnonzero(cost)
    first, last = np.r_[0, split + 1], np.r_[split, len(x) - 1]
    total = np.r_[0, np.cumsum(cost)][first]
    a_from, a_to, b_from, b_to = x[first], x[last] + SEED, y[first], y[last] + SEED
    before, after = zip(*[extensions(a, b, span) for span in zip(a_from.tolist(), a_to.tolist(), b_from.tolist(), b_to.tolist())])
    longest, reached = [], -1
    for i in range(len(first)):
        size = np.maximum(a_to[i:] - a_from[i], b_to[i:] - b_from[i])
        j = i + int(np.flatnonzero(total[i:] - total[i] <= most_edits * size)[-1])
        if j > reached:
            reached = j
            if min(a_to[j] - a_from[i] + before[i][0] + after[j][0], b_to[j] - b_from[i] + before[i][1] + after[j][1]) >= least:
                longest.append((i, j))
    out, covered = [], -1
    for n, (i, j) in enumerate(longest):
        start = max(i, covered + 1)
        if n + 1 < len(longest) and longest[n + 1][0] <= start:
            continue  # the next one holds `start` too and goes further
        covered = j
        for p, q in ((before[i], after[j]), (before[i], (0, 0)), ((0, 0), after[j]), ((0, 0), (0, 0))):
            a0, a1, b0, b1 = (int(v) for v in (a_from[i] - p[0], a_to[j] + q[0], b_from[i] - p[1], b_to[j] + q[1]))
            most = int(most_edits * max(a1 - a0, b1 - b0))
            if min(a1 - a0, b1 - b0) >= least and (edits := edit_distance(a[a0:a1], b[b0:b1], most)) <= most:
                out.append((a0, a1, b0, b1, edits, int(last[j] - first[i]) + 1))
                break
    return out


def aligned(found: DataFrame, docs: DataFrame, least: int, most_edits: float) -> DataFrame:
    """PASSAGES of the chains, from the blocks of words that they touch."""

    def asked(doc: str, low: str, high: str, side: int) -> DataFrame:
        first = F.floor(F.greatest(F.col(low) - MARGIN, F.lit(0)) / BLOCK).cast("int")
        last = F.floor((F.col(high) + MARGIN) / BLOCK).cast("int")
        blocks = found.select("*", F.lit(side).cast("int").alias("side"), first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
        anchors = F.when((F.lit(side) == 0) & (F.col("block") == F.col("first")), F.col("anchors"))  # once a chain
        return blocks.select("chain", "side", F.col(doc).alias("doc"), "block", anchors.alias("anchors"))

    wanted = asked("doc", "d_from", "d_to", 0).unionByName(asked("center", "c_from", "c_to", 1))
    holders = found.select("doc").unionByName(found.select(F.col("center").alias("doc"))).distinct()
    if holders.count() <= FEW_ROWS:  # else all documents' blocks go to the join
        docs = docs.join(F.broadcast(holders), "doc", "left_semi")
    met = wanted.join(word_blocks(docs), ["doc", "block"]).select("chain", "side", "block", "doc", "words", "anchors")

    def run(batches):
        out: list[tuple] = []
        for (chain,), parts in _groups(batches, ["chain"], ["side", "block", "doc", "words", "anchors"]):
            sides: list[list[bytes]] = [[], []]
            start, ids, anchors = [0, 0], [0, 0], None
            for part in parts:
                for side, block, doc, words, held in zip(*part):
                    if not sides[side]:
                        start[side], ids[side] = int(block) * BLOCK, int(doc)
                        if not side:
                            anchors = held
                    sides[side].append(words)
            if anchors is None or not sides[1]:
                continue
            a, b = (np.frombuffer(b"".join(s), "<u4") for s in sides)
            x, y = np.frombuffer(anchors, "<i4").reshape(2, -1).astype(np.int64) - np.array(start)[:, None]
            whole = align(a, b, (int(x[0]), int(x[-1]) + SEED), (int(y[0]), int(y[-1]) + SEED), most_edits)
            size = max(whole[1] - whole[0], whole[3] - whole[2])
            if min(whole[1] - whole[0], whole[3] - whole[2]) < least:
                continue
            for a0, a1, b0, b1, edits, n in [(*whole, len(x))] if whole[4] <= most_edits * size else stretches(a, b, x, y, least, most_edits):
                out.append((ids[0], a0 + start[0], a1 + start[0], ids[1], b0 + start[1], b1 + start[1], n, edits, round(1 - edits / max(a1 - a0, b1 - b0), 4)))
            if len(out) > 4096:
                yield _table(out, _PASSAGE_TYPES)
                out = []
        if out:
            yield _table(out, _PASSAGE_TYPES)

    return met.repartition("chain").sortWithinPartitions("chain", "side", "block").mapInArrow(run, PASSAGES)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS, most_edits: float = MOST_EDITS) -> DataFrame:
    """PASSAGES: each row a passage of a document, in words [start, end), and an
    equal or similar one of another document.

    Passages have `least` words or more on either side, and at most `most_edits`
    of them edited.  Equal seeds are linked to one place that holds them, first
    within a task, then among tasks, not all pairs: passages that several
    documents share form one connected group of rows, about one for each
    document.  Links of a pair of documents become collinear chains, and chains
    are aligned word by word; a chain with too many edits gives its longest
    stretches with few enough.

    Null, empty and short texts have no passages.  Rows without an id are left
    out; rows that repeat an id are one document, of which the longest text
    counts.  An empty table gives no rows.  Ids must be integers.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("text")).filter("doc is not null")
    repeated = own.groupBy("doc").count().filter("count > 1").select("doc")
    if not repeated.isEmpty():
        again = own.join(repeated, "doc", "left_semi").groupBy("doc").agg(F.max(F.struct(F.length("text").alias("n"), F.col("text").alias("text"))).alias("t")).select("doc", "t.text")
        own = own.join(repeated, "doc", "left_anti").unionByName(again)
    seeds = written(local_seeds(own), "seeds", **{"parquet.writer.version": "PARQUET_2_0"})  # sorted hashes as differences
    links = seeds.filter("center is not null").unionByName(shared_links(seeds.filter("center is null")))
    found = chained(links, least)
    found = written(found.withColumn("chain", F.xxhash64(*[F.col(c.split()[0]) for c in CHAINS.split(", ")])), "chains")
    discard(seeds)
    return aligned(found, own, least, most_edits)

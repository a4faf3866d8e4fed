"""Operator 1: sum-of-squares online packing of tokenised documents."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from spindex.llm.common import bounded_batches, renamed, texts_of

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


@functools.cache
def encoder(tokenizer: str, ranks: str, pattern: str) -> Callable[[str], bytes]:
    """Texts to little-endian uint32 ids by a byte-level BPE file.

    The file's vocabulary is read as ranks, which a faster library applies with
    the same result; added tokens of the file count as it says.
    """
    import tiktoken
    from tokenizers import Tokenizer

    added = {t.content: i for i, t in Tokenizer.from_file(tokenizer).get_added_tokens_decoder().items()}
    with open(ranks, "rb") as f:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=known, special_tokens=added)
    return lambda text: bpe.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


#: Fill levels of a window, and what a cut adds to the sum of squares that a move is judged by.
LEVELS, CUT_PRICE = 16, 1


class SumOfSquares:
    """Online packing by the sum-of-squares rule over a level array.

    count[h] is the number of partially filled windows at level h, a level being
    1 / LEVELS of a window.  A piece may begin a window, go into an open one of
    any level, or, where it is too large for that, fill it up and be cut there;
    what is left of it then begins a window, as far as the choice goes.  The move
    that makes sum(count**2), plus CUT_PRICE for a cut, smallest is taken; of
    equal ones a new window before an open one, that before a cut, then the one
    that leaves the fullest window, or the smallest rest.  A level is stood for
    by the window put there last.  Counts at a level make a cut worth its price,
    so few windows are open at any time, whatever the sizes.
    """

    def __init__(self, window: int, levels: int = LEVELS, cut_price: float = CUT_PRICE):
        self.window, self.levels, self.cut_price = window, min(levels, window), cut_price
        self.count = [0] * self.levels
        self.at: list[list[tuple[int, list]]] = [[] for _ in range(self.levels)]

    def level(self, fill: int) -> int:
        return fill * self.levels // self.window

    def choose(self, size: int) -> int | None:
        """The level whose window takes a piece of `size`, or None for a new one."""
        count, window = self.count, self.window
        best, found = (2 * count[self.level(size)] + 1, 0, 0), None
        for h, n in enumerate(count):
            if not n:
                continue
            over = self.at[h][-1][0] + size - window
            if over > 0:
                left = self.level(over)
                move = (1 - 2 * n + 2 * (count[left] - (left == h)) + 1 + self.cut_price, 2, over)
            elif not over:
                move = (1 - 2 * n, 1, 0)
            else:
                to = self.level(window + over)
                move = (2 * (count[to] - n) + 2 if to != h else 0, 1, -over)
            if move < best:
                best, found = move, h
        return found

    def take(self, level: int) -> tuple[int, list]:
        self.count[level] -= 1
        return self.at[level].pop()

    def put(self, fill: int, pieces: list) -> None:
        level = self.level(fill)
        self.count[level] += 1
        self.at[level].append((fill, pieces))

    def open(self) -> int:
        return sum(self.count)

    def emptiest(self) -> tuple[int, list]:
        return self.take(next(h for h, n in enumerate(self.count) if n))


def pack_partition(docs: Iterator[tuple[int | None, bytes]], window: int, base: int) -> Iterator[tuple]:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    Whole windows are cut from a document first; the rest is placed by the
    sum-of-squares rule.  At the end the pieces of the emptiest window are placed
    again, by the same rule, until one is left open; that one is dealt to windows
    filled to powers of two, which need no padding.
    """
    rule, next_id = SumOfSquares(window), base

    def rows(pieces: list[tuple]) -> Iterator[tuple]:
        nonlocal next_id
        offset = 0
        for doc, start, total, ids in pieces:
            yield doc, start, len(ids) // 4, total, next_id, offset, ids
            offset += len(ids) // 4
        next_id += 1

    def placed(doc, start: int, total: int, ids: bytes, may_open: bool = True) -> Iterator[tuple]:
        while ids:
            size = len(ids) // 4
            level = rule.choose(size)
            if level is None and not may_open and rule.open():
                level = max(h for h, n in enumerate(rule.count) if n)
            fill, pieces = (0, []) if level is None else rule.take(level)
            n = min(size, window - fill)
            pieces.append((doc, start, total, ids[: 4 * n]))
            if fill + n == window:
                yield from rows(pieces)
            else:
                rule.put(fill + n, pieces)
            start, ids = start + n, ids[4 * n :]

    for doc, ids in docs:
        total, start = len(ids) // 4, 0
        while total - start >= window:
            yield from rows([(doc, start, total, ids[4 * start : 4 * (start + window)])])
            start += window
        yield from placed(doc, start, total, ids[4 * start :])
    while rule.open() > 1:
        _, pieces = rule.emptiest()
        for piece in pieces:
            yield from placed(*piece, may_open=False)
    left, pieces = rule.emptiest() if rule.open() else (0, [])
    pieces.reverse()
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        taken = []
        while room:
            doc, start, total, ids = pieces.pop()
            n = min(room, len(ids) // 4)
            taken.append((doc, start, total, ids[: 4 * n]))
            if 4 * n < len(ids):
                pieces.append((doc, start + n, total, ids[4 * n :]))
            room -= n
        yield from rows(taken)


def pack(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack every document of `docs` into windows of `window` tokens.

    One row for each piece: the document, where the piece starts in it, its
    length, its document's number of tokens, the window (sequence_id) and the
    place in it (offset), and the ids as little-endian uint32.  `tokenizer` is a
    byte-level BPE file of the tokenizers library, `ranks` and `pattern` the same
    vocabulary as ranks and its splitting pattern.  Every partition
    packs its own stream without a shuffle and holds a few unfinished windows; a
    lost task packs the same rows again.

    Null text: an empty document (`end_id` alone).  Null ids stay null.
    Repeated rows are packed each.  An empty table gives no rows.  Other columns
    are ignored.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(tokenizer, ranks, pattern)
        end = np.array([end_id], "<u4").tobytes()

        def stream():
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), texts_of(b, "text")):
                    yield doc, encode(text or "") + end

        out = []
        size = 0
        for row in pack_partition(stream(), window, TaskContext.get().partitionId() << 36):
            out.append(row)
            size += len(row[6])
            if size >= 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ARROW)], schema=_ARROW)

    return renamed(docs, doc_id=id_col, text=text_col).mapInArrow(run, SCHEMA)

"""Postings of whole documents, made within each document, over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindex.functions.text import ACCENTED, FOLDED
from spindex.operators.postings import check_weight, good_word, weight_of
from spindex.schema import DEFAULT_WEIGHT, POSTINGS, WORD_LENGTH

#: Bytes of texts that are worked on at once, as far as documents allow; rows of an Arrow batch that goes back.
IN_BYTES, OUT_ROWS = 1 << 20, 100_000
#: Postings that are cut into blocks by key at once.
PACK_ROWS = 300_000
_TOKEN_BYTE = [chr(i) in "abcdefghijklmnopqrstuvwxyz0123456789" for i in range(256)]


def _tokens(texts):
    """Tokens of lower-cased texts, as functions.text.tokens has them: one array, and the number of each text's."""
    import numpy as np
    import pyarrow as pa

    texts = texts.cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    # every accented letter is two bytes, the first of which is the same one, and becomes a single one
    accent = np.zeros(256, np.uint8)
    for letter, plain in zip(ACCENTED, FOLDED):
        accent[letter.encode()[1]] = ord(plain)
    lead = np.flatnonzero(data == ACCENTED[0].encode()[0])
    lead = lead[accent[data[lead + 1]] > 0]
    if len(lead):
        data = data.copy()
        data[lead + 1] = accent[data[lead + 1]]
        data = np.delete(data, lead)
        bounds = bounds - np.searchsorted(lead, bounds)
    inside = np.array(_TOKEN_BYTE)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < bounds[1:]]
    begins[edges] = inside[edges]
    at = np.flatnonzero(begins)
    letters = data[inside]
    cuts = np.append(np.cumsum(inside)[at] - 1, len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(letters))
    short = np.diff(cuts) < WORD_LENGTH
    if not short.all():
        words, at = words.filter(pa.array(short)), at[short]
    return words, np.diff(np.searchsorted(at, bounds))


def _posted(batch, weight: int):
    """Postings of a batch of texts or weighted words that holds all texts of its documents, side by side."""
    import numpy as np
    import pyarrow as pa

    ids, none = batch["doc_id"].fill_null(0).to_numpy(), batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
    if "text" in batch.schema.names:
        words, lengths = _tokens(batch["text"])
        weights = np.full(len(words), weight, np.int64)
    else:
        words, lengths = batch["words"].flatten(), batch["words"].value_lengths().to_numpy().astype(np.int64)
        weights = batch["weights"].flatten().to_numpy().astype(np.int64)
    words = words.dictionary_encode()
    n = len(words)
    row = np.repeat(np.arange(len(ids)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(ids) else np.zeros(0, np.int64)
    pos = np.arange(n) - first[row]
    sizes = np.bincount(row, weights, len(ids)).astype(np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])])[: len(ids)]
    key = (np.cumsum(new) - 1)[row] * (len(words.dictionary) + 1) + words.indices.to_numpy()
    # texts of a document apart, tokens come in order of place
    order = np.argsort(key, kind="stable") if new.all() else np.lexsort((weights, pos, key))
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[:n])
    if not len(starts):
        return None
    # of a word's texts that of the oldest batch, and there of the largest size
    by_age = np.lexsort((-sizes, batch["age"].to_numpy()))
    place = np.empty(len(ids), np.int64)
    place[by_age] = np.arange(len(ids))
    doc_size = sizes[by_age[np.minimum.reduceat(place[row[order]], starts)]]
    head = order[starts]
    ends = np.append(starts, n)
    hits = pa.StructArray.from_arrays([pa.array(pos[order].astype(np.int32)), pa.array(weights[order].astype(np.int16))], ["pos", "weight"])
    columns = [
        words.dictionary.take(words.indices.take(pa.array(head))), batch["doc_id"].take(pa.array(row[head])), pa.array(doc_size), pa.array(np.diff(ends).astype(np.int32)),
        pa.array(np.add.reduceat(weights[order], starts)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), hits),
    ]
    return pa.RecordBatch.from_arrays(columns, POSTINGS.names)


def _whole(batches: Iterable) -> Iterator:
    """The same rows in small batches that part no two rows of one id."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for b in batches:
        if not b.num_rows:
            continue
        if held and held[-1]["doc_id"][-1] != b["doc_id"][0]:
            yield pa.concat_batches(held)
            held = []
        ids, none = b["doc_id"].fill_null(0).to_numpy(), b["doc_id"].is_null().to_numpy(zero_copy_only=False)
        new = np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1
        size = max(1, IN_BYTES * b.num_rows // max(1, b.nbytes))
        cuts = [0, *(new[np.unique(np.searchsorted(new, np.arange(size, b.num_rows, size)).clip(0, len(new) - 1))].tolist() if len(new) else []), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _maker(weight: int) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        for b in _whole(batches):
            out = _posted(b, weight)
            for at in range(0, out.num_rows if out is not None else 0, OUT_ROWS):
                yield out.slice(at, OUT_ROWS)

    return run


def _postings(docs: DataFrame, id_col: str, order_col: str | None, given: str, shown: list[Column], weight: int) -> DataFrame:
    """Texts meet by id, then each document's tokens are grouped in place: no token is a row, or is shuffled or sorted with others'."""
    age = F.lit(0) if order_col is None else F.col(order_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), age.cast("long").alias("age"), F.col(given).alias("given"))
    met = own.repartition("doc_id").sortWithinPartitions("doc_id")
    return met.select("doc_id", "age", *shown).mapInArrow(_maker(weight), T.StructType(POSTINGS.fields)).select("doc_id", "word", "doc_size", "tf", "sum_w", "hits")


def text_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = DEFAULT_WEIGHT, order_col: str | None = None) -> DataFrame:
    """build_postings of text_hits, for whole texts.

    With `order_col` a document may come in several batches, as in
    merge_postings: hits in one bag, for each word the size in the oldest batch
    that has it.
    """
    check_weight(weight)
    return _postings(docs, id_col, order_col, text_col, [F.lower(F.coalesce("given", F.lit(""))).alias("text")], weight)


def weighted_postings(docs: DataFrame, id_col: str = "doc_id", words_col: str = "words", order_col: str | None = None) -> DataFrame:
    """The same from ARRAY<STRUCT<word, weight>>, build_postings of weighted_hits."""
    words = F.coalesce("given", F.array().cast(docs.schema[words_col].dataType))
    columns = [F.transform(words, good_word).alias("words"), F.transform(words, lambda x: weight_of(x).cast("short")).alias("weights")]
    return _postings(docs, id_col, order_col, words_col, columns, DEFAULT_WEIGHT)


def _merged(batches: Iterator) -> Iterator:
    """Rows in order of word, document and age, those of one word and document as one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def one(b):
        word, doc = b["word"].fill_null(""), b["doc_id"].fill_null(0)
        n = b.num_rows
        differ = pc.or_(pc.not_equal(word.slice(1), word.slice(0, n - 1)), pc.not_equal(doc.slice(1), doc.slice(0, n - 1)))
        for c in ("word", "doc_id"):
            none = b[c].is_null()
            differ = pc.or_(differ, pc.not_equal(none.slice(1), none.slice(0, n - 1)))
        starts = np.flatnonzero(np.concatenate([[True], differ.to_numpy(zero_copy_only=False)]))
        if len(starts) == n:
            return b.select(POSTINGS.names)
        total = np.add.reduceat(b["hits"].value_lengths().to_numpy().astype(np.int64), starts)
        hits = b["hits"].flatten()
        pos, weights = hits.field("pos").to_numpy(), hits.field("weight").to_numpy()
        several = np.repeat(np.diff(np.append(starts, n)) > 1, total)
        group = np.repeat(np.arange(len(starts)), total)
        order = np.arange(len(pos))
        at = np.flatnonzero(several)
        order[at] = at[np.lexsort((weights[at], pos[at], group[at]))]
        ends = np.concatenate([[0], np.cumsum(total)]).astype(np.int32)
        bag = pa.StructArray.from_arrays([pa.array(pos[order]), pa.array(weights[order])], ["pos", "weight"])
        head = pa.array(starts)
        columns = {c: b[c].take(head) for c in ("word", "doc_id", "doc_size")}
        columns["tf"] = pa.array(np.add.reduceat(b["tf"].to_numpy(), starts).astype(np.int32))
        columns["sum_w"] = pa.array(np.add.reduceat(b["sum_w"].to_numpy(), starts))
        columns["hits"] = pa.ListArray.from_arrays(pa.array(ends), bag)
        return pa.RecordBatch.from_arrays([columns[c] for c in POSTINGS.names], POSTINGS.names)

    held = None
    for b in batches:
        b = b if held is None else pa.concat_batches([held, b])
        last = b.num_rows - 1
        while last > 0 and b["word"][last - 1] == b["word"][-1] and b["doc_id"][last - 1] == b["doc_id"][-1]:
            last -= 1
        if last > 0:
            yield one(b.slice(0, last))
        held = b.slice(max(last, 0)) if b.num_rows else held
    if held is not None and held.num_rows:
        yield one(held)


_BLOCK = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("block", T.BinaryType())])


def _pack(batches: Iterable) -> Iterator:
    import numpy as np
    import pyarrow as pa

    def blocks(held):
        b = pa.concat_batches(held)
        keys = b["key"].to_numpy()
        order = np.argsort(keys, kind="stable")
        b, keys = b.drop_columns(["key"]).take(pa.array(order)), keys[order]
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def written(rows) -> bytes:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows)
            return sink.getvalue().to_pybytes()

        data = [written(b.slice(i, j - i)) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(keys[cuts[:-1]]), pa.array(data, pa.binary())], _BLOCK.names)

    held: list = []
    n = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= PACK_ROWS:
            yield blocks(held)
            held, n = [], 0
    if held:
        yield blocks(held)


def _unpacker(names: list[str]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list = []
        n = 0
        for b in batches:
            for block in b["block"]:
                rows = pa.ipc.open_stream(block.as_buffer()).read_next_batch()
                held.append(pa.RecordBatch.from_arrays(rows.columns, names))
                n += rows.num_rows
                if n >= OUT_ROWS // 4:
                    yield pa.concat_batches(held)
                    held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    return run


def dealt(rows: DataFrame, key: Column, exchange: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Postings (and their `age`) after `exchange`, which deals the column `key`; they travel as blocks of columns, in a third of the bytes."""
    columns = [c for c in (*POSTINGS.names, "age") if c in rows.columns]
    schema = T.StructType([*POSTINGS.fields, *([T.StructField("age", T.IntegerType())] if "age" in columns else [])])
    typed = [F.col(c).cast("int").alias(c) if c == "age" else F.col(c) for c in columns]
    packed = rows.select(*typed, key.cast("int").alias("key")).mapInArrow(_pack, _BLOCK)
    return exchange(packed).mapInArrow(_unpacker(columns), schema)


def merge_sorted(batches: DataFrame, order_col: str, partitions: int) -> DataFrame:
    """merge_postings for very many rows: one exchange to so many tasks and one sort in each, no aggregation."""
    rows = batches.select(*POSTINGS.names, F.col(order_col).alias("age"))
    own = dealt(rows, F.pmod(F.xxhash64("doc_id"), F.lit(partitions)), lambda df: df.repartitionById(partitions, F.col("key")))
    return own.sortWithinPartitions("word", "doc_id", "age").drop("age").mapInArrow(_merged, T.StructType(POSTINGS.fields))

"""Near copies by word shingles: MinHash bands propose pairs, exact Jaccard similarity decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spindex.llm.common import bounded_batches, bytes_of, discard, if_few, written
from spindex.llm.simhash import shingle_hashes

#: Words of a shingle, and the least similarity of near copies.
WORDS, SIMILARITY = 5, 0.8
#: MinHash bands and values in each: a pair at 0.8 shares no band once in 20 million times.
BANDS, ROWS = 32, 4
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of a set's least values; the band's number is in it."""
    least = np.full(len(_FACTORS), np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        mixed = hashes[at : at + 2048] * _FACTORS[:, None]
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, mixed.min(1))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _MULTIPLIER
        key ^= key >> np.uint64(29)
    return key


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets, as sorted arrays, have that Jaccard similarity or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= similarity * (len(x) + len(y) - both)


def band_buckets(docs: DataFrame, words: int) -> DataFrame:
    """(key, id, first): members of each bucket of documents that share a band, but for its smallest id, `first`.

    Of buckets with the same members one is taken; near copies share most of their bands.
    """

    def keyed(batches):
        for b in batches:
            rows = [(i, k) for i, t in zip(b.column("id").to_pylist(), bytes_of(b, "text")) if len(h := shingles(t, words)) for k in band_keys(h).view(np.int64).tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["id", "key"])

    keys = written(docs.mapInArrow(keyed, "id long, key long"), "bands")
    members = F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("members")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), members).filter("n > 1")
    one = written(shared.groupBy("n", "first", "members").agg(F.min("key").alias("key")).select("key", "first"), "buckets")
    out = written(keys.join(if_few(one), "key").filter("id <> first").select("key", "id", "first"), "members")
    discard(keys, one)
    return out


def like_the_first(docs: DataFrame, members: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id): members that are alike to the first one of a bucket."""

    def compared(batches):
        for b in batches:
            near = [alike(shingles(s, words), shingles(t, words), similarity) for s, t in zip(bytes_of(b, "s"), bytes_of(b, "t"))]
            yield pa.RecordBatch.from_arrays([b.column("id")], ["id"]).filter(pa.array(near, pa.bool_()))

    pairs = written(members.select("id", "first").distinct(), "pairs")
    texts = docs.select("id", "text")
    few = if_few(pairs)
    both = few.join(texts.toDF("id", "s"), "id").join(texts.toDF("first", "t"), "first").select("id", "s", "t")
    out = written(both.mapInArrow(compared, "id long").distinct(), "near")
    discard(pairs)
    return out


def like_another(docs: DataFrame, rest: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id): of bucket members (key, id), those alike to one of a smaller id that is not itself alike to a smaller one in its bucket.

    Buckets come sorted and stream through; held are their members that are
    like no other.
    """

    def sets(batches):
        for b in batches:
            rows = [(k, i, h) for i, t, keys in zip(b.column("id").to_pylist(), bytes_of(b, "text"), b.column("keys").to_pylist()) for h in [shingles(t, words).tobytes()] for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["key", "id", "hashes"])

    def led(batches):
        key, leaders = None, []
        for b in batches:
            gone = []
            for k, i, h in zip(b.column("key").to_pylist(), b.column("id").to_pylist(), b.column("hashes").to_pylist()):
                if k != key:
                    key, leaders = k, []
                own = np.frombuffer(h, np.uint64)
                if any(alike(own, other, similarity) for other in leaders):
                    gone.append(i)
                else:
                    leaders.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], ["id"])

    wanted = written(rest.groupBy("id").agg(F.collect_list("key").alias("keys")), "rest")
    sized = docs.join(if_few(wanted), "id").select("id", "text", "keys").mapInArrow(sets, "key long, id long, hashes binary")
    out = written(sized.repartition("key").sortWithinPartitions("key", "id").mapInArrow(led, "id long").distinct(), "led")
    discard(wanted)
    return out


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id): documents of `docs` (id long, text) to drop, so that no two that stay are alike.

    Each is alike to one of smaller id.  Members of a band's bucket are compared
    with its first one, in any task, so a large group of copies of that one is
    split freely; what is like no first one is compared within its buckets.
    Neither lists all pairs of a bucket.
    """
    members = band_buckets(docs, words)
    near = like_the_first(docs, members, words, similarity)
    left = members.join(if_few(near), "id", "left_anti").select("key", "id")
    left = written(left.join(left.groupBy("key").count().filter("count > 1").select("key"), "key", "left_semi"), "left")
    discard(members)
    if left.isEmpty():
        return near
    out = written(near.unionByName(like_another(docs, left, words, similarity)).distinct(), "gone")
    discard(near, left)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """`docs` without near copies: of any two alike, by shingles, to that similarity, one at least goes, never the one of smallest id in a group.

    Ids must be integers, each in one row; rows without an id or a word stay.
    An empty table gives no rows.  The result does not depend on partitions.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null")
    gone = if_few(near_copies(own, words, similarity)).select(F.col("id").alias("__gone_id"))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col("__gone_id"), "left_anti")

"""Operator 2: SimHash fingerprints, linked by pigeonhole blocks."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spindex.llm.common import bounded_batches, bytes_of, discard, written

BITS, SEED = 64, 42
#: Differing bits that still link.
DISTANCE = 4
#: Fingerprints of one bucket compared in one task; a larger bucket is split by more bits.
BUCKET = 20_000
#: Fingerprints that a bucket has by chance at most, before keys of more bits are taken.
CROWD = 64
#: Shingles turned into bits at once: 64 bytes each.
_AT_ONCE = 1 << 17


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every `words`-word shingle of the lower-cased text, repeats included."""
    import xxhash

    split = text.lower().split()
    if not split:
        return []
    joined = b" ".join(split)
    if len(split) <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, split), np.int64, len(split)) + 1
    end = np.cumsum(size)
    begin = end - size
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(begin[: 1 - words].tolist(), (end[words - 1 :] - 1).tolist())]


def fingerprint_batch(texts: list[bytes], words: int) -> np.ndarray:
    """Fingerprints as uint64; zero without words."""
    votes = np.zeros((len(texts), BITS), np.int64)
    total = np.zeros(len(texts), np.int64)
    pending: list[int] = []
    owners: list[int] = []
    sizes: list[int] = []

    def count() -> None:
        if pending:
            bits = np.unpackbits(np.array(pending, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first = np.cumsum([0, *sizes[:-1]])
            np.add.at(votes, owners, np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        pending.clear(), owners.clear(), sizes.clear()

    for i, t in enumerate(texts):
        hashes = shingle_hashes(t, words)
        total[i] = len(hashes)
        for at in range(0, len(hashes), _AT_ONCE):
            part = hashes[at : at + _AT_ONCE]
            pending += part
            owners.append(i)
            sizes.append(len(part))
            if len(pending) >= _AT_ONCE:
                count()
    count()
    return np.packbits(2 * votes > total[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp): a fingerprint for each row, as a signed 64-bit number.

    Null, empty or wordless text: zero.  Fewer than `words` words: one shingle.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for b in batches:
            fp = fingerprint_batch(bytes_of(b, "text"), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp long")


def _bits(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


@dataclass(frozen=True)
class Blocks:
    """Cuts of a fingerprint into `n` blocks: a close pair agrees on all but DISTANCE of them.

    More blocks give keys of more bits, and more keys for each fingerprint: 15
    of 22 bits with 6 blocks, 35 of 27 or more with 7, 70 of 32 with 8.
    """

    n: int

    @property
    def parts(self) -> list[tuple[int, int]]:
        """(lowest bit, width) of each, the wider ones first."""
        widths = [BITS // self.n + (k < BITS % self.n) for k in range(self.n)]
        return [(sum(widths[:k]), w) for k, w in enumerate(widths)]

    @property
    def choices(self) -> list[tuple[int, ...]]:
        """Blocks that a key is made of."""
        return list(combinations(range(self.n), self.n - DISTANCE))

    @property
    def key_bits(self) -> int:
        return sum(w for _, w in self.parts[: self.n - DISTANCE])

    @staticmethod
    def for_rows(rows: int) -> Blocks:
        """The fewest blocks with which a bucket has CROWD fingerprints at most by chance."""
        return next((b for b in map(Blocks, (6, 7)) if rows <= CROWD << min(sum(w for _, w in b.parts[-(b.n - DISTANCE) :]), 60)), Blocks(8))


def block_keys(fp: Column, blocks: Blocks) -> Column:
    """A key for each choice of blocks: pairs within DISTANCE share one at least."""

    def joined(number: int, chosen: tuple[int, ...]) -> Column:
        key = F.lit(number).cast("long")
        bits = blocks.key_bits
        key = F.shiftleft(key, bits)
        for k in chosen:
            low, width = blocks.parts[k]
            bits -= width
            key = key.bitwiseOR(F.shiftleft(_bits(fp, low, width), bits))
        return key

    return F.array(*[joined(n, c) for n, c in enumerate(blocks.choices)])


def finer_keys(fp: np.ndarray, key: int, blocks: Blocks) -> np.ndarray:
    """Keys (rows by 70) that split one bucket of `block_keys`.

    The DISTANCE blocks outside the bucket's choice are halved; a close pair
    agrees on as many of the halves.  All but 22 bits or less are then fixed,
    which bounds a bucket for good.
    """
    taken = blocks.choices[key >> blocks.key_bits]
    halves = []
    for k, (low, width) in enumerate(blocks.parts):
        if k not in taken:
            halves += [(low, width // 2), (low + width // 2, width - width // 2)]
    out = []
    for n, chosen in enumerate(combinations(halves, len(halves) - DISTANCE)):
        mixed = np.full(len(fp), np.uint64(key) * np.uint64(71) + np.uint64(n), np.uint64)
        for low, width in chosen:
            mixed = (mixed ^ (fp >> np.uint64(low) & np.uint64((1 << width) - 1))) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out.append(mixed)
    return np.stack(out, 1)


def spanning_links(fp: np.ndarray) -> list[tuple[int, int]]:
    """Links (fingerprint, root) that join what chains of close pairs join.

    Each fingerprint reached leaves the set, so a clump costs a pass or two over
    it, and as many links as it has members are made, not all its pairs.
    """
    links, rest = [], fp
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        reached = [root]
        while reached and len(rest):
            close = np.bitwise_count(rest ^ reached.pop()) <= DISTANCE
            if close.any():
                near = rest[close]
                links += [(x, root) for x in near]
                reached += list(near)
                rest = rest[~close]
    return links


def _link(keyed: DataFrame, bucket: int | None, blocks: Blocks) -> DataFrame:
    """Rows (a, b, finer) from (key, fp): links, or finer keys of large buckets.

    Buckets come sorted and stream through: one is held up to `bucket`
    fingerprints, of which those of a larger one leave with finer keys instead.
    """

    def run(batches):
        held: list[np.ndarray] = []
        held_key, n_held, large = None, 0, False

        def rows(a, b, finer):
            a, b = np.asarray(a, np.uint64).view(np.int64), np.asarray(b, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), finer))], ["a", "b", "finer"])

        def split(fp: np.ndarray):
            for at in range(0, len(fp), 2048):
                part = fp[at : at + 2048]
                keys = finer_keys(part, held_key, blocks)
                yield rows(np.repeat(part, keys.shape[1]), keys.ravel(), True)

        def add(key: int, fp: np.ndarray):
            """More of the held bucket, or, after its end, the next one."""
            nonlocal held, held_key, n_held, large
            if key != held_key:
                yield from flush()
                held_key = key
            held.append(fp)
            n_held += len(fp)
            if bucket is not None and n_held > bucket:
                large = True
                yield from split(np.concatenate(held))
                held = []

        def flush():
            nonlocal held, n_held, large
            if held and not large and (links := spanning_links(np.concatenate(held))):
                yield rows([x for x, _ in links], [x for _, x in links], False)
            held, n_held, large = [], 0, False

        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            if not len(key):
                continue
            edge = np.flatnonzero(np.diff(key)) + 1
            start, stop = np.r_[0, edge], np.r_[edge, len(key)]
            size = stop - start
            inner = np.ones(len(size), bool)
            inner[[0, -1]] = False  # those may go on in another batch
            two = start[inner & (size == 2)]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE]
            if len(two):
                yield rows(fp[two + 1], fp[two], False)
            whole = inner & (size > 2)
            if bucket is not None:
                whole &= size <= bucket
            links = []
            for s, e in zip(start[whole], stop[whole]):
                links += spanning_links(fp[s:e])
            if links:
                yield rows([x for x, _ in links], [x for _, x in links], False)
            other = np.flatnonzero(~inner if bucket is None else ~inner | (size > bucket))
            for i in other:
                yield from add(int(key[start[i]]), fp[start[i] : stop[i]].copy())
        yield from flush()

    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long, finer boolean")


def close_links(nodes: DataFrame, bucket: int = BUCKET, blocks: Blocks | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` at DISTANCE bits or fewer.

    Not all such pairs, but enough that chains of links join the same groups.
    The number of blocks follows the number of fingerprints.
    """
    blocks = blocks or Blocks.for_rows(nodes.count())
    first = written(_link(nodes.select(F.explode(block_keys(F.col("fp"), blocks)).alias("key"), "fp"), bucket, blocks), "links")
    links = first.filter("not finer").select("a", "b")
    finer = first.filter("finer").select(F.col("b").alias("key"), F.col("a").alias("fp"))
    if not finer.isEmpty():
        links = links.unionByName(_link(finer, None, blocks).select("a", "b"))
    out = written(links.distinct(), "close")
    discard(first)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node: the smallest node that it reaches.

    Alternating large and small stars: every round hangs each node's larger
    neighbours, then its smaller ones, on the smallest node around it; the stars
    are the components when a round changes nothing, after few rounds that grow
    with the logarithm of a component's size.  Each round is written to the
    shared folder; nothing but a count and a checksum reaches the driver.
    """

    def state(stars: DataFrame):
        return tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least_around(around: DataFrame) -> DataFrame:
        return around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))

    stars = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "stars")
    now = state(stars)
    while now[0]:
        around = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A table of its own, so that the join has two exchanges, of which AQE splits the hub of a large star.
        least = written(least_around(around), "least")
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = least_around(large)
        rest = large.join(nearest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, stars = stars, written(rest.unionByName(nearest.select("a", F.col("m").alias("b")).filter("a <> b")).distinct(), "stars")
        discard(last, least)
        before, now = now, state(stars)
        if before == now:
            break
    return stars.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs`.

    Fingerprints at DISTANCE differing bits or fewer are linked; component_id is
    the smallest doc_id that chains of links reach, the row's own included.
    Equal fingerprints are first reduced to one, by a partial aggregation, so a
    large group of copies weighs as one row in what follows.

    Null, empty or wordless texts have fingerprint zero and link like any other.
    Null ids never name a component, except one that has no other id.  Repeated
    rows stay repeated; an empty table gives no rows.
    """
    each = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(each.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "nodes")
    links = close_links(nodes, bucket)
    labels = components(links)
    discard(links)
    own = labels.select("label").distinct().select(F.col("label").alias("node"), "label")
    linked = nodes.join(labels.unionByName(own).withColumnRenamed("node", "fp"), "fp", "left")
    label = F.coalesce("label", "fp")
    several = linked.filter("label is not null or copies > 1").withColumn("label", label)
    least = several.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = several.join(least, "label").select("fp", "component_id", F.lit(True).alias("several"))
    found = each.join(named, "fp", "left")
    return found.select("doc_id", "fp", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """`docs` with one document of each near-duplicate group, that of smallest id.

    Rows that repeat an id count as one document, of which one row stays: that
    of the longest text, of equal ones the greatest, then the one whose columns
    are the greatest as JSON.  Rows without an id stay.
    """
    found = near_duplicates(docs, id_col, text_col, words)
    gone = found.filter("doc_id <> component_id").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    fates = written(gone.withColumn("gone", F.lit(True)).unionByName(repeated.withColumn("gone", F.lit(False))).groupBy("doc_id").agg(F.max("gone").alias("gone")), "fates")
    own = F.col(f"`{id_col}`")
    kept = docs.join(fates.select(F.col("doc_id").alias("__fate_id")), own == F.col("__fate_id"), "left_anti")
    again = docs.join(fates.filter("not gone").select(F.col("doc_id").alias("__fate_id")), own == F.col("__fate_id"), "left_semi")
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.struct(F.length(F.col(f"`{text_col}`")), F.col(f"`{text_col}`"), F.to_json(every))
    chosen = again.groupBy(own).agg(F.max_by(every, order).alias("__row"))
    return kept.unionByName(chosen.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]))

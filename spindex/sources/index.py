"""The stored index: segments of bucketed postings, published by a manifest.

    <path>/postings/segment=<name>/bucket=<b>/*.parquet   sorted by word, doc_id
    <path>/docs/segment=<name>/*.parquet
    <path>/manifest/<version>.json                        segments and the streams' last batches

A segment is visible once a manifest names it; the manifest of the highest
version counts.  Files are only added, so readers keep a whole snapshot until
`vacuum` deletes what no manifest names any more.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from spindex.operators.documents import dealt, merge_sorted
from spindex.operators.postings import bucket, build_postings, documents, merge_postings, scan
from spindex.schema import DOCS, POSTINGS
from spindex.sources import files

STORED = T.StructType([*POSTINGS.fields, T.StructField("bucket", T.IntegerType())])
_SEGMENT = T.StructField("segment", T.StringType())
#: Adjacent segments of one size that are merged; seconds that unnamed files are kept for readers and writers at work.
FAN_IN, KEEP_S = 8, 24 * 3600
#: Ids of documents in several segments that are broadcast at most; stored bytes of postings that one task merges.
MOST_IDS, MERGE_BYTES = 1_000_000, 16 << 20


@dataclass
class Manifest:
    """segments: documents of each by name, the oldest first; streams: the last batch of each."""

    version: int = 0
    segments: dict[str, int] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)


class StoredIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # Manifests

    def manifest(self) -> Manifest:
        """The newest manifest: one listing and one small file."""
        names = [e.name for e in files.listing(self.spark, f"{self.path}/manifest") if e.name.endswith(".json")]
        return Manifest(**json.loads(files.read_text(self.spark, f"{self.path}/manifest/{names[-1]}"))) if names else Manifest()

    def segments(self) -> list[str]:
        """Names of the visible segments, the oldest first."""
        return list(self.manifest().segments)

    def publish(self, change: Callable[[Manifest], None], attempts: int = 20) -> Manifest:
        """Apply `change` to the newest manifest and store it as the next version.

        A version is created only if it is not there, so a writer that comes
        second starts again from what the first one has published.
        """
        for _ in range(attempts):
            new = self.manifest()
            change(new)
            new.version += 1
            if files.create_text(self.spark, f"{self.path}/manifest/{new.version:012d}.json", json.dumps(new.__dict__)):
                return new
        raise RuntimeError(f"other writers kept publishing to {self.path}")

    # Writing

    def write(self, postings: DataFrame, name: str | None = None, docs: DataFrame | None = None, built: bool = False) -> str:
        """A new segment, not visible yet; one of the same name is replaced.

        Rows are dealt by bucket; AQE splits large buckets and joins small ones
        to its advisory partition size, so the number and size of files follow
        the data, not the number of tasks.  The documents are `docs`, or are read
        off the stored postings, whose texts are thus read once: in postings
        `built` from documents off those with a first place, which each text has.
        """
        name = name or uuid.uuid4().hex
        in_bucket = bucket(F.col("word"), self.buckets)
        rows = dealt(postings.select(*POSTINGS.names), in_bucket, lambda df: df.hint("rebalance", "key")).withColumn("bucket", in_bucket)
        rows.sortWithinPartitions("bucket", "word", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        if docs is None:
            stored = self._read("postings", STORED, [name])
            docs = documents(stored.filter(F.get(F.col("hits")["pos"], F.lit(0)) == 0) if built else stored)
        docs.select(*DOCS.names).hint("rebalance").write.mode("overwrite").parquet(f"{self.path}/docs/segment={name}")
        return name

    def write_hits(self, hits: DataFrame, name: str | None = None) -> str:
        """A segment from hits, dealt by document best."""
        return self.write(build_postings(hits), name)

    def size(self, name: str) -> int:
        """Documents of a segment."""
        return self._read("docs", DOCS, [name]).count()

    def add(self, names: list[str], batch: tuple[str, int] | None = None) -> None:
        """Make segments visible, all at once; `batch` notes a stream's batch number with them."""
        sizes = {n: self.size(n) for n in names}

        def change(m: Manifest) -> None:
            m.segments |= sizes
            if batch:
                m.streams[batch[0]] = max(batch[1], m.streams.get(batch[0], -1))

        self.publish(change)

    # Reading

    def _read(self, kind: str, schema: T.StructType, segments: list[str]) -> DataFrame:
        """One relation over the segments' files, whatever their number."""
        root = f"{self.path}/{kind}"
        return self.spark.read.schema(T.StructType([*schema.fields, _SEGMENT])).option("basePath", root).parquet(*[f"{root}/segment={s}" for s in segments])

    @staticmethod
    def _age(segments: list[str]) -> Column:
        return F.array_position(F.array(*[F.lit(s) for s in segments]), F.col("segment"))

    def postings(self, words: list[str] | None = None, segments: list[str] | None = None) -> DataFrame:
        """Visible postings, merged over segments; of `words` alone if given."""
        segments = self.segments() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], STORED)
        found = self._read("postings", STORED, segments)
        if words is not None:
            found = scan(found, words, buckets=self.buckets)
        if len(segments) == 1:
            return found.drop("segment")
        found = found.withColumn("age", self._age(segments))
        if words is not None:
            return merge_postings(found, "age").withColumn("bucket", bucket(F.col("word"), self.buckets))
        return self._merged(found, segments).withColumn("bucket", bucket(F.col("word"), self.buckets))

    def _merged(self, found: DataFrame, segments: list[str]) -> DataFrame:
        """All postings of segments as one; only those of documents that several segments have must meet."""
        again = self._read("docs", DOCS, segments).groupBy("doc_id").count().filter("count > 1").select("doc_id")
        n = again.limit(MOST_IDS + 1).count()
        own = found.select(*POSTINGS.names)
        if not n:
            return own
        size = sum(files.size(self.spark, f"{self.path}/postings/segment={s}") for s in segments)
        merge = lambda df: merge_sorted(df, "age", max(self.spark.sparkContext.defaultParallelism, size // MERGE_BYTES + 1)).select(*POSTINGS.names)
        if n > MOST_IDS:
            return merge(found)
        # null ids compare as equal here, as they do in a group
        ids = F.broadcast(again.withColumnRenamed("doc_id", "again"))
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        return merge(found.join(ids, same, "left_semi")).unionByName(found.join(ids, same, "left_anti").select(*POSTINGS.names))

    def docs(self, segments: list[str] | None = None) -> DataFrame:
        """Visible documents; one added again keeps its oldest size."""
        segments = self.segments() if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], DOCS)
        found = self._read("docs", DOCS, segments)
        return found.drop("segment") if len(segments) == 1 else found.groupBy("doc_id").agg(F.min_by("doc_size", self._age(segments)).alias("doc_size"))

    # Upkeep

    def _merge(self, merged: list[str], purge_before: int | None = None) -> str:
        """Rewrite adjacent segments as one, in their place."""
        kept = lambda df: df if purge_before is None else df.filter(F.col("doc_id") >= purge_before)
        name = self.write(kept(self.postings(segments=merged)), docs=kept(self.docs(merged)))
        size = self.size(name)

        def change(m: Manifest) -> None:
            if not all(s in m.segments for s in merged):
                raise RuntimeError("another writer has merged the same segments")
            kept = {}
            for s, n in m.segments.items():
                if s == merged[0]:
                    kept[name] = size
                if s not in merged:
                    kept[s] = n
            m.segments = kept

        self.publish(change)
        return name

    def compact(self, purge_before: int | None = None) -> str | None:
        """Rewrite all segments as one, without documents below `purge_before`.

        Segments published meanwhile stay beside it.
        """
        segments = self.segments()
        return self._merge(segments, purge_before) if segments else None

    def upkeep(self, fan_in: int = FAN_IN, keep_s: float = KEEP_S) -> int:
        """Merge runs of `fan_in` adjacent segments of one size tier, and vacuum; the number of merges.

        Tiers are powers of `fan_in` documents, so a document is rewritten about
        once a tier and segments stay few, however many batches have come.
        """
        merges = 0
        while run := self._run(self.manifest().segments, fan_in):
            self._merge(run)
            merges += 1
        if merges:
            self.vacuum(keep_s)
        return merges

    @staticmethod
    def _run(segments: dict[str, int], fan_in: int) -> list[str]:
        """The newest run of adjacent segments, as long as they come, of one tier."""
        run: list[str] = []
        tier = None
        for name, docs in reversed(segments.items()):
            own = int(math.log(max(docs, 1), fan_in) + 1e-9)
            if own != tier:
                if len(run) >= fan_in:
                    break
                run, tier = [], own
            run.append(name)
        return run[::-1] if len(run) >= fan_in else []

    def vacuum(self, keep_s: float = KEEP_S) -> list[str]:
        """Delete segments that the newest manifest does not name, and older manifests.

        Only what is older than `keep_s` seconds goes: readers may still hold the
        snapshot before, and writers have segments that are not published yet.
        """
        now = self.manifest()
        gone = [f"{kind}/{e.name}" for kind in ("postings", "docs") for e in files.listing(self.spark, f"{self.path}/{kind}") if e.age_s > keep_s and e.name.removeprefix("segment=") not in now.segments]
        gone += [f"manifest/{e.name}" for e in files.listing(self.spark, f"{self.path}/manifest") if e.age_s > keep_s and e.name < f"{now.version:012d}.json"]
        for g in gone:
            files.delete(self.spark, f"{self.path}/{g}")
        return gone

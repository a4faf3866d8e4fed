"""The registered queries of the training-data operators, and their SQL.

Each query applies one operator, with production parameters, to its whole table
and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindex.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    from spindex.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.simhash import hex_fingerprint, near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text_digest", "license_id")


def _op3_sql() -> str:
    from spindex.llm.licenses import canonical_sql, known_texts

    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in known_texts().items())
    known = f"SELECT sha256({canonical_sql('body')}) AS digest, min(id) AS license_id FROM (VALUES {values}) AS l(id, body) GROUP BY 1"
    return (
        f"WITH known AS ({known}), scanned AS (SELECT doc_id, sha256({canonical_sql('text')}) AS text_digest FROM documents) "
        "SELECT doc_id, text_digest, license_id FROM scanned LEFT JOIN known ON text_digest = digest AND digest <> sha256('')"
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.language_id import identify_language, is_held_out, train

    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.toxicity import is_held_out, score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.decontamination import decontaminate, hit_words, is_contaminated

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text").withColumn("n_hit", hit_words(F.col("hit_spans")))
    names = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.html_extraction import extract_text

    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.secrets import KINDS, find_secrets, span_text

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str):
        place = KINDS.index(kind)
        return F.size(F.filter("base_spans", lambda s: s["kind"] == place)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:-1]), F.sha2(span_text(F.col("base_spans")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spindex.llm.transport_stream import ALIGN, read_transport_stream, to_transport_stream

    read = read_transport_stream(to_transport_stream(table(spark, sf_dir, "documents")))
    shown = ["program", "table_pid", "stream_pid", "stream_type", "packets", "units", "sync_errors", "counter_errors", "crc_errors", "broken_units"]
    lists = {"pts_last": F.get("timestamps", F.size("timestamps") - 1), "random_access": F.concat_ws("/", F.col("random_access").cast("array<string>"))}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in shown], *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in lists.items()])
    return read.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -ALIGN, ALIGN)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_html_extraction": op8_html_extraction,
    "op9_secrets": op9_secrets,
    "op10_transport_stream": op10_transport_stream,
}

#: Windows of 13 words, or whole shorter items, joined to the same windows of documents.
_OP7_SQL = r"""
WITH ascii_low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM ascii_low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 13, 0) + 2), lambda i: array_to_string(w[i:i + 12], ' '))) AS gram FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram FROM d, sizes WHERE len(w) >= n),
m AS (SELECT DISTINCT doc_id, dw.n AS n, i, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op3_licenses": _op3_sql(), "op7_decontamination": _OP7_SQL}

"""Operator 9: secret scans by patterns and character Markov models.

Only DataFrame functions: the scan stays in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spindex.llm.common import hash_sample

# The base patterns, and the group and length that a match must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: name: pattern, group measured, least length, pattern of the same kept matches where the length can stand in it.
BASE = {"assign": (ASSIGN, 2, 6, None), "access": (ACCESS, 0, 20, r"AKIA[A-Z0-9]{16,}"), "hex": (HEX, 0, 24, r"[0-9a-f]{24,}")}
KINDS = [*BASE, "markov"]

#: What the Markov models judge: runs of their alphabet, of at least this length.
CANDIDATE_LENGTH = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}"
FIRST, WIDTH = ord("+"), ord("z") - ord("+") + 1
#: A candidate is a secret at this log-likelihood ratio in all, and on average over its transitions.
LEAST_RATIO, LEAST_MEAN = 15.0, 0.6
#: Documents from which ordinary words are taken; and labelled strings of each made kind.
SAMPLE_DOCS, SAMPLE_STRINGS = 2_000, 4_000

# Words that identifiers are made of.
IDENTIFIER_WORDS = (
    "get set add remove update delete create build make parse read write load store open close start stop begin end first last next prev "
    "user name value index count size length total list map array table row column field item node edge tree graph path file line text word "
    "string number input output request response handler service manager factory builder context config option default error warning message "
    "event state status type class method function module package version token key data model view test main client server session query result"
)


def labelled_strings(spark: SparkSession, n: int = SAMPLE_STRINGS) -> DataFrame:
    """(text, secret): random strings of several alphabets, and identifiers."""
    i = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("r"), i), 512)
    base64 = F.translate(F.regexp_replace(F.base64(F.unhex(digest)), r"[\r\n=]", ""), "", "")
    length = (F.lit(24) + F.pmod(F.xxhash64("id"), F.lit(24))).cast("int")
    random = {
        "base64": base64, "url": F.translate(base64, "+/", "-_"), "alphanumeric": F.regexp_replace(base64, "[+/]", ""),
        "upper": F.upper(F.regexp_replace(base64, "[+/]", "")), "hex": digest,
    }
    words = F.split(F.lit(IDENTIFIER_WORDS), " ")

    def word(k: int) -> Column:
        return F.element_at(words, F.pmod(F.xxhash64(F.lit(k), "id"), F.size(words)).cast("int") + 1)

    four = [word(k) for k in range(4)]
    number = F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(100)).cast("string")
    ordinary = {
        "camel": F.concat(four[0], *[F.initcap(w) for w in four[1:]]), "snake": F.concat_ws("_", *four), "kebab": F.concat_ws("-", *four),
        "path": F.concat(F.lit("/"), F.concat_ws("/", *four)), "constant": F.upper(F.concat_ws("_", *four)), "numbered": F.concat_ws("_", four[0], four[1], four[2], number),
    }
    ids = spark.range(n)
    both = [ids.select(F.substring(v, F.lit(1), length).alias("text"), F.lit(True).alias("secret")) for v in random.values()]
    both += [ids.select(v.alias("text"), F.lit(False).alias("secret")) for v in ordinary.values()]
    out = both[0]
    for d in both[1:]:
        out = out.unionByName(d)
    return out


def ordinary_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_DOCS) -> DataFrame:
    """(text, secret): alphabetic words of about `rows` documents, all ordinary."""
    some = hash_sample(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", rows)
    return some.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("text"), F.lit(False).alias("secret"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def train(samples: DataFrame) -> list[float]:
    """log P(next | character, random) - log P(next | character, ordinary), WIDTH by WIDTH.

    First-order models with half a count added to every transition of the
    alphabet.  The counts are aggregated; WIDTH * WIDTH * 2 numbers at most
    reach the driver.
    """
    starts = F.sequence(F.lit(1), F.octet_length("text") - 1)
    pair = F.explode(_let(F.col("text").cast("binary"), lambda b: F.transform(starts, lambda i: F.substring(b, i, F.lit(2)).cast("string"))))
    counted = samples.filter(F.length("text") > 1).select(pair.alias("pair"), "secret").groupBy("pair", "secret").count()
    counts = {True: {}, False: {}}
    alphabet = {chr(c) for c in range(FIRST, FIRST + WIDTH)}
    for r in counted.filter(F.col("pair").rlike(r"^[A-Za-z0-9+/_=-]{2}$")).collect():
        counts[r["secret"]][r["pair"]] = r["count"]
    logs = {}
    for label, c in counts.items():
        of_first: dict[str, int] = {}
        for p, n in c.items():
            of_first[p[0]] = of_first.get(p[0], 0) + n
        logs[label] = {a + b: math.log((c.get(a + b, 0) + 0.5) / (of_first.get(a, 0) + 0.5 * len(alphabet))) for a in alphabet for b in alphabet}
    return [round(logs[True][a + b] - logs[False][a + b], 3) for a in map(chr, range(FIRST, FIRST + WIDTH)) for b in map(chr, range(FIRST, FIRST + WIDTH))]


#: Elements of an array walked at once.
_BLOCK = 64
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))


def _walk(items: Column, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The spans that `step` gives over an array, in order.

    step(at, item) gives the next `at`, an int that is 0 first, a span, and
    whether the span counts.  An array that grows is copied at every step, so the
    array is walked in blocks: once for `at` at the begin of each, and then each
    for its spans.  Work and memory stay near the number of items, whatever that is.
    """

    def moved(at: Column, item: Column) -> Column:
        return step(at, item)[0].cast("int")

    def gathered(acc: Column, item: Column) -> Column:
        at, span, counts = step(acc["at"], item)
        return F.struct(at.cast("int").alias("at"), F.when(counts, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def over(blocks: Column) -> Column:
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, block: F.concat(acc, F.array(F.aggregate(block, F.element_at(acc, -1), moved))))

        def spans(begin: Column) -> Column:
            return F.transform(blocks, lambda block, i: F.aggregate(block, F.struct(F.get(begin, i).alias("at"), _none().alias("spans")), gathered, lambda acc: acc["spans"]))

        return F.flatten(_let(begins, spans))

    def walked(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(held) - 1) / _BLOCK).cast("int")), lambda b: F.slice(held, b * _BLOCK + 1, _BLOCK))
        return F.when(F.size(held) > 0, _let(blocks, over)).otherwise(_none())

    return _let(items, walked)


def _located(text: Column, kind: str, pattern: str, group: int, keep: Callable[[Column], Column]) -> Column:
    """Spans of the pattern's matches that `keep` accepts, in code points.

    The text split at the matches gives what stands between them, so a running
    sum of lengths gives their places.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(between.alias("between"), whole.alias("whole"), judged.alias("judged"))

    def step(at: Column, part: Column) -> tuple[Column, Column, Column]:
        start = at + F.length(part["between"])
        end = start + F.coalesce(F.length(part["whole"]), F.lit(0))
        return end, _span(start, F.lit(KINDS.index(kind)), end), part["whole"].isNotNull() & keep(part["judged"])

    return F.when(text.rlike(pattern), _walk(parts, step)).otherwise(_none())


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the base patterns, by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    kinds = []
    for kind, (pattern, group, least, short) in BASE.items():
        kinds.append(_located(text, kind, short or pattern, 0 if short else group, lambda x, n=least, s=short: F.lit(True) if s else F.length(x) >= n))
    return F.array_sort(F.concat(*kinds))


def ratio(candidate: Column, model: Column) -> Column:
    """Log-likelihood ratio of a string of the alphabet: above zero, random is likelier."""

    def summed(b: Column) -> Column:
        def place(i: Column) -> Column:
            return F.ascii(F.substring(b, i, F.lit(1)).cast("string")) - FIRST

        steps = F.sequence(F.lit(1), F.octet_length(b) - 1)
        return F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.element_at(model, place(i) * WIDTH + place(i + 1) + 1))

    return _let(candidate.cast("binary"), summed)  # a byte is found in one step, a character is not


def markov_spans(text: Column, model: list[float]) -> Column:
    """Array of (start, kind, end) of runs that look random to the models."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")
    return _located(F.coalesce(text, F.lit("")), "markov", CANDIDATE, 0, lambda x: ratio(x, table) >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * (F.length(x) - 1)))


def with_others(base: Column, others: Column) -> Column:
    """Base spans and those others that meet none of them, by start, then kind.

    Both are sorted and the others lie apart, so in one pass over all of them an
    other span meets a base span if one before it ends later than it starts, or
    the very next span is a base span within it.
    """
    other = F.lit(len(BASE))

    def met(every: Column) -> Column:
        def step(until: Column, item: Column) -> tuple[Column, Column, Column]:
            span, after = item["span"], item["after"]
            is_base = span["kind"] < other
            inside = F.coalesce((after["kind"] < other) & (after["start"] < span["end"]), F.lit(False))
            return F.when(is_base, F.greatest(until, span["end"])).otherwise(until), span, is_base | ~((until > span["start"]) | inside)

        return _walk(F.arrays_zip(every.alias("span"), F.slice(every, 2, F.size(every)).alias("after")), step)

    both = _let(F.array_sort(F.concat(base, others)), met)
    return F.when(F.size(others) == 0, base).when(F.size(base) == 0, others).otherwise(both)


def find_secrets(docs: DataFrame, model: list[float] | None = None, text_col: str = "text", id_col: str = "doc_id", base_col: str = "base_spans", spans_col: str = "spans") -> DataFrame:
    """`docs` with two more columns: base spans, and all spans.

    Spans are (start, kind, end) in code points, `kind` an index into KINDS, by
    start, then kind.  Markov spans are added where they meet no base span.
    Without a `model`, one is trained from made strings and the documents' words.
    No shuffle over the documents.

    Null text is empty and has no spans.  Repeated rows are scanned each.  An
    empty table gives no rows.  The new columns replace columns of the same names.
    """
    spark = docs.sparkSession
    if model is None:
        model = train(labelled_strings(spark).unionByName(ordinary_words(docs, text_col, id_col)))
    kept = docs.drop(base_col, spans_col)
    text = F.col(f"`{text_col}`")
    with_base = kept.withColumn(base_col, base_spans(text)).withColumn(spans_col, markov_spans(text, model))
    return with_base.withColumn(spans_col, with_others(F.col(f"`{base_col}`"), F.col(f"`{spans_col}`")))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mask: str = "<secret>") -> Column:
    """The text with each run of overlapping spans replaced by `mask`."""
    end = F.length(text)
    kept = _walk(F.concat(spans, F.array(_span(end, F.lit(0), end))), lambda at, s: (F.greatest(at, s["end"]), _span(at, F.lit(0), s["start"]), s["start"] >= at))

    def cut(points: Column) -> Column:
        def piece(p: Column) -> Column:  # a mark of the order of bytes goes before it, lest one in the text be taken for it
            own = F.substring(points, p["start"] * 4 + 1, (p["end"] - p["start"]) * 4)
            return F.decode(F.concat(F.unhex(F.lit("0000FEFF")), own), "UTF-32")

        return F.array_join(F.transform(kept, piece), mask)

    return F.when(F.size(spans) > 0, _let(F.encode(text, "UTF-32"), cut)).otherwise(text)


def redact_secrets(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: list[float] | None = None, length_col: str | None = "n_chars") -> DataFrame:
    """`docs` with every secret masked; columns stay as they were.

    All documents stay.  `length_col`, if there is one of that name, gets the
    masked text's length where something was masked.
    """
    found = find_secrets(docs, model, text_col, id_col, "__base_spans", "__spans")
    spans = F.col("__spans")
    found = found.withColumn("__masked", redacted(F.col(f"`{text_col}`"), spans))
    new = {text_col: F.col("__masked")}
    if length_col in docs.columns:
        new[length_col] = F.when(F.size(spans) > 0, F.length("__masked").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return found.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

"""Operator 6: a factorization machine over hashed terms scores toxicity."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spindex.llm.common import bounded_batches, discard, hash_sample, written

#: Hashed terms; terms that the machine weighs; factors of a term.
SPACE, TERMS, FACTORS = 1 << 20, 512, 8
#: Labelled documents fitted at most, of either label.
POSITIVE_ROWS, NEGATIVE_ROWS = 3_000, 5_000
#: Stems by which inflected and compound words share terms, in bytes.
STEMS = (4, 5, 6)
STEPS, RATE, RIDGE = 120, 0.1, 1e-3
#: A missed document of label 1 counts as so many of label 0 that are marked.
MISS_COST = 3.0
#: Words whose terms a worker remembers.
REMEMBERED = 400_000

_SPLIT = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_terms(word: bytes) -> list[int]:
    """Hashed terms of a word: itself and its stems."""
    import xxhash

    terms = [b"=" + word, *[b"^" + word[:n] for n in STEMS if len(word) >= n]]
    return [xxhash.xxh64_intdigest(t) % SPACE for t in terms]


class Terms:
    """Texts to the set of their hashed terms, kept to some terms if given."""

    def __init__(self, only: dict[int, int] | None = None):
        self.only = only
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _learn(self, word: bytes) -> tuple[int, ...]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        terms = word_terms(word)
        found = tuple(terms if self.only is None else [self.only[t] for t in terms if t in self.only])
        self.known[word] = found
        return found

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, set()
        for word in set(text.lower().encode().translate(_SPLIT).split()):
            found = known.get(word)
            if found is None:
                found = self._learn(word)
            if found:
                out.update(found)
        return sorted(out)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum of weights + sum over pairs of factor products)."""

    terms: dict[int, int]  # hashed term: place
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, places: list[int]) -> float:
        z = self.bias
        if places:
            v = self.factors[places]
            z += self.weights[places].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum()
        return float(1 / (1 + math.exp(-min(50.0, max(-50.0, z)))))


def fit(terms: list[int], rows: list[list[int]], labels: list[int], prior: float) -> FactorizationMachine:
    """Fit by full-batch Adam on logistic loss; `prior` is the true share of label 1.

    Without a row of either label: no weights, and `prior` as every score.
    """
    m, y = len(terms), np.array(labels, np.float32)
    places = {t: i for i, t in enumerate(terms)}
    logit = math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    if not m or not len(y) or y.min() == y.max():
        return FactorizationMachine(places, logit, np.zeros(m), np.zeros((m, FACTORS)))
    logit += math.log(MISS_COST)
    x = np.zeros((len(y), m), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    rng = np.random.default_rng(6)
    share = float(y.mean())
    start = math.log(share / (1 - share))
    p = [np.array([start], np.float32), np.zeros(m, np.float32), rng.normal(0, 0.02, (m, FACTORS)).astype(np.float32)]
    moment, square = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, STEPS + 1):
        b, w, v = p
        s = x @ v
        z = b[0] + x @ w + 0.5 * (s * s - x @ (v * v)).sum(1)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        back = x.T @ np.concatenate([g[:, None], g[:, None] * s], 1)
        grads = [np.array([g.sum()], np.float32), back[:, 0] + RIDGE * w, back[:, 1:] - v * back[:, :1] + RIDGE * v]
        for k, d in enumerate(grads):
            moment[k] = 0.9 * moment[k] + 0.1 * d
            square[k] = 0.99 * square[k] + 0.01 * d * d
            p[k] = p[k] - RATE * (moment[k] / (1 - 0.9**t)) / (np.sqrt(square[k] / (1 - 0.99**t)) + 1e-7)
    return FactorizationMachine(places, float(p[0][0]) + logit - start, p[1].astype(float), p[2].astype(float))


def is_held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic") -> FactorizationMachine:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    The labels are sampled first, by a hash of the id, so the sample that is
    joined to the documents has a fixed bound and may be broadcast.  Terms are
    counted by Spark; the driver gets the TERMS that tell most.  Rows that repeat
    an id are one document, of which the longest text counts, then the greatest;
    so are labels, of which the greater counts.  The driver never gets more rows
    than the sample has ids.
    """
    bounded_batches(docs.sparkSession)
    own = labels.select(F.col(f"`{label_id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    own = own.filter("label in (0, 1) and label_id is not null").filter(~is_held_out(F.col("label_id"))).groupBy("label_id").agg(F.max("label").alias("label"))
    count = dict(own.groupBy("label").count().collect())
    prior = count.get(1, 0) / max(1, sum(count.values()))
    some = hash_sample(own.filter("label = 1"), "label_id", POSITIVE_ROWS).unionByName(hash_sample(own.filter("label = 0"), "label_id", NEGATIVE_ROWS))
    texts = docs.select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{text_col}`").alias("text")).filter("label_id is not null")

    def run(batches):
        terms = Terms()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([terms(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], ["label", "terms"])

    met = texts.join(F.broadcast(some), "label_id")
    once = met.groupBy("label_id").agg(F.max("label").alias("label"), F.max(F.struct(F.length("text").alias("n"), F.col("text").alias("text"))).alias("t"))
    rows = written(once.select("label", "t.text").mapInArrow(run, "label int, terms array<int>"), "labelled")
    total = rows.agg(F.sum("label"), F.count(F.lit(1))).first()
    positive, negative = total[0] or 0, total[1] - (total[0] or 0)
    counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").alias("a"), F.count(F.lit(1)).alias("n"))
    p, q = (F.col("a") + 0.5) / (positive + 1.0), (F.col("n") - F.col("a") + 0.5) / (negative + 1.0)
    tells = F.abs(p - q) / F.sqrt((F.col("n") + 1.0) / (positive + negative + 2.0))
    terms = [r["term"] for r in counted.filter("n >= 3").orderBy(tells.desc(), "term").limit(TERMS).collect()]
    places = {t: i for i, t in enumerate(terms)}

    def chosen(batches):
        for b in batches:
            few = [[places[t] for t in ts if t in places] for ts in b.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(few, pa.list_(pa.int32()))], ["label", "terms"])

    x, y = [], []
    for r in rows.mapInArrow(chosen, "label int, terms array<int>").collect():  # (POSITIVE_ROWS + NEGATIVE_ROWS) rows
        x.append(r["terms"])
        y.append(r["label"])
    discard(rows)
    return fit(terms, x, y, prior)


def score_toxicity(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` with a score of 0 to 1; higher means that label 1 is likelier.

    Null and empty texts get the score of a text without known terms.  Repeated
    rows are scored each; an empty table gives no rows.  The new column replaces
    one of the same name.  No shuffle.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        machine = shared.value
        terms = Terms(machine.terms)
        for b in batches:
            scores = pa.array([machine.score(terms(t)) for t in b.column(text_col).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, scores], names=[*b.schema.names, score_col])

    return kept.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"`{score_col}` double"]))


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", at: float = 0.5) -> DataFrame:
    """`docs` without rows scored `at` or more; columns stay as they were."""
    return score_toxicity(docs, model, text_col, "__toxicity").filter(F.col("__toxicity") < at).select(*[F.col(f"`{c}`") for c in docs.columns])

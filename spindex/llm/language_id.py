"""Operator 4: language identification with hyperdimensional profiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from spindex.llm.common import bounded_batches, equal_shares

#: Dimensions of a vector, letters of an n-gram, letter classes.
DIMENSIONS, GRAM, CLASSES = 1024, 3, 64
#: Documents with a known language that are learned from.
SAMPLE_DOCS = 8_000
#: Sharpness of the score: how fast a cosine behind the best one loses its share.
SHARPNESS = 40.0
#: Characters that are turned into n-grams at once; a longer text is taken as pieces of that size.
_AT_ONCE = 1 << 21
_SEED = 4


def letter_vectors() -> np.ndarray:
    """A random vector of -1 and 1 for each letter class."""
    return (np.random.default_rng(_SEED).integers(0, 2, (CLASSES, DIMENSIONS), np.int8) * 2 - 1).astype(np.int8)


def _classes() -> np.ndarray:
    """Class of each code point below 65536: 0 for what is no letter.

    a to z have their own; other letters share the rest by a hash.
    """
    table = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = ord(chr(c).lower()[0])
        table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 0x9E3779B1 >> 7) % (CLASSES - 27)
    return table


class Profiler:
    """Texts to bundles: sums of n-gram vectors.

    The vector of an n-gram binds its letters' vectors, each permuted by its
    place in the n-gram, by multiplication.  Runs of non-letters count as one
    blank letter; a text begins and ends with one.
    """

    def __init__(self):
        self.letters = letter_vectors()
        self.table = _classes()

    def gram_vectors(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), DIMENSIONS), np.int8)
        for place in range(GRAM):
            letter = codes // CLASSES**place % CLASSES
            out *= np.roll(self.letters, place, 1)[letter]
        return out

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) and points.max() > 0xFFFF:
            rare = np.flatnonzero(points > 0xFFFF)
            points = points.copy()
            points[rare] = [0x4E00 if chr(p).isalpha() else 0 for p in points[rare]]
        letters = self.table[points]
        letters = np.concatenate([[0], letters, [0]]).astype(np.int64)
        letters = letters[np.r_[True, (letters[1:] > 0) | (letters[:-1] > 0)]]
        if not letters.any():
            return np.zeros(0, np.int64)
        codes = np.zeros(len(letters) - GRAM + 1, np.int64)
        for place in range(GRAM):
            codes += letters[place : len(letters) - GRAM + 1 + place] * CLASSES**place
        return codes

    def bundles(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(bundles, has letters) of the texts."""
        total = np.zeros((len(texts), DIMENSIONS), np.float32)
        lettered = np.zeros(len(texts), bool)
        pending: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def bundle() -> None:
            if not pending:
                return
            seen, where = np.unique(np.concatenate([c for _, c, _ in pending]), return_inverse=True)
            counts = np.zeros((len(pending), len(seen)), np.float32)
            done = 0
            for row, (_, c, n) in enumerate(pending):
                counts[row, where[done : done + len(c)]] = n
                done += len(c)
            for at in range(0, len(seen), 8192):
                vectors = counts[:, at : at + 8192] @ self.gram_vectors(seen[at : at + 8192]).astype(np.float32)
                for row, (i, _, _) in enumerate(pending):
                    total[i] += vectors[row]
            pending.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            for at in range(0, len(text), _AT_ONCE):
                codes = self._codes(text[at : at + _AT_ONCE])
                if len(codes):
                    lettered[i] = True
                    pending.append((i, *np.unique(codes, return_counts=True)))
                    size += len(pending[-1][1])
                    if size > 1 << 19 or len(pending) >= 512:
                        bundle()
                        size = 0
        bundle()
        return total, lettered


@dataclass
class Prototypes:
    """Unit vectors of the languages, less what all have in common."""

    languages: list[str]
    common: np.ndarray
    vectors: np.ndarray

    def predict(self, bundles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best language's place, score) by cosine with each prototype."""
        centred = _unit(_unit(bundles) - self.common)
        cosine = centred @ self.vectors.T
        e = np.exp(SHARPNESS * (cosine - cosine.max(1, keepdims=True)))
        return cosine.argmax(1), e.max(1) / e.sum(1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def is_held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_DOCS) -> Prototypes:
    """Prototypes of the languages of about `rows` documents outside the held-out fold.

    Every language gives an equal share, or all it has; with over `rows` of
    them, one document or so each.  Each document's bundle has the same weight.  Executors add up the bundles of
    a partition by language; the driver gets those sums one by one, never more
    than there are documents in the sample.
    """
    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    some = equal_shares(known.filter(F.col("lang").isNotNull() & ~is_held_out(F.col("id"))), "id", "lang", rows)

    def run(batches):
        profiler, sums = Profiler(), {}
        for b in batches:
            found, lettered = profiler.bundles(b.column("text").to_pylist())
            found = _unit(found)
            for lang, v, ok in zip(b.column("lang").to_pylist(), found, lettered):
                if ok:
                    sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "bundle"])

    parts = some.select("text", "lang").mapInArrow(run, "lang string, bundle array<double>")
    total: dict[str, np.ndarray] = {}
    for r in parts.toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.array(r["bundle"])
    languages = sorted(total)
    if not languages:
        return Prototypes([], np.zeros(DIMENSIONS), np.zeros((0, DIMENSIONS)))
    means = _unit(np.array([total[x] for x in languages]))
    common = means.mean(0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    return Prototypes(languages, common, _unit(means - common))


def identify_language(docs: DataFrame, model: Prototypes, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with the likeliest language and its score, 0 to 1.

    Whole texts; no shuffle.  Null text, text without a letter, and any text if
    no language was learned: `und` and score 0.  Ties go to the first language by
    name.  Repeated rows are judged each; an empty table gives no rows.  The new
    columns replace columns of the same names.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop(lang_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        profiler, prototypes = Profiler(), shared.value
        for b in batches:
            found, lettered = profiler.bundles(b.column(text_col).to_pylist())
            names, scores = ["und"] * len(lettered), np.zeros(len(lettered))
            if prototypes.languages and lettered.any():
                best, score = prototypes.predict(found)
                names = [prototypes.languages[i] if ok else "und" for i, ok in zip(best, lettered)]
                scores = np.where(lettered, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_col, score_col])

    return kept.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"`{lang_col}` string", f"`{score_col}` double"]))

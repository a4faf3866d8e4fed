"""Operator 8: main text of pages by a linear-chain conditional random field."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spindex.llm.common import bounded_batches
from spindex.llm.html_blocks import Block, Element, blocks
from spindex.llm.labelled_pages import MAIN, labelled_pages

#: Labelled pages fitted, steps and rates of the fit.
PAGES, STEPS, RATE, RIDGE = 1200, 120, 0.1, 1e-3


def nearest_features(at: Element | None) -> list[str]:
    """Tag and name words of the element around a block, and the tag of that around it."""
    if at is None:
        return ["own:"]
    return ["own:" + at.tag, *["own-name:" + w for w in at.names], *(["up:" + at.up.tag] if at.up else [])]


def path_features(at: Element | None) -> list[str]:
    """Those, and tags and name words of all elements around, each once."""
    out = nearest_features(at)
    while at is not None:
        out += at.fresh
        at = at.up
    return out


def text_features(b: Block) -> list[str]:
    """Length, links, sentence marks and the like, in steps."""
    t = b.text
    n = len(t)
    share = min(4, int(4 * b.linked / n + 0.5))
    words = t.count(" ") + 1
    marks = t.count(".") + t.count(",") + t.count("?") + t.count("!")
    out = [f"chars:{min(10, n.bit_length())}", f"words:{min(8, words.bit_length())}", f"links:{share}", f"marks:{min(5, marks.bit_length())}"]
    if t[-1] in ".!?":
        out.append("ends")
    if t[0] in "©®":
        out.append("copyright")
    if t[0].islower():
        out.append("lower")
    return out


@dataclass
class Crf:
    """Scores of features by label, and of label after label; 2 labels."""

    weights: dict[str, tuple[float, float]]
    step: list[list[float]]
    first: list[float]
    last: list[float]

    def _sum(self, features, start: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
        x, y = start
        for f in features:
            if (w := self.weights.get(f)) is not None:
                x, y = x + w[0], y + w[1]
        return x, y

    def _around(self, at: Element | None, scores: dict[Element, tuple[float, float]]) -> tuple[float, float]:
        """Score of the features of all elements around, each element's from that around it."""
        new = []
        while at is not None and at not in scores:
            new.append(at)
            at = at.up
        found = scores[at] if at is not None else (0.0, 0.0)
        for e in reversed(new):
            found = scores[e] = self._sum(e.fresh, found)
        return found

    def emission(self, b: Block, scores: dict[Element, tuple[float, float]] | None = None) -> tuple[float, float]:
        """Scores of a block by label; `scores` keeps those of the page's elements."""
        around = self._around(b.at, {} if scores is None else scores)
        return self._sum(text_features(b), self._sum(nearest_features(b.at), around))

    def decode(self, page: list[Block]) -> list[int]:
        """Viterbi: the labels of the best path."""
        if not page:
            return []
        (aa, ab), (ba, bb) = self.step
        scores: dict[Element, tuple[float, float]] = {}
        x, y = self.emission(page[0], scores)
        x, y = x + self.first[0], y + self.first[1]
        back = []
        for b in page[1:]:
            e, f = self.emission(b, scores)
            from_x, from_y = x + aa >= y + ba, x + ab > y + bb
            back.append((0 if from_x else 1, 0 if from_y else 1))
            x, y = e + (x + aa if from_x else y + ba), f + (x + ab if from_y else y + bb)
        label = int(y + self.last[1] > x + self.last[0])
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def fit(pages: list[tuple[list[Block], list[int]]]) -> Crf:
    """Maximum conditional likelihood by Adam over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    ids, owner, labels, length = [], [], [], []
    for found, label in pages:
        for b in found:
            own = [names.setdefault(f, len(names)) for f in path_features(b.at) + text_features(b)]
            ids += own
            owner += [len(labels)] * len(own)
            labels += [0]
            length += [0]
        labels[-len(found) :] = label
    ids, owner, y = np.array(ids), np.array(owner), np.array(labels)
    sizes = np.array([len(p[0]) for p in pages])
    n, m, t = len(y), len(names), int(sizes.max())
    page = np.repeat(np.arange(len(pages)), sizes)
    at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    alive = np.arange(t)[None, :] < sizes[:, None]
    rows = np.arange(len(pages))
    gold = np.zeros((n, 2))
    gold[np.arange(n), y] = 1
    follow = at > 0
    true_step = np.zeros((2, 2))
    np.add.at(true_step, (y[:-1][follow[1:]], y[1:][follow[1:]]), 1)
    true_first, true_last = gold[at == 0].sum(0), gold[at == sizes[page] - 1].sum(0)
    p = [np.zeros((m, 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    moment, square = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for k in range(1, STEPS + 1):
        w, step, first, last = p
        e = np.stack([np.bincount(owner, w[ids, c], n) for c in (0, 1)], 1)
        em = np.zeros((len(pages), t, 2))
        em[page, at] = e
        fore, aft = np.zeros_like(em), np.zeros_like(em)
        fore[:, 0] = em[:, 0] + first
        for i in range(1, t):
            here = em[:, i] + _log_sum(fore[:, i - 1, :, None] + step, 1)
            fore[:, i] = np.where(alive[:, i, None], here, fore[:, i - 1])
        z = _log_sum(fore[:, -1] + last, 1)
        aft[:] = last
        for i in range(t - 2, -1, -1):
            here = _log_sum(step + (em[:, i + 1] + aft[:, i + 1])[:, None, :], 2)
            aft[:, i] = np.where(alive[:, i + 1, None], here, last)
        marginal = np.exp(fore + aft - z[:, None, None])
        own = marginal[page, at]
        pair = np.exp(fore[:, :-1, :, None] + step + (em[:, 1:] + aft[:, 1:])[:, :, None, :] - z[:, None, None, None])
        diff = own - gold
        g = [
            np.stack([np.bincount(ids, diff[owner, c], m) for c in (0, 1)], 1) / len(pages) + RIDGE * w,
            ((pair * alive[:, 1:, None, None]).sum((0, 1)) - true_step) / len(pages) + RIDGE * step,
            (marginal[:, 0].sum(0) - true_first) / len(pages) + RIDGE * first,
            (marginal[rows, sizes - 1].sum(0) - true_last) / len(pages) + RIDGE * last,
        ]
        for i, d in enumerate(g):
            moment[i] = 0.9 * moment[i] + 0.1 * d
            square[i] = 0.99 * square[i] + 0.01 * d * d
            p[i] = p[i] - RATE * (moment[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-9)
    return Crf({f: (float(p[0][i, 0]), float(p[0][i, 1])) for f, i in names.items()}, p[1].tolist(), p[2].tolist(), p[3].tolist())


def parsed(pages: list[tuple[str, list[int]]]) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages as blocks; those whose blocks and labels disagree are an error."""
    out = []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {page[:200]}")
        out.append((found, labels))
    return out


@functools.cache
def default_model() -> Crf:
    return fit(parsed(labelled_pages(PAGES)))


def main_text(page: str, model: Crf) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, model.decode(found)) if label == MAIN)


def extract_text(pages: DataFrame, model: Crf | None = None, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """`pages` with the main text of each page in `out_col`.

    Each page is parsed to leaf blocks, which the model labels together; the
    blocks of the main text are joined by one newline.  Whole pages, no shuffle.

    Null or empty HTML, and pages without main text: an empty string.  Repeated
    rows are extracted each; an empty table gives no rows.  The new column
    replaces one of the same name.
    """
    bounded_batches(pages.sparkSession)
    kept = pages.drop(out_col) if out_col != html_col else pages
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        crf = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([main_text(h, crf) if h else "" for h in b.column(html_col).to_pylist()], pa.string())], names=[*b.schema.names, out_col])

    return kept.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], f"`{out_col}` string"]))

"""Toxicity: a linear softmax over averaged subword embeddings, trained jointly in numpy.

A text is lower-cased, everything but letters and digits becomes a blank, and all character 3- to 5-grams (a blank counts as
a word's edge) are hashed into a table of embeddings.  The bag of a passage of about 32 characters is averaged and goes
through a softmax of two classes; a document's score is that of its most toxic passage, so that a single sentence in a long
text counts as much as in a short one.  Passages cover the whole text.  Misspelt words share most of their grams with the
word they come from.

Training sees the label of the document only: first the average of the whole text is fitted, then the passage that the model
finds worst.  It uses a bounded sample: at most MAX_POSITIVE and MAX_NEGATIVE labelled rows in the order of a hash, of texts
of at most MAX_CHARS characters.  One eighth of them sets the slope and offset of the final logistic curve, where
each row counts for as many labelled rows of its class as the draw left it to stand for, so the bounds do not move the prior.
The trained model collapses to one number per gram bucket (256 KB), which is all that tasks need.

Null texts, empty ones and those without any gram get the share of label 1, with the same weights.  Without labelled rows every score is 0; with
one class only, it is that class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from soundfield.llm.shared import drawn, slices

MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 1500, 2500, 50_000
BITS, DIM, GRAMS = 16, 8, (3, 4, 5)
CELL, CELLS = 16, 2  # a passage is so many cells of so many characters
BATCH_CHARS = 1 << 19
RARE = 3e-5  # damps the steps of grams met a few times only
BLANK = 32

#: Letters and digits of the lower code points; all above count as letters.
WORD = np.array([chr(i).isalnum() for i in range(0x3000)])
ODD = np.array([2654435761, 2246822519, 3266489917, 668265263, 374761393], np.uint32)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (position, gram length), with 1 << BITS where there is no gram, and each text's first and last-plus-one cell.

    Every text starts with a blank and is filled up with blanks to whole cells.
    """
    codes, ends, at = [], [], 0
    for text in texts:
        c = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        n = -(-(len(c) + 2) // CELL) * CELL
        row = np.full(n, BLANK, np.uint32)
        row[1 : len(c) + 1] = c
        codes.append(row)
        ends.append(at := at + n // CELL)
    c = np.concatenate([*codes, np.full(max(GRAMS), BLANK, np.uint32)])
    low = c < len(WORD)
    word = ~low
    word[low] = WORD[c[low]]
    c = np.where(word, c, np.uint32(BLANK))
    n = len(c) - max(GRAMS)
    out = np.full((n, len(GRAMS)), 1 << BITS, np.int32)
    h = np.zeros(n, np.uint32)
    inner = np.ones(n, bool)
    for j in range(max(GRAMS)):
        h = h * np.uint32(31) + (c[j : j + n] ^ (c[j : j + n] >> 3)) * ODD[j]
        if j >= 2:
            inner &= word[j - 1 : j - 1 + n]
        if j + 1 in GRAMS:
            mixed = (h ^ (h >> 15)) * np.uint32(2246822519)
            out[:, GRAMS.index(j + 1)] = np.where(inner, (mixed >> (32 - BITS)).astype(np.int32), 1 << BITS)
    ends = np.array(ends)
    return out, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)


def passages(buckets: np.ndarray, first: np.ndarray, last: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the highest passage mean of `weight` (which has 0 for "no gram"), and the cells of that passage."""
    size = CELL * len(GRAMS)
    total = np.concatenate([[0.0], np.cumsum(weight[buckets].reshape(-1, size).sum(1, dtype=np.float64))])
    count = np.concatenate([[0], np.cumsum((buckets < 1 << BITS).reshape(-1, size).sum(1))])
    cell = np.arange(len(total) - 1)
    own_last = np.repeat(last, last - first)
    end = np.minimum(cell + CELLS, own_last)
    mean = (total[end] - total[cell]) / np.maximum(count[end] - count[cell], 1)
    mean[(cell > own_last - CELLS) & (cell != np.repeat(first, last - first))] = -np.inf
    best = np.maximum.reduceat(mean, first)
    at = np.flatnonzero(mean == np.repeat(best, last - first))
    at = at[np.searchsorted(at, first)]
    return best, at, end[at]


class Model:
    """One weight per gram bucket and a logistic curve over the worst passage."""

    def __init__(self, weight: np.ndarray, slope: float, offset: float, base: float, constant: float | None = None):
        self.weight, self.slope, self.offset, self.base, self.constant = weight, slope, offset, base, constant

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, start = np.empty(len(texts)), 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars < BATCH_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            buckets, first, last = grams(texts[start:stop])
            best, _, _ = passages(buckets, first, last, self.weight)
            found = np.add.reduceat((buckets < 1 << BITS).reshape(-1, CELL * len(GRAMS)).any(1), first) > 0
            out[start:stop] = np.where(found, 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -60, 60))), self.base)
            start = stop
        return out


def fit(texts: list[str], labels: list[int], epochs: int = 6, rate: float = 0.5, seed: int = 7, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """A row of label 0 or 1 stands for so many rows; the curve and the share for texts without grams weigh it so."""
    if not labels:
        return Model(np.zeros(0), 0, 0, 0, 0.0)
    if len(set(labels)) == 1:
        return Model(np.zeros(0), 0, 0, 0, float(labels[0]))
    rng = np.random.default_rng(seed)
    none = 1 << BITS
    table = np.zeros((none + 1, DIM), np.float32)  # a gram that training never met says nothing
    out, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2)
    square, y = np.full(none + 1, RARE), np.array(labels)
    rows_for = np.array(stands_for, float)[y]
    bags = [grams([t])[0].astype(np.uint16 if none < 1 << 16 else np.int32) for t in texts]
    order = rng.permutation(len(texts))
    held, used = order[: max(2, len(order) // 8)], order[len(order) // 8 :]
    step = 16
    width = CELL * len(GRAMS)
    for epoch in range(epochs):
        for at in range(0, len(used), step):
            group = rng.permutation(used)[:step] if epoch == 0 else used[at : at + step]
            weight = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
            joined = np.concatenate([bags[d] for d in group])
            last = np.cumsum([len(bags[d]) // CELL for d in group])
            first = np.concatenate([[0], last[:-1]])
            if epoch:  # the passage it finds worst
                _, first, last = passages(joined, first, last, weight)
            by_cell = joined.reshape(-1, width)
            rows = [(flat := by_cell[i:j].reshape(-1))[flat < none] for i, j in zip(first, last, strict=True)]
            size = np.array([max(len(r), 1) for r in rows])
            flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            mean = np.stack([np.bincount(owner, table[flat, k], len(rows)) for k in range(DIM)], 1) / size[:, None]
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p - np.eye(2)[y[group]]
            share = (wrong[:, 1] / size)[owner]  # the two classes' errors are opposite
            push = np.bincount(flat, share, none + 1)
            square += push**2
            table -= ((rate * push / np.sqrt(square))[:, None] * (out[:, 1] - out[:, 0])[None, :]).astype(np.float32)
            table[none] = 0
            out -= (rate * 0.5 * mean.T @ wrong / len(group)).astype(np.float32)
            bias -= rate * 0.1 * wrong.mean(0)
    weight = (table @ (out[:, 1] - out[:, 0])).astype(np.float64)
    top = np.array([passages(bags[d], np.zeros(1, np.int64), np.array([len(bags[d]) // CELL]), weight)[0][0] for d in held])
    slope, offset = _curve(top, y[held], rows_for[held])
    return Model(weight.astype(np.float32), slope, offset, float(np.average(y, weights=rows_for)))


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of least loss, held back by a small penalty."""
    scale = x.std() or 1.0
    u, w, b = (x - x.mean()) / scale, 0.0, 0.0
    share = weight / weight.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-(w * u + b)))
        g, h = share * (p - y), share * p * (1 - p)
        grad = np.array([(g * u).sum() + 1e-3 * w, g.sum()])
        hess = np.array([[(h * u * u).sum() + 1e-3, (h * u).sum()], [(h * u).sum(), h.sum() + 1e-6]])
        dw, db = np.linalg.solve(hess, grad)
        w, b = w - dw, b - db
    return float(w / scale), float(b - w * x.mean() / scale)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out (see the module's text)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    counts = dict.fromkeys((0, 1), 0) | {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    sample = drawn(known.where("label = 1"), MAX_POSITIVE, "doc_id").unionByName(drawn(known.where("label = 0"), MAX_NEGATIVE, "doc_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most 4000 rows of two numbers
    rows = texts.where(F.length("text") <= MAX_CHARS).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    rows.sort(key=lambda r: r.doc_id)
    stands_for = (max(1.0, counts[0] / MAX_NEGATIVE), max(1.0, counts[1] / MAX_POSITIVE))
    return fit([r.text for r in rows], [r.label for r in rows], stands_for=stands_for)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """`docs` with every column and `name`, the score in 0 to 1; a column that has that name already is replaced."""
    kept = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            scores = pa.array(model.scores(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`docs` without those that the model, trained on `labels`, finds toxic."""
    name = "toxicity_of_text"
    return scored(docs, train(docs, labels), name).where(F.col(name) < threshold).select(*docs.columns)

"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated temperature.

1. Words (letters, digits, runs of marks; capitals-only words and numbers are one word each) hash into BUCKETS.  A bucket has
   a fixed sparse random index vector.
2. Over all documents, a bucket's context vector is the sum of the index vectors of its neighbours up to REACH words away.
   Tasks sum whole matrices and a tree of fixed fan-in adds them, so what any task holds has a fixed size.
3. A document is the mean and the spread of its words' vectors, the mean product of neighbouring vectors (which tells prose
   from repetition), and its length and share of different words.
4. A network of one hidden layer and a softmax over it learns the labels from at most MAX_ROWS labelled rows, in the order of a
   hash.  One row in four stays out of the fit and sets the temperature that makes the probabilities honest.

Null and empty texts are documents without words.  Without labelled rows every score is 0.5; with one class, its label.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from soundfield.llm.shared import drawn, slices

BUCKETS, DIM, ONES, REACH, MAX_ROWS = 1 << 14, 32, 4, 2, 8000
BLOCKS, FAN_IN, BATCH_WORDS, CHUNK = 16, 32, 1 << 18, 1 << 16
WORD = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")

_rng = np.random.default_rng(20)
PLACES = np.stack([_rng.permutation(DIM)[:ONES] for _ in range(BUCKETS)])
SIGNS = _rng.choice([-1, 1], (BUCKETS, ONES))
INDEX = np.zeros((BUCKETS, DIM), np.float32)
INDEX[np.arange(BUCKETS)[:, None], PLACES] = SIGNS


class Buckets:
    """Words to buckets, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, int] = {}
        self.most = most

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text or "")
        for w in set(words).difference(self.known):
            if len(self.known) >= self.most:
                self.known.clear()
                return self.of_slowly(words)
            self.known[w] = self.bucket(w)
        return np.fromiter(map(self.known.__getitem__, words), np.int32, len(words))

    def of_slowly(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.bucket, words), np.int32, len(words))

    @staticmethod
    def bucket(w: str) -> int:
        shape = "0" if w[0].isdigit() else "AA" if len(w) > 1 and w.isupper() else w.lower()
        return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS


def _add_contexts(total: np.ndarray, b: np.ndarray, doc: np.ndarray) -> None:
    for step in range(1, REACH + 1):
        same = doc[step:] == doc[:-step]
        left, right = b[:-step][same], b[step:][same]
        for a, c in ((left, right), (right, left)):
            for k in range(ONES):
                total += np.bincount(a.astype(np.int64) * DIM + PLACES[c, k], SIGNS[c, k], BUCKETS * DIM).astype(np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, words, held, size = np.zeros(BUCKETS * DIM, np.int64), Buckets(), [], 0
    for batch in slices(batches):
        for text in batch.column("text").to_pylist():
            held.append(words.of(text))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                _add_contexts(total, np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]))
                held, size = [], 0
    if size:
        _add_contexts(total, np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]))
    part = TaskContext.get().partitionId()
    blobs = [x.astype("<i8").tobytes() for x in total.reshape(BLOCKS, -1)]
    yield pa.RecordBatch.from_arrays([pa.array([part] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], ["part", "block", "sums"])


def _added(key, rows):
    total = np.sum([np.frombuffer(x, "<i8") for x in rows["sums"]], axis=0, dtype=np.int64)
    rows = rows.iloc[:1].copy()
    rows["part"], rows["block"], rows["sums"] = key[1], key[0], [total.astype("<i8").tobytes()]
    return rows


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM): context vectors over all of `docs`, centred, of length 1 at most, plus half the index vector."""
    texts = docs.select("text")
    parts = max(texts.rdd.getNumPartitions(), 1)
    sums = texts.mapInArrow(_sums, "part int, block int, sums binary")
    while parts > 1:
        up = F.expr(f"part div {FAN_IN}").cast("int").alias("up")
        sums = sums.groupBy("block", up).applyInPandas(_added, "part int, block int, sums binary")
        parts = -(-parts // FAN_IN)
    total = np.zeros((BLOCKS, BUCKETS * DIM // BLOCKS))
    for r in sums.collect():  # BLOCKS rows, of 4 MB in all
        total[r.block] += np.frombuffer(r.sums, "<i8")
    context = total.reshape(BUCKETS, DIM)
    mean = context.sum(0) / max(np.abs(context).sum(), 1)
    context = context - np.abs(context).sum(1, keepdims=True) * mean
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1
    return (context + 0.5 * INDEX).astype(np.float32)


def pooled(b: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features of one document from its buckets; summed in chunks, so that a long text takes no more room."""
    n = len(b)
    out = np.zeros(3 * DIM + 3)
    if n:
        one, two, pair = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
        for at in range(0, n, CHUNK):
            v = vectors[b[at : at + CHUNK + 1]]
            own = v[:CHUNK]
            one += own.sum(0, dtype=np.float64)
            two += (own * own).sum(0, dtype=np.float64)
            pair += (v[:-1] * v[1:]).sum(0, dtype=np.float64)
        mean = one / n
        out[:DIM], out[DIM : 2 * DIM] = mean, np.sqrt(np.maximum(two / n - mean**2, 0))
        out[2 * DIM : 3 * DIM] = pair / max(n - 1, 1)
        out[-2], out[-1] = len(np.unique(b)) / n, 1
    out[-3] = np.log1p(n)
    return out


class Network:
    """Standardised features, tanh layer, softmax over temperature."""

    def __init__(self, layers: list[np.ndarray], centre: np.ndarray, scale: np.ndarray, temperature: float, constant: float | None = None):
        self.layers, self.centre, self.scale, self.temperature, self.constant = layers, centre, scale, temperature, constant

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.centre) / self.scale @ w + b) @ v + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self.logits(x) / self.temperature
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3) -> Network:
    if len(y) == 0 or len(np.unique(y)) == 1:
        return Network([], np.zeros(0), np.ones(0), 1, float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 4], order[len(y) // 4 :]
    centre, scale = x[used].mean(0), x[used].std(0) + 1e-3
    u, target = (x[used] - centre) / scale, np.eye(2)[y[used]]
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, 2)), np.zeros(2)]
    first, second, step = [np.zeros_like(a) for a in layers], [np.zeros_like(a) for a in layers], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(u)), max(1, len(u) // 64)):
            w, b, v, c = layers
            h = np.tanh(u[rows] @ w + b)
            z = h @ v + c
            p = np.exp(z - z.max(1, keepdims=True))
            g = (p / p.sum(1, keepdims=True) - target[rows]) / len(rows)
            back = g @ v.T * (1 - h * h)
            grads = [u[rows].T @ back + decay * w, back.sum(0), h.T @ g + decay * v, g.sum(0)]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad**2
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(layers, centre, scale, 1.0)
    z, sign = net.logits(x[held]), np.where(y[held] == 1, 1, -1)
    gap = (z[:, 1] - z[:, 0]) * sign if len(held) else np.zeros(1)
    net.temperature = min(np.geomspace(0.25, 16, 97), key=lambda t: np.logaddexp(0, -gap / t).mean())
    return net


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, target: str = "quality") -> tuple[np.ndarray, Network]:
    """Word vectors from all of `docs`, and the network from a bounded sample of labelled rows that are not held out."""
    vectors = word_vectors(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    sample = drawn(known, MAX_ROWS, "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Buckets()
        for batch in slices(batches):
            x = [pooled(words.of(t), vectors) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([r.tolist() for r in x], pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = texts.mapInArrow(run, "doc_id long, label int, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x"), F.max("label").alias("label")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows]) if rows else np.zeros((0, 3 * DIM + 3))
    return vectors, fit(x, np.array([r.label for r in rows], int))


def scored(docs: DataFrame, vectors: np.ndarray, network: Network, name: str = "quality") -> DataFrame:
    """`docs` with every column and `name`, the score in 0 to 1; a column that has that name already is replaced."""
    kept = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Buckets()
        for batch in slices(batches):
            if batch.num_rows:
                x = np.stack([pooled(words.of(t), vectors) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(x))], [*batch.schema.names, name])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))

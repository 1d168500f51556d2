"""Hard negatives from rotated one-bit codes.

Vectors become integers (floor(256 x)) and are turned by one random rotation, the same everywhere.  A vector's code is the sign
of each turned component; stored with it is the alignment, the length of the vector along its code vector.  What the code
vector leaves over is coded in the same way, CODES times in all: a vector x is a1 c1 + a2 c2 + ... + r, with the length of r stored.

An anchor q is turned likewise and its components are rounded to 8 bits, so <q, c> is a weighted sum of popcounts over its bit
planes, but for an error of the length of what rounding took.  A score is then known up to an interval that is certain, by the
inequality of Cauchy and Schwarz: r is at right angles to the last code vector, so |<q, r>| is at most |r| times the length of
q less its part along that code vector.  Candidates whose interval cannot matter drop out, code by code; the others are scored
in integers.  What matters is decided by intervals too: `count` candidates with lower bounds above an upper bound exclude it.

Anchors meet all rows in a grid of cells, a bounded block of anchors by a bounded block of rows, dealt out by row numbers and
not by labels, so no label, however frequent, makes a cell larger.  Every cell gives at most `count` rows for what it is asked,
and these are ranked by anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from soundfield.llm.shared import slices, stored

POSITIVES, NEGATIVES = 5, 10
#: A negative scores from 30 to 90 per cent of the positive.
LEAST, MOST = 30, 90
CODES, PLANES = 5, 8
#: Anchors and rows of a cell at most; pairs that are looked at together.
ANCHORS, ROWS, PAIRS = 1 << 14, 1 << 15, 1 << 18
#: Intervals are widened by this share of the product of lengths, far above what floating point takes.
SLACK = 1e-9


def rotation(dim: int, seed: int = 12) -> np.ndarray:
    """A random rotation (or reflection) of `dim` dimensions, a function of the seed."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0] if dim else np.zeros((0, 0))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of turned vectors: codes (rows, CODES, words) as 64-bit words, alignments (rows, CODES), lengths of what each code leaves."""
    n, dim = x.shape
    root, words, left = np.sqrt(max(dim, 1)), -(-dim // 64), x.copy()
    bits, along, rest = np.zeros((n, CODES, words * 64), np.uint8), np.zeros((n, CODES)), np.zeros((n, CODES))
    for k in range(CODES):
        ones = left > 0
        bits[:, k, :dim] = ones
        along[:, k] = np.abs(left).sum(1) / root
        left = left - np.where(ones, 1.0, -1.0) * along[:, k, None] / root
        rest[:, k] = np.sqrt((left * left).sum(1))
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), along, rest


def planes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of turned anchors: bit planes (rows, PLANES, words), least component, step, sum of the rounded components, length of what rounding took."""
    n, dim = q.shape
    words, low = -(-dim // 64), q.min(1, initial=0)
    step = np.maximum(q.max(1, initial=0) - low, 1e-300) / (2**PLANES - 1)
    whole = np.rint((q - low[:, None]) / step[:, None]).astype(np.int64)
    rounded = low[:, None] + step[:, None] * whole
    bits = np.zeros((n, PLANES, words * 64), np.uint8)
    for j in range(PLANES):
        bits[:, j, :dim] = whole >> j & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), low, step, rounded.sum(1), np.sqrt(((q - rounded) ** 2).sum(1))


class Cell:
    """A block of anchors and a block of rows, with what intervals need."""

    def __init__(self, anchors: pa.Table, rows: pa.Table, dim: int):
        turn, vector = rotation(dim), lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), "<i4").reshape(t.num_rows, dim)
        self.q, self.x, self.dim = vector(anchors), vector(rows), dim
        turned = self.q.astype(np.float64) @ turn
        self.planes, self.low, self.step, self.total, self.error = planes(turned)
        self.length = np.sqrt((turned * turned).sum(1))
        numbers = lambda name, kind, wide: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(rows.num_rows, CODES, *wide)
        self.codes, self.along, self.rest = numbers("codes", "<u8", (-(-dim // 64),)), numbers("along", "<f8", ()), numbers("rest", "<f8", ())
        self.norm = np.sqrt(self.along[:, 0] ** 2 + self.rest[:, 0] ** 2)
        self.ids, self.labels, self.numbers = (rows.column(c).to_numpy() for c in ("vec_id", "label", "row_no"))
        self.anchor_labels, self.anchor_numbers = (anchors.column(c).to_numpy() for c in ("label", "row_no"))

    def along_code(self, a: np.ndarray, r: np.ndarray, k: int) -> np.ndarray:
        """<q, c> of the k-th code vector, from popcounts."""
        ones, weighted = np.zeros(len(a), np.int32), np.zeros(len(a), np.int32)
        for w in range(self.codes.shape[2]):
            code = self.codes[:, k, w][r]
            ones += np.bitwise_count(code)
            for j in range(PLANES):
                weighted += np.bitwise_count(code & self.planes[:, j, w][a]) * np.int32(1 << j)
        held = self.low[a] * ones + self.step[a] * weighted
        return (2 * held - self.total[a]) / np.sqrt(max(self.dim, 1))

    def narrowed(self, a: np.ndarray, r: np.ndarray, matters) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (a, r) that `matters(a, lo, hi)` keeps, asked anew after every code."""
        middle, doubt = np.zeros(len(a)), np.zeros(len(a))
        for k in range(CODES):
            t = self.along_code(a, r, k)
            middle = middle + self.along[r, k] * t
            doubt = doubt + self.along[r, k] * self.error[a]
            part = np.maximum(np.abs(t) - self.error[a], 0)
            wide = doubt + self.rest[r, k] * np.sqrt(np.maximum(self.length[a] ** 2 - part * part, 0)) + SLACK * self.length[a] * self.norm[r] + SLACK
            kept = matters(a, middle - wide, middle + wide)
            a, r, middle, doubt = a[kept], r[kept], middle[kept], doubt[kept]
        return a, r

    def scores(self, a: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for start in range(0, len(a), 1 << 16):
            own = slice(start, start + (1 << 16))
            out[own] = np.einsum("ij,ij->i", self.q[a[own]].astype(np.int64), self.x[r[own]].astype(np.int64))
        return out

    def blocks(self, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of an anchor and another row, of its label or of another one, some anchors at a time."""
        each = max(1, PAIRS // max(1, len(self.ids)))
        for start in range(0, len(self.q), each):
            own = slice(start, start + each)
            pairs = (self.anchor_labels[own, None] == self.labels[None]) == same
            if same:
                pairs &= self.anchor_numbers[own, None] != self.numbers[None]
            a, r = np.nonzero(pairs)
            yield a + start, r


def floors(a: np.ndarray, lo: np.ndarray, count: int, n: int) -> np.ndarray:
    """For each number below n the `count`-th greatest of `lo` where `a` is that number; -inf if there are fewer."""
    out = np.full(n, -np.inf)
    if not len(a):
        return out
    order = np.lexsort((-lo, a))
    numbers, first, sizes = np.unique(a[order], return_index=True, return_counts=True)
    has = sizes >= count
    out[numbers[has]] = lo[order][first[has] + count - 1]
    return out


def leading(key: np.ndarray, score: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the first `count` of each key, higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, key))
    sorted_key = key[order]
    nth = np.arange(len(order)) - np.searchsorted(sorted_key, sorted_key)
    return order[nth < count]


def _prepared(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Rows that take part, with integers, codes and a number of their own; and the longest vector's length."""
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = given.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound)
    own = own.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    own = own.withColumn("x", F.transform("x", lambda c: F.floor(256 * c)))
    dim = own.agg(F.max(F.size("x"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, number = rotation(dim), TaskContext.get().partitionId() << 33
        for batch in slices(batches, 4096):
            column = batch.column("x")
            sizes = np.diff(column.offsets.to_numpy())
            x = np.zeros((batch.num_rows, dim), np.int64)
            x[np.arange(dim)[None] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            if len(x) and (np.abs(x.astype(np.float64)) ** 2).sum(1).max(initial=0) >= 2.0**62:
                raise ValueError("a vector is too long for inner products of 64 bits")
            code, along, rest = codes(x.astype(np.float64) @ turn)
            rows = np.arange(number, number + batch.num_rows)
            number += batch.num_rows
            blob = lambda values, kind: pa.array([v.astype(kind).tobytes() for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column("vec_id"), batch.column("label"), blob(x, "<i4"), blob(code, "<u8"), blob(along, "<f8"), blob(rest, "<f8")],
                ["row_no", "vec_id", "label", "vector", "codes", "along", "rest"],
            )

    schema = "row_no long, vec_id long, label long, vector binary, codes binary, along binary, rest binary"
    return stored(own.select("vec_id", "label", "x").mapInArrow(run, schema), "negatives-rows"), dim


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dim: int, most_rows: int, most_anchors: int):
    """`anchors` and `rows` grouped by cell; each anchor goes to every block of rows and each row to every block of anchors."""
    most_rows = max(256, min(most_rows, (1 << 23) // max(dim, 1)))
    across = max(-(-n_anchors // max(256, min(most_anchors, (1 << 22) // max(dim, 1)))), 1)
    down = max(-(-n_rows // most_rows), min(32, -(-n_rows // 1024)), 1)
    block = lambda n, salt: F.pmod(F.xxhash64("row_no", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("across", block(across, 1)).select("*", every(down).alias("down"))
    right = rows.withColumn("down", block(down, 2)).select("*", every(across).alias("across"))
    return left.groupBy("across", "down").cogroup(right.groupBy("across", "down"))


def _positives(left: pa.Table, right: pa.Table, dim: int) -> pa.Table:
    """Of one cell, the first POSITIVES other rows of each anchor's label."""
    cell, found = Cell(left, right, dim), []
    for a, r in cell.blocks(same=True):
        first, n = (int(a[0]), int(a[-1] - a[0]) + 1) if len(a) else (0, 1)  # pairs come in the order of their anchors
        a, r = cell.narrowed(a, r, lambda a, lo, hi: hi >= floors(a - first, lo, POSITIVES, n)[a - first])  # noqa: B023
        score = cell.scores(a, r)
        kept = leading(a, score, cell.ids[r], POSITIVES)
        found.append((cell.anchor_numbers[a[kept]], cell.ids[r[kept]], score[kept]))
    return _table(found, ["row_no", "positive_id", "positive_score"])


def _negatives(left: pa.Table, right: pa.Table, dim: int) -> pa.Table:
    """Of one cell, the first NEGATIVES rows of other labels in the band of each of an anchor's positives."""
    cell, found = Cell(left, right, dim), []
    asked = np.zeros((left.num_rows, POSITIVES, 4), np.int64)  # id and score of the positive, least and greatest score of a negative
    asked[:, :, 2] = 1  # an empty band where there is no positive
    for i, own in enumerate(left.column("positives").to_pylist()):
        for p in own:
            score = p["positive_score"]
            asked[i, p["nth"] - 1] = p["positive_id"], score, -(-LEAST * score // 100), MOST * score // 100

    def matters(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        kept, first = np.zeros(len(a), bool), int(a[0]) if len(a) else 0
        for k in range(POSITIVES):
            least, most = asked[a, k, 2], asked[a, k, 3]
            open_ = (least <= most) & (hi >= least) & (lo <= most)
            sure = open_ & (lo >= least) & (hi <= most)
            least_sure = floors(a[sure] - first, lo[sure], NEGATIVES, int(a[-1]) - first + 1) if sure.any() else None
            kept |= open_ & (hi >= least_sure[a - first]) if least_sure is not None else open_
        return kept

    for a, r in cell.blocks(same=False):
        a, r = cell.narrowed(a, r, matters)
        score = cell.scores(a, r)
        for k in range(POSITIVES):
            inside = np.flatnonzero((score >= asked[a, k, 2]) & (score <= asked[a, k, 3]))
            kept = inside[leading(a[inside], score[inside], cell.ids[r[inside]], NEGATIVES)]
            own = a[kept]
            found.append((cell.anchor_numbers[own], np.full(len(own), k + 1), asked[own, k, 0], asked[own, k, 1], cell.ids[r[kept]], score[kept]))
    return _table(found, ["row_no", "nth", "positive_id", "positive_score", "negative_id", "negative_score"])


def _table(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * len(names)
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names)


def hard_negatives(embeddings: DataFrame, most_rows: int = ROWS, most_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows (vec_id, embedding, label).

    Anchors are the rows with a vec_id divisible by 100.  A row is one of its own also where vec_id or vector repeat, so a copy of
    an anchor under the same vec_id is another row and has results of its own.  Rows without a vec_id or label, and rows whose
    vector is null or has a null or non-finite component, take no part; a shorter vector goes on in zeros.  Ties go by vec_id.
    Inner products that may pass 64 bits are an error.  Anchors without a positive or a negative have no rows, and neither has an
    empty table.  Other columns are ignored.
    """
    rows, dim = _prepared(embeddings)
    anchors = rows.where("vec_id % 100 = 0").select("row_no", F.col("vec_id").alias("anchor_id"), "label", "vector")
    size = (anchors.count(), rows.count(), dim, most_rows, most_anchors)

    near = _grid(anchors, rows, *size).applyInArrow(lambda a, r: _positives(a, r, dim), "row_no long, positive_id long, positive_score long")
    nth = F.row_number().over(Window.partitionBy("row_no").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("nth", nth).where(F.col("nth") <= POSITIVES)
    asked = near.groupBy("row_no").agg(F.collect_list(F.struct("nth", "positive_id", "positive_score")).alias("positives"))  # POSITIVES at most
    asking = stored(anchors.join(asked, "row_no"), "negatives-positives")

    schema = "row_no long, nth long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _grid(asking, rows, *size).applyInArrow(lambda a, r: _negatives(a, r, dim), schema)
    rank = F.row_number().over(Window.partitionBy("row_no", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    far = far.withColumn("rank", rank).where(F.col("rank") <= NEGATIVES).join(asking.select("row_no", "anchor_id"), "row_no")
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

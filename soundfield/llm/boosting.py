"""Gradient-boosted trees for a logistic loss with few features: on arrays, or on a table that Spark sums up level by level.

A row counts only by the bins its features fall into, so equal rows may come as one with their weights summed.  Gradients are
summed as whole numbers of 2 ** -20; so the trees do not depend on the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES, DEPTH, RATE, PENALTY, BINS, UNIT = 40, 3, 0.2, 1.0, 32, 2.0**20
Sums = Callable[["Boosted", np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


class Boosted:
    """Trees of fixed depth as arrays: feature and cut of each inner node, value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - inner]
        return out


def code(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Code k: at most cut k."""
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def histograms(coded: np.ndarray, y: np.ndarray, weight: np.ndarray, so_far: Boosted, feature: np.ndarray, cut: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives by node of `level`, feature and code, in units of 1 / UNIT."""
    p = 1 / (1 + np.exp(-so_far.margins(coded)))
    g, h = np.rint(weight * (p - y) * UNIT), np.rint(weight * p * (1 - p) * UNIT)
    node = np.zeros(len(coded), np.int64)
    for _ in range(level):
        node = 2 * node + 1 + (coded[np.arange(len(coded)), feature[node]] > cut[node])
    spot, size = (node - (2**level - 1)) * BINS, 2**level * BINS
    both = [[np.bincount(spot + coded[:, j], v, size).reshape(-1, BINS) for j in range(coded.shape[1])] for v in (g, h)]
    return tuple(np.stack(b, 1).astype(np.int64) for b in both)


def grow(share: float, cuts: list[np.ndarray], sums: Sums, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, penalty: float = PENALTY) -> Boosted:
    """Second-order boosting from the histograms that `sums` gives.  The trees' cuts are codes."""
    share = min(max(share, 1e-3), 1 - 1e-3)
    inner = 2**depth - 1
    out = Boosted(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    for _ in range(trees):
        feature, cut, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        for level in range(depth):
            for k, (g, h) in enumerate(zip(*(v / UNIT for v in sums(out, feature, cut, level)), strict=True)):
                at, best, gs, hs = 2**level - 1 + k, 1e-6, g[0].sum(), h[0].sum()
                left = gs, hs
                for j, own in enumerate(cuts):
                    gl, hl = np.cumsum(g[j])[: len(own)], np.cumsum(h[j])[: len(own)]
                    gain = gl**2 / (hl + penalty) + (gs - gl) ** 2 / (hs - hl + penalty) - gs**2 / (hs + penalty)
                    if len(gain) and gain.max() > best:
                        i = int(gain.argmax())
                        best, feature[at], cut[at], left = gain[i], j, i, (gl[i], hl[i])
                if level == depth - 1:
                    right = gs - left[0], hs - left[1]
                    leaf[2 * k], leaf[2 * k + 1] = -rate * left[0] / (left[1] + penalty), -rate * right[0] / (right[1] + penalty)
        out = Boosted(out.base, np.vstack([out.feature, feature]), np.vstack([out.cut, cut]), np.vstack([out.leaf, leaf]))
    return out


def decoded(model: Boosted, cuts: list[np.ndarray]) -> Boosted:
    """The same trees with cuts between values."""
    value = [[cuts[j][int(c)] if np.isfinite(c) else np.inf for j, c in zip(f, k, strict=True)] for f, k in zip(model.feature, model.cut, strict=True)]
    return Boosted(model.base, model.feature, np.array(value, float).reshape(model.cut.shape), model.leaf)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, **more: float) -> Boosted:
    """Trees on arrays; cuts are tried between quantiles of each feature."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    coded = code(x, cuts)
    return decoded(grow((weight * y).sum() / max(weight.sum(), 1e-9), cuts, lambda *at: histograms(coded, y, weight, *at), **more), cuts)


def quantiles(rows: DataFrame, column: str, features: int) -> list[np.ndarray]:
    """Of each place of the arrays in `column` the values, other than the last, at which the count of rows passes a BINS-th."""
    values = rows.select(F.posexplode(column).alias("j", "v")).groupBy("j", "v").count()
    own = Window.partitionBy("j")
    ranked = values.select("j", "v", "count", F.sum("count").over(own.orderBy("v")).alias("upto"), F.sum("count").over(own).alias("total"))
    passed = ranked.where(F.expr(f"upto < total and floor(upto * {BINS} / total) > floor((upto - count) * {BINS} / total)")).select("j", "v").collect()
    return [np.array(sorted(r.v for r in passed if r.j == j), float) for j in range(features)]


def matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, features)


def fit_table(rows: DataFrame, cuts: list[np.ndarray], **more: float) -> Boosted:
    """Trees on all `rows` (code binary, y, weight); their cuts are codes.  The driver gets sums by node, feature and code only."""
    n = len(cuts)
    total = rows.agg(F.sum(F.col("weight") * F.col("y")).alias("y"), F.sum("weight").alias("all")).first()

    def sums(so_far: Boosted, feature: np.ndarray, cut: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h = np.zeros((2, 2**level * n * BINS), np.int64)
            for batch in batches:
                y, weight = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("y", "weight"))
                own = histograms(matrix(batch, n), y, weight, so_far, feature, cut, level)
                g += own[0].ravel()
                h += own[1].ravel()
            cell = np.flatnonzero(g | h)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(g[cell]), pa.array(h[cell])], ["cell", "g", "h"])

        out = np.zeros((2, 2**level * n * BINS), np.int64)
        for r in rows.mapInArrow(run, "cell long, g long, h long").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out[:, r.cell] = r.g, r.h
        return tuple(v.reshape(2**level, n, BINS) for v in out)

    return grow((total.y or 0) / max(total.all or 0, 1e-9), cuts, sums, **more)

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from soundfield.llm import negatives
from soundfield.llm.queries import ORACLES, QUERIES
from oracle_check import compare, oracle_connection


def brute(rows):
    """The result of (vec_id, label, vector) rows, as sorted tuples."""
    sound = [
        (i, v, (lab + 1) % 10 if v % 7 == 0 else lab, [math.floor(256 * float(np.float32(c))) for c in x])
        for i, (v, lab, x) in enumerate(rows)
        if v is not None and lab is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)
    ]
    out = []
    for i, v, lab, x in sound:
        if v % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=False)), w, other == lab) for j, w, other, y in sound if i != j]
        for p, w, _ in sorted(s for s in scored if s[2])[:5]:
            fit = sorted((n, u) for n, u, same in scored if not same and 30 * -p <= 100 * -n <= 90 * -p)
            out += [(v, w, rank, u, -p, -n) for rank, (n, u) in enumerate(fit[:10], 1)]
    return sorted(out)


def found(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return sorted(map(tuple, negatives.hard_negatives(df, **sizes).collect()))


def clustered(rng, n, dim, labels=4):
    centres = rng.standard_normal((labels * 2, dim))
    which = rng.integers(0, len(centres), n)
    x = centres[which] * rng.choice([0, 1, 1], (n, 1)) + rng.standard_normal((n, dim)) * rng.choice([0.01, 0.5, 2], (n, 1))
    x = (x / np.sqrt(dim)).astype(np.float32)
    return [(int(i * 4), int(w % labels), [float(c) for c in v]) for i, (w, v) in enumerate(zip(which, x, strict=True))]


@pytest.mark.parametrize("dim", [1, 7, 64, 100])
def test_equals_brute_force_in_one_cell_and_in_many(spark, dim, monkeypatch):
    rows = clustered(np.random.default_rng(dim), 700, dim)
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want
    if dim == 64:
        monkeypatch.setattr(negatives, "PAIRS", 300)
        assert found(spark, rows, most_rows=256, most_anchors=256) == want


def test_intervals_hold_every_score_and_leave_most_out():
    rng = np.random.default_rng(4)
    for dim in (3, 64, 130):
        x = np.floor(256 * np.concatenate([rng.standard_normal((300, dim)), np.zeros((1, dim)), rng.standard_normal((5, dim)) * 1e4]) / np.sqrt(dim)).astype(np.int64)
        code, along, rest = negatives.codes(x.astype(float) @ negatives.rotation(dim))
        blob = lambda a, kind: pa.array([v.astype(kind).tobytes() for v in a], pa.binary())
        rows = pa.table({
            "row_no": pa.array(range(len(x))), "vec_id": pa.array(range(len(x))), "label": pa.array([0] * len(x)), "vector": blob(x, "<i4"),
            "codes": blob(code, "<u8"), "along": blob(along, "<f8"), "rest": blob(rest, "<f8"),
        })
        cell, widths = negatives.Cell(rows.slice(0, 40), rows, dim), []
        a, r = (m.ravel() for m in np.meshgrid(np.arange(40), np.arange(len(x)), indexing="ij"))
        exact = (x[a] * x[r]).sum(1)

        def matters(a, lo, hi, exact=exact, widths=widths):
            assert ((lo <= exact) & (exact <= hi)).all()
            widths.append(np.median(hi - lo))
            return np.ones(len(a), bool)

        cell.narrowed(a, r, matters)
        assert widths == sorted(widths, reverse=True) and widths[-1] < widths[0] / 4
        if dim == 64:
            left, _ = cell.narrowed(a, r, lambda a, lo, hi: hi >= negatives.floors(a, lo, 5, 40)[a])
            assert len(left) < len(a) / 2


def test_ties_repeats_and_a_label_of_most_rows(spark):
    rng = random.Random(2)
    pool = [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(6)] for _ in range(12)]
    rows = [(rng.randrange(0, 400), rng.choice([1, 1, 1, 2, 3]), rng.choice(pool)) for _ in range(500)] + [(100, 1, pool[0])] * 3
    want = brute(rows)
    assert len(want) > 50 and found(spark, rows) == want


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.5, 0.5]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, 2, None), (6, 2, [None, 1.0]), (8, None, [0.5, 0.5]),
        (None, 2, [0.5, 0.5]), (9, 2, [0.5]), (10, 2, []), (14, 1, [0.4, 0.4]), (100, 7, [1.0, 1.0]), (200, 1, [-1.0, 0.1]), (-100, 1, [0.9, 0.1]), (-7, 9, [0.5, 0.4]),
    ]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) >= 4
    empty = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(empty.limit(0)).count() == 0
    assert negatives.hard_negatives(empty.where("embedding is null")).count() == 0
    assert found(spark, [(1, 1, []), (2, 1, []), (100, 1, []), (3, 2, [])]) == [(100, 1, 1, 3, 0, 0), (100, 2, 1, 3, 0, 0)]
    other = empty.selectExpr("vec_id", "label", "embedding", "'x' as row_no", "1 as anchor_id", "2 as vector")
    assert sorted(map(tuple, negatives.hard_negatives(other).collect())) == brute(rows)
    with pytest.raises(Exception, match="too long"):
        found(spark, [(0, 1, [1e30]), (1, 1, [1.0])])


def test_the_query_equals_its_sql(spark, small):
    assert "op12_negatives" in ORACLES
    out = QUERIES["op12_negatives"](spark, small)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    ok, message = compare(spark, oracle_connection(small), "op12_negatives", QUERIES["op12_negatives"], ORACLES["op12_negatives"], small)
    assert ok, message

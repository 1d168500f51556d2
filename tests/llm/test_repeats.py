import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from soundfield.llm import repeats, shared
from soundfield.llm.queries import QUERIES

N = repeats.MIN_LEN


def brute(rows):
    first = {}
    rows = [(repeats.LAST if d is None else d, (t or "").encode()) for d, t in rows]
    for d, t in rows:
        for i in range(len(t) - N + 1):
            w = t[i : i + N]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - N + 1):
            if first[t[i : i + N]] < d:
                gone[i : i + N] = [True] * N
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((None if d == repeats.LAST else d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1 << 20, 128])
def test_every_window_has_its_leftmost_least_anchor(monkeypatch, span):
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab", k=rng.randrange(0, 300))) for _ in range(40)] + [b"a" * 500, b"xyz" * 200]
    monkeypatch.setattr(repeats, "SPAN", span)
    want = set()
    for k, t in enumerate(texts):
        h = repeats.hashes(np.frombuffer(t, "u1")) if len(t) >= repeats.K else []
        for s in range(len(t) - N + 1):
            want.add((k, min(range(s, s + repeats.REACH + 1), key=lambda p: (int(h[p]) // span, p))))
    got, print_of = set(), {}
    for parts in repeats.text_anchors(texts):
        for w, p, _, start, end, g in zip(*(x.tolist() for x in parts), strict=True):
            got.add((w, p))
            assert (start, end) == (max(0, p - repeats.REACH), min(len(texts[w]), p + N))
            assert print_of.setdefault(texts[w][start:end], g) == g  # equal bytes have equal hashes, whatever buffer they lie in
    assert got == want and len(set(print_of.values())) == len(print_of)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 1), st.integers(0, 40), st.integers(1, 9)), min_size=1))
def test_merged_stretches_cover_the_same(rows):
    doc, key, start, size = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    got = list(zip(*(x.tolist() for x in repeats.merged(doc, key, start, start + size)), strict=True))
    assert sorted({(d, k, i) for d, k, s, n in rows for i in range(s, s + n)}) == [(d, k, i) for d, k, s, e in got for i in range(s, e)]
    assert all(x[:2] != y[:2] or y[2] > x[3] for x, y in zip(got, got[1:], strict=False))


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randrange(10, 40)) for _ in range(8)]
    rows = []
    for i in range(120):
        text = prose(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a, b = sorted(rng.sample(range(len(p)), 2))
            at = rng.randrange(len(text) + 1)
            text = text[:at] + p[a:b] + text[at:]
        rows.append((rng.randrange(150), text))
    rows += [(200 + i, rows[i][1]) for i in range(10)] + [(None, rows[0][1]), (300, "ab" * 400), (301, "b" + "ab" * 300), (302, "z" * 400), (303, "z" * 400)]
    return rows + [(304, None), (305, ""), (306, "short"), (306, "short"), (307, passages[0] * 3), (307, passages[0] * 3), (308, passages[0] + "\0" + passages[1])]


@pytest.mark.parametrize(("seed", "most"), [(1, repeats.MOST), (2, 0)])
def test_random_texts_against_brute_force(spark, seed, most):
    rows = made(seed)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, start int").repartition(6)
    got = sorted([tuple(r)[:5] for r in repeats.deduplicated(docs, most).collect()], key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("most", [repeats.MOST, 0])
def test_parts_of_the_hashes_give_the_same_and_leave_no_files(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(repeats, "PASS", 2000)
    monkeypatch.setattr(repeats, "PASSES", 3)
    rows = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted([tuple(r)[:5] for r in repeats.deduplicated(docs, most).collect()], key=str)
    assert got == brute(rows)
    assert [x.name[:14] for x in tmp_path.iterdir()] == ["repeats-spans-"]


def test_groups_are_maximal_and_complete(spark):
    rows = [(d, t) for d, t in made(4) if d is not None and t]
    by = {}
    for k, (d, t) in enumerate(rows):
        by.setdefault(k, t.encode())
    docs = spark.createDataFrame([(k, t.decode()) for k, t in by.items()], "doc_id long, text string")
    found = defaultdict(set)
    for g in repeats.repeat_groups(docs).collect():
        found[g.h, g.group, g.length].add((g.doc_id, g.start))
    covered = defaultdict(set)
    for (_, _, length), places in found.items():
        strings = {by[d][s : s + length] for d, s in places}
        assert len(strings) == 1 and length >= N and len(places) > 1
        for d, s in places:
            for i in range(s, s + length - N + 1):
                covered[by[d][i : i + N]].add((d, i))
    want = defaultdict(set)
    for d, t in by.items():
        for i in range(len(t) - N + 1):
            want[t[i : i + N]].add((d, i))
    shared = {w: p for w, p in want.items() if len({d for d, _ in p}) > 1}
    assert shared and {w: covered[w] for w in shared} == shared  # strings that only one document repeats may be listed too
    assert all(covered[w] <= want[w] for w in covered)


@pytest.mark.parametrize("seed", range(4))
def test_groups_of_an_anchor_are_the_maximal_ones(seed):
    rng = random.Random(seed)
    base = bytes(rng.choices(b"ab", k=N + repeats.REACH))
    near = set()
    for _ in range(12):
        t = bytearray(base[rng.randrange(3) : N + repeats.REACH - rng.randrange(3)])
        for _ in range(rng.randrange(3)):
            t[rng.choice([rng.randrange(8), rng.randrange(len(t) - 8, len(t))])] = rng.choice(b"abc")
        near.add(bytes(t))
    near = sorted(near)
    doc = list(range(len(near)))
    got = {(length, low, frozenset(places)) for length, low, places in repeats.groups(near, doc, doc)}
    at = defaultdict(set)
    for i, t in enumerate(near):
        for s in range(repeats.REACH + 1):
            for e in range(s + N, len(t) + 1):
                at[t[s:e]].add((i, s))
    want = set()
    for w, places in at.items():
        after = {near[i][s + len(w) : s + len(w) + 1] for i, s in places}
        before = {near[i][s - 1 : s] if s else None for i, s in places}
        if len(places) > 1 and (len(after) > 1 or after == {b""}) and (len(before) > 1 or None in before):
            want.add((len(w), min(i for i, _ in places), frozenset(places)))
    assert got == want and want


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in QUERIES["op4_repeats"](spark, small).collect()], key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert repeats.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0

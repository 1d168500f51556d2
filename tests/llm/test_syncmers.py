import hashlib
import re
import struct

import numpy as np
import xxhash

from soundfield.llm import syncmers
from soundfield.llm.queries import QUERIES


def xx(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def chain(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed & 0xFFFFFFFF


def brute(text):
    words, out = [w for w in re.split(r"[\x09-\x0D\x20]+", text) if w], set()
    if len(words) >= 24:
        h = [xx(w) for w in words]
        for i in range(len(h) - 2):
            if h[i + 1] >= min(h[i], h[i + 2]):
                out.add(chain(h[i : i + 3]))
    if len(words) < 40:
        mers = [text] if 0 < len(text) < 4 else []
        for i in range(len(text) - 3):
            m = text[i : i + 4]
            if xx(m[1:3]) >= min(xx(m[:2]), xx(m[2:])):
                mers.append(m)
        out |= {xx(m) & 0xFFFFFFFF for m in mers}
    return sorted(out)[:48]


def near(a, b):
    both = sorted(set(a) | set(b))[:48]
    return len([x for x in both if x in a and x in b]) / len(both) if both else 1.0


def hexed(a):
    return "".join(f"{x:08x}" for x in a)


def expect(rows):
    rows = sorted(rows)
    out = {}
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        n = len(text)
        edited = text[: n - n // 4] + after[: n // 4]
        a, e, b = brute(text), brute(edited), brute(after)
        out[doc] = (n, hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(e), near(a, e), near(a, b))
    return out


def test_documents_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = QUERIES["op9_syncmers"](spark, small).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expect(rows)
    assert np.mean([r.near_edited > r.near_next or r.near_next == 1 for r in got]) > 0.97


def test_edge_cases(spark):
    rows = [(1, "", 0), (2, None, 0), (3, "ab", 1), (4, "é😀é😀 x" * 3, 2), (5, "q" * 90_000, 3), (9, "a b c d e f " * 900, 4), (9, "a b c d e f " * 900, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = syncmers.with_edited(docs).collect()
    assert len(got) == 7
    want = expect({(d, t or "") for d, t, _ in rows})
    assert {r.doc_id: (r.n_chars, hexed(r.hashes), hexed(r.edited_hashes)) for r in got} == {d: (w[0], w[2], w[3]) for d, w in want.items()}
    alone = syncmers.with_edited(docs.where("doc_id = 9").limit(1)).collect()
    assert len(alone) == 1 and alone[0].hashes == alone[0].next_hashes
    assert syncmers.with_edited(docs.limit(0)).count() == 0
    assert syncmers.with_edited(spark.createDataFrame([(None, "x y"), (1, "x y")], "doc_id long, text string")).count() == 2

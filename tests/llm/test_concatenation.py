import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from soundfield.llm import concatenation
from soundfield.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    whole, own, rng = Tokenizer.from_file(PATH), concatenation.ChunkIds(PATH, most=300), random.Random(5)
    bits = ["the", "The", " ", "  ", "\n", "\t ", "I'LL", "'s", "don't", "12", "3½", "É", "ñu", "!!", "...", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<|STARTOFTEXT|>",
            "İ", "Σ", "é", "́", "Å", "ﬁ", "–", "日本", "_", "'", "''S", " ", "😀", "ǅ"]
    texts = ["", " ", "a  ", "\n\n x"] + ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(2000)]
    texts += ["".join(map(chr, rng.choices(range(0x250), k=30))) for _ in range(500)]
    texts += ["".join(map(chr, rng.choices([*range(0x300, 0xD7FF)], k=10))) for _ in range(500)]
    for t in texts:
        assert own.of(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_windows_cover_the_concatenation():
    rng = random.Random(1)
    for capacity in (8, 2048):
        for _ in range(50):
            sizes = [rng.randrange(1, 3 * capacity) for _ in range(rng.randrange(1, 30))]
            bounds, at, held = concatenation.tail_bounds(sum(sizes), capacity), 0, defaultdict(list)
            for n in sizes:
                records = concatenation.cut(at, n, bounds, capacity)
                assert [r[0] for r in records] == [sum(r[1] for r in records[:i]) for i in range(len(records))]
                assert sum(r[1] for r in records) == n
                for _, length, sequence, offset in records:
                    held[sequence].append((offset, length))
                at += n
            lengths = check_gapless(held)
            assert all(n & n - 1 == 0 for n in lengths) and sorted(lengths, reverse=True)[: sum(sizes) // capacity] == [capacity] * (sum(sizes) // capacity)
    assert concatenation.tail_bounds(0) == [0] and concatenation.tail_bounds(2048) == [2048]


def check_gapless(held):
    lengths = []
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        lengths.append(at)
    return lengths


def check(rows, texts, capacity=2048):
    """Ids, pieces and places of `rows` against whole encodings of `texts`, a list of (doc_id, text) without repeated ids."""
    whole, held, own = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
    lengths = check_gapless(held)
    assert all(n == capacity or n < capacity and n & n - 1 == 0 for n in lengths)
    assert own.keys() == dict(texts).keys()
    for doc, text in texts:
        ids, at = np.array(whole.encode(text or "", add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(own[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    return lengths


def test_the_query_holds_every_id_once(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = QUERIES["op13_concatenation"](spark, small)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    lengths = check(out.collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(n < 2048 for n in lengths) <= 11


def test_many_tasks_and_blocks(spark, small, monkeypatch):
    monkeypatch.setattr(concatenation, "BLOCK", 4)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    check(concatenation.concatenated(docs.repartition(23), PATH, capacity=64).collect(), [tuple(r) for r in docs.collect()], 64)


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b " * 50000, 1), (None, "x", 2), (4, "x", 3), (5, " \n ", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check(concatenation.concatenated(docs, PATH).collect(), [r[:2] for r in rows])
    twice = concatenation.concatenated(docs.union(docs), PATH, keep_ids=True).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in concatenation.concatenated(docs, PATH).collect())
    assert all(len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in twice)
    assert concatenation.concatenated(docs.limit(0), PATH).count() == 0

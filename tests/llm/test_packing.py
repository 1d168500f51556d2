import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from soundfield.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers():
    whole, own, rng = Tokenizer.from_file(PATH), packing.Ids(PATH, most_words=500), random.Random(5)
    bits = ["the", " ", "  ", "\n", "\t ", "I'll", "'s", "don't", "12", "3½", "é", "ñu", "!!", "...", " ", "\x85", "\x1c", "<|endoftext|>", "ſ", "–", "日本", "_", "'", "''s", " ", "😀"]
    texts = ["", " ", "a  ", "\n\n x"] + ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(1500)]
    texts += ["".join(map(chr, rng.choices(range(0x250), k=30))) for _ in range(500)]
    for t in texts:
        assert own.of(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_layout_fills_bins_without_overlap_or_gap():
    rng = random.Random(1)
    for capacity in (12, 100, 1024):
        for _ in range(20):
            counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 800)))
            bins = defaultdict(list)
            ranks = defaultdict(set)
            for length, lo, hi, first, offset in packing.layout(counts, capacity):
                for rank in range(lo, hi):
                    ranks[length].add(rank)
                    bins[first + rank - lo].append((offset, length))
            assert {k: len(v) for k, v in ranks.items()} == dict(counts) and all(v == set(range(len(v))) for v in ranks.values())
            for held in bins.values():
                at = 0
                for offset, length in sorted(held):
                    assert offset == at
                    at += length
                assert at <= capacity and sum(n > capacity // 3 for _, n in held) <= 2
            total = sum(k * v for k, v in counts.items())
            large = sum(v for k, v in counts.items() if 2 * k > capacity)
            assert len(bins) <= max(-(-total // capacity), large) * 1.25 + 2


def check(rows, texts, capacity=1024):
    whole, by_seq, by_doc = Tokenizer.from_file(PATH), defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for held in by_seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        own = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = packing.packed(docs.repartition(5), PATH).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= -(-total // 1024) + 3


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b " * 5000, 1), (None, "x", 2), (4, "x", 3)], "doc_id long, text string, length int")
    check(packing.packed(docs, PATH).collect(), {1: None, 2: "", 3: "a b " * 5000, None: "x", 4: "x"})
    twice = packing.packed(docs.union(docs), PATH, keep_ids=True).collect()
    assert len(twice) == 2 * packing.packed(docs, PATH).count() and all(len(r.ids) == r.length for r in twice)
    assert packing.packed(docs.limit(0), PATH).count() == 0

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer, decoders

from soundfield.llm import alignment
from soundfield.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def encodings(text, a, b):
    """Tokens (id, start, end) of both in bytes, from whole encodings; None without tokens."""
    if not text:
        return None
    letter = {v: k for k, v in alignment._bytes_of_letters().items()}
    as_bytes = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts = [[bytes(letter[c] for c in a.id_to_token(i)) for i in ids_a], [as_bytes(b.id_to_piece(i)) for i in ids_b]]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    out = []
    for ids, own in zip((ids_a, ids_b), parts, strict=True):
        at, tokens = 0, []
        for i, x in zip(ids, own, strict=True):
            tokens.append((i, at, at + len(x)))
            at += len(x)
        out.append(tokens)
    return out


def groups_sha(x, y):
    ends = sorted({e for *_, e in x} & {e for *_, e in y})
    of = lambda tokens, lo, hi: ",".join(str(i) for i, s, e in tokens if lo <= s and e <= hi)
    return hashlib.sha256(";".join(of(x, lo, hi) + "|" + of(y, lo, hi) for lo, hi in zip([0, *ends], ends, strict=False)).encode()).hexdigest()


def brute(rows):
    """The result of (doc_id, text) rows by comparing all tokens of A with all of B."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    done, held = [], Counter()
    for doc, text in rows:
        found = encodings(text, a, b)
        if not found:
            done.append((doc, 0, 0, 0, [], ""))
            continue
        x, y = found
        links = [(i, j) for i, s, e in x for j, s2, e2 in y if s < e2 and s2 < e]
        done.append((doc, len(x), len(y), len({e for *_, e in x} & {e for *_, e in y}), links, groups_sha(x, y)))
        held.update(set(links))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    return [(doc, n_a, n_b, n_g, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for doc, n_a, n_b, n_g, links, sha in done]


def result(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_segments_give_whole_encodings(monkeypatch):
    both, rng = alignment.Aligner(A, B), random.Random(3)
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    assert not both.whole
    bits = ["the", " ", "  ", "\n", "\t ", " \n", "I'll", "12", "3½", "é", "ñu", "!!", "...", "\xa0", "\x85", "\x1c", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>",
            "–", "日本", "日 本", "_", "'", "　", "😀", "́", "a", "B", " ", "▁", "​", "ﬁ", "﻿"]
    texts = ["", " ", "a  ", "\n\n x", " x ", "x\n"] + ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(3000)]
    want, empty = [encodings(t, a, b) for t in texts], ""
    for size, together in ((alignment.SEGMENT, alignment.TOGETHER), (5, 60), (0, 1)):
        monkeypatch.setattr(alignment, "SEGMENT", size)
        monkeypatch.setattr(alignment, "TOGETHER", together)
        got = list(both.texts(texts))
        assert len(got) == len(texts)
        for t, (n_a, n_b, n_groups, n_links, sha, pairs, times), known in zip(texts, got, want, strict=True):
            if known is None:
                assert (n_a, n_b, n_groups, n_links, sha, len(pairs)) == (0, 0, 0, 0, empty, 0), repr(t)
                continue
            x, y = known
            links = Counter(i << 32 | j for i, s, e in x for j, s2, e2 in y if s < e2 and s2 < e)
            assert dict(zip(pairs.tolist(), times.tolist(), strict=True)) == links and n_links == links.total(), repr(t)
            assert (n_a, n_b, n_groups) == (len(x), len(y), len({e for *_, e in x} & {e for *_, e in y}))
            assert sha == groups_sha(x, y)
    assert sum(w is None for w in want) < len(texts) / 2


def test_letters_are_the_decoders():
    for byte, letter in alignment._bytes_of_letters().items():
        if byte < 128:
            assert decoders.ByteLevel().decode([letter]) == chr(byte)


def test_the_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    short = [(k, t) for k, t in rows if t is None or len(t) < 3000]
    assert len(short) > 100
    docs = spark.createDataFrame(short, "doc_id long, text string")
    want = sorted(brute(short), key=str)
    assert result(alignment.aligned(docs, A, B)) == want
    assert result(alignment.aligned(docs.repartition(5), A, B, heavy=40)) == want
    assert result(alignment.aligned(docs, A, B, heavy=0)) == want
    out = QUERIES["op11_alignment"](spark, small)
    assert out.count() == len(rows) and out.dtypes == [(c, "bigint") for c in COLUMNS[:-1]] + [("groups_sha256", "string")]
    own = {r[0]: r for r in want}
    for r in out.collect():
        if r.doc_id in own:
            assert tuple(r)[1:5] == own[r.doc_id][1:5] and r.groups_sha256 == own[r.doc_id][-1] and r.n_links <= r.count_sum


def test_counts_are_handed_on_in_parts(spark):
    docs = spark.createDataFrame([(f"w{i} x{i % 7} the", i % 3 + 1) for i in range(600)], "text string, copies long")
    rows = alignment.measured(docs.coalesce(2), A, B).cache()
    every = sorted(map(tuple, alignment.pair_counts(rows).collect()))
    assert sorted(map(tuple, alignment.pair_counts(rows, counted=5).collect())) == every and len(every) > 100
    rows.unpersist()


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b " * 3000, 1), (None, "x", 2), (4, "x", 3), (4, "x", 4), (5, " \n ", 4), (6, "a▁b", 1), (7, "日本語" * 400, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copies int")
    short = [r for r in rows if r[0] != 3]
    assert result(alignment.aligned(docs.where("doc_id is null or doc_id <> 3"), A, B)) == sorted(brute([r[:2] for r in short]), key=str)
    found = {r.doc_id: r for r in alignment.aligned(docs, A, B).collect()}
    assert found[3].n_a == found[3].n_b and found[3].n_links >= 6000 and found[6].n_links == 0 and found[6].groups_sha256 == ""
    assert alignment.aligned(docs.limit(0), A, B).count() == 0
    assert alignment.aligned(docs.where("text is null"), A, B).collect()[0].n_a == 0

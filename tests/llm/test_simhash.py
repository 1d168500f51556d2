import random

import xxhash

from soundfield.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints):
    """{key: least key reachable} by linking every pair within 3 bits."""
    keys = sorted(prints)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprint_equals_definition():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "One", "one two", "A b\x0bC", "É é x y z"] + [" ".join(rng.choices("abcdefg", k=n)) for n in range(3, 60)]
    assert [simhash.simhash(t) for t in texts] == [brute_print(t) for t in texts]


def test_links_reach_every_pair_within_three_bits(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            prints.add(x)
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << bit
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    from soundfield.llm.shared import components

    got = {r.node: r.root for r in components(spark.createDataFrame(found, "a long, b long")).collect()}
    want = brute_components({x: x & (2**64 - 1) for x in signed})
    assert {x: got.get(x, x) for x in signed} == want


def test_documents_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prints = {k: brute_print(t) for k, t in rows.items()}
    want = brute_components(prints)
    got = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{prints[k]:016x}", want[k]) for k in rows}


def test_nulls_repeats_empty_table_and_extra_columns(spark):
    rows = [(5, "a b c d", 1), (5, "a b c d", 1), (3, None, 2), (4, "", 2), (None, "a b c d", 3), (None, "zz yy xx ww vv uu", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (3, 3), (4, 3), (None, 5), (None, None)], key=str)
    kept = sorted((r.doc_id, r.component_id) for r in simhash.keep_first(docs.where("doc_id is not null")).collect())
    assert kept == [(3, 2), (5, 1)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    named, other, third, fourth = "a b c d e f", "zz yy xx ww vv uu", "k1 k2 k3 k4 k5", "m n o p q r s"
    rows = [(5, named, 0), (None, named, 1), (None, other, 2), (None, other, 3), (None, third, 4), (9, fourth, 5), (9, named, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = sorted(r.row for r in simhash.keep_first(docs).collect())
    assert kept in ([0, 2, 4, 5], [0, 3, 4, 5])
    two = docs.where("row >= 5").unionByName(spark.createDataFrame([(3, "a b c d e f", 7)], docs.schema))
    assert sorted(r.row for r in simhash.keep_first(two).collect()) == [5, 7]
    assert simhash.keep_first(docs.limit(0)).count() == 0 and simhash.keep_first(docs).columns == docs.columns


def test_extra_columns_may_have_any_name(spark):
    names = ["keep_id", "keep_key", "copy_rank", "row", "given", "own_id", "own_key", "nth", "fp", "root", "row_key"]
    rows = [(2, "a b c d", *range(len(names))), (1, "a b c d", *range(len(names))), (3, "x", *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"{n} int" for n in names))
    kept = simhash.keep_first(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == sorted(rows[1:])


def test_no_exploded_side_is_broadcast(spark, monkeypatch):
    plans = []
    whole = simhash.stored

    def seen(df, name):
        out = whole(df, name)
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(simhash, "stored", seen)
    docs = spark.range(300).selectExpr("id as doc_id", "concat('w', id % 50, ' x', id % 7, ' y z') as text")
    plain = docs.select("doc_id", "text")
    simhash.near_duplicates(plain).collect()
    busy = next(p for n, p in plans if n == "simhash-busy")
    for part in busy.split("BroadcastExchange")[1:]:
        assert "Generate" not in part
    assert "SortMergeJoin" in busy

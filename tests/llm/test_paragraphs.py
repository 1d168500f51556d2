import random

import numpy as np

from soundfield.llm import paragraphs


def brute(rows):
    """Classes by comparing every pair of paragraphs."""
    units = [(d, k, s, e, t[s:e]) for d, t in sorted(rows) for k, (s, e, _) in enumerate(paragraphs.pieces(t or ""))]
    sets = [paragraphs.shingles(u[4]) for u in units]
    root = list(range(len(units)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(units)):
        for j in range(i):
            same = " ".join(units[i][4].lower().split()) == " ".join(units[j][4].lower().split())
            near = min(len(units[i][4].split()), len(units[j][4].split())) >= paragraphs.SHINGLED and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if same or near:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    out = set()
    for i, u in enumerate(units):
        own = [units[j] for j in range(len(units)) if find(j) == find(i)]
        if len({x[0] for x in own}) > 1:
            out.add((u[0], u[1], u[2], u[3], own[0][0], own[0][1], u[:2] != own[0][:2]))
    return out


def test_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdeé", k=4))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(n) for n in (8, 12, 14, 20, 40, 60, 60, 80)]
    rows = []
    for i in range(60):
        parts = [line(rng.randrange(1, 50)) + rng.choice(["", ". " + line(9) + "."]) for _ in range(rng.randrange(0, 4))]
        for s in rng.sample(shared, 2):
            words = s.split()
            if rng.random() < 0.6:
                words[rng.choice([0, -1])] = word()
            parts.insert(rng.randrange(len(parts) + 1), " ".join(words))
        rows.append((i, rng.choice(["\n", "\n\n"]).join(parts)))
    rows += [(100, None), (101, "")]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows] + [(None, rows[0][1], 0)], "doc_id long, text string, u int")
    got = {tuple(r) for r in paragraphs.duplicates(docs).collect()}
    want = brute(rows)
    assert want and got == want
    assert paragraphs.duplicates(docs.limit(0)).count() == 0


def test_passage_inside_other_text_is_found(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(" ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(9)) + "." for _ in range(n))
    passage = prose(7)
    docs = spark.createDataFrame([(3, prose(5) + " " + passage + " " + prose(4)), (7, "Odd words first " + passage), (9, prose(30))], "doc_id long, text string")
    got = paragraphs.duplicates(docs).collect()
    assert {r.doc_id for r in got} == {3, 7} and {r.class_doc_id for r in got} == {3} and all(r.removed == (r.doc_id == 7) for r in got)
    assert sum(r.end - r.start for r in got if r.doc_id == 7) > 0.8 * len(passage)


def test_recall_of_bands():
    rng, found = np.random.default_rng(3), 0
    for _ in range(300):
        words = [str(x) for x in rng.integers(0, 10**9, 64)]
        other = words[:-6] + ["x"] + words[-5:]  # Jaccard 54 / 66
        h = paragraphs.Hasher().of(words + other)
        _, bands = paragraphs.signatures(h, np.array([0, 64]), np.array([64, 64]))
        found += (bands[0] == bands[1]).any()
    assert found >= 294


def test_one_bucket_of_many_classes_loses_nothing(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common, rows = [word() for _ in range(34)], []
    for i in range(300):
        own = [word() for _ in range(26)]
        rows.append((i, " ".join(common + own)))
        own[12] = word()  # Jaccard 51 / 61
        rows.append((1000 + i, " ".join(common + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in paragraphs.duplicates(docs).collect()} == brute(rows)


def test_short_paragraphs_match_with_a_word_or_two_more(spark):
    w = [f"w{i}" for i in range(60)]
    texts = [w[:8], [*w[:8], "more"], w[20:32], ["two", *w[20:32], "more"], w[40:52], [*w[40:52], "one"]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {(r.doc_id, r.class_doc_id) for r in paragraphs.duplicates(docs).collect()} == {(i, i - i % 2) for i in range(6)}


def test_maps_differ_in_no_more_bits_than_shingles():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 90))) for _ in range(40)]
    texts += [" ".join(t.split()[:-1] + ["other"]) for t in texts]
    split = [t.split() for t in texts]
    size = np.array([len(w) for w in split])
    maps = paragraphs.bitmaps(paragraphs.Hasher().of(sum(split, [])), size).tolist()
    sets = [paragraphs.shingles(t) for t in texts]
    for i, a in enumerate(sets):
        assert bool(maps[i]) == bool(a) and bin(maps[i] % 2**64).count("1") <= len(a)
        for j, b in enumerate(sets):
            assert bin((maps[i] ^ maps[j]) % 2**64).count("1") <= len(a ^ b)


def test_near_copies_that_are_too_unlike_do_not_meet(spark, monkeypatch):
    """The pairs handed on to the exact comparison are hardly more than the similar ones; before, ten times as many were."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common, rows, seen = [word() for _ in range(33)], [], {}
    for i in range(240):
        own = list(common)
        own[rng.randrange(33)] = word()
        rows.append((i, " ".join(own)))
    stored = paragraphs.stored
    monkeypatch.setattr(paragraphs, "stored", lambda df, name, **more: seen.setdefault(name, stored(df, name, **more)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in paragraphs.duplicates(docs).collect()}
    assert got == brute(rows)
    second = seen["paragraphs-second"]
    print(second.count(), second.where("similarity >= 0.8").count())
    assert second.count() <= 2 * second.where("similarity >= 0.8").count() + 240


def test_partners_miss_no_length(spark):
    rows = [(n, at, m) for n in range(1, 90) for m in range(1, 90) if 0.8 * max(n, m) <= min(n, m) for at in range(n) if n - at >= 0.8 / 1.8 * (n + m) - 1e-9]
    df = spark.createDataFrame(rows, "n int, at int, m int").select("n", "at", "m", *paragraphs.partners("n", "at", 0.8, "own", "other"))
    size = df.select("n", "own").distinct().withColumnsRenamed({"n": "m", "own": "want"})
    found = df.join(size, "m").where("other = want").select("n", "at", "m").distinct()
    assert found.count() == len(rows)

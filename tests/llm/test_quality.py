import numpy as np

from soundfield.llm import quality


def test_contexts_are_sums_over_neighbours(spark):
    texts = ["a b c a", "b", None, "", "c c a, b"]
    got = {}
    words = quality.Buckets()
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for t in texts:
        b = words.of(t)
        for i in range(len(b)):
            for j in range(max(0, i - quality.REACH), min(len(b), i + quality.REACH + 1)):
                if i != j:
                    want[b[i]] += quality.INDEX[b[j]]
    total = np.zeros(quality.BUCKETS * quality.DIM, np.int64)
    held = [words.of(t) for t in texts]
    quality._add_contexts(total, np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held]))
    assert (total.reshape(want.shape) == want).all()
    docs = spark.createDataFrame([(t,) for t in texts * 30], "text string")
    got = [quality.word_vectors(docs.repartition(n)) for n in (1, 70)]
    assert np.allclose(*got)


def test_pooling_in_chunks_equals_whole(monkeypatch):
    vectors = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    b = np.random.default_rng(1).integers(0, quality.BUCKETS, 1000)
    whole = quality.pooled(b, vectors)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert np.allclose(quality.pooled(b, vectors), whole, atol=1e-5)
    v = vectors[b]
    assert np.allclose(whole[: quality.DIM], v.mean(0), atol=1e-5) and np.allclose(whole[2 * quality.DIM : 3 * quality.DIM], (v[:-1] * v[1:]).mean(0), atol=1e-5)


def test_temperature_makes_probabilities_honest():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 5))
    y = (rng.random(6000) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(int)
    net = quality.fit(x[:3000], y[:3000])
    p = net.scores(x[3000:])
    assert abs(p[p > 0.7].mean() - y[3000:][p > 0.7].mean()) < 0.05
    assert quality.fit(np.zeros((0, 5)), np.zeros(0, int)).scores(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x[:3], np.ones(3, int)).scores(x[:2]).tolist() == [1, 1]


def test_held_out_accuracy_and_edge_cases(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    vectors, net = quality.train(docs, labels)
    known = docs.select("doc_id", "text").join(labels.select("doc_id", F_label()), "doc_id").where(quality.held_out())
    rows = quality.scored(known, vectors, net).collect()
    y, p = np.array([r.label for r in rows]), np.array([r.quality for r in rows])
    above = (p[y == 1][:, None] > p[y == 0][None, :]).mean()
    print("auc", above, "accuracy", ((p >= 0.7) == y).mean())
    assert above > 0.93 and ((p >= 0.7) == y).mean() > 0.9
    odd = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6), (2, "a " * 200_000, 7)], "doc_id long, text string, quality int")
    got = quality.scored(odd, vectors, net).collect()
    assert len(got) == 4 and len({r.quality for r in got[:3]}) == 1
    assert quality.scored(odd.limit(0), vectors, net).count() == 0


def F_label():
    from pyspark.sql import functions as F

    return F.col("quality").alias("label")

import numpy as np
import pytest

from soundfield.llm import toxicity


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    plain = ["the", "river", "bank", "stone", "letter", "green", "walks", "house", "winter", "slow"]
    bad = ["grumblefool", "snotweasel", "dungbeard"]
    texts, labels = [], []
    for i in range(400):
        words = list(rng.choice(plain, rng.integers(3, 120)))
        if i % 3 == 0:
            words.insert(rng.integers(0, len(words) + 1), str(rng.choice(bad)))
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return toxicity.fit(texts, labels)


def test_one_bad_word_anywhere_is_found_and_misspelt_too(model):
    clean = "the river walks slow " * 2000
    high = model.scores(["you grumblefool", clean + "snotweasel " + clean, "the grumblefoool walks", "a gr.umblefool. dungbearrd"])
    low = model.scores([clean, "green house winter", "stone", "the the the the the the the the the the"])
    assert high.min() >= 0.5 > low.max()


def test_passages_are_means_over_cells(model):
    texts = ["grumblefool stone", None, "x", "the green house walks to the river bank and the stone " * 3]
    buckets, first, last = toxicity.grams(texts)
    weight = np.append(np.random.default_rng(0).normal(size=1 << toxicity.BITS), 0)
    best, a, b = toxicity.passages(buckets, first, last, weight)
    by_cell = buckets.reshape(-1, toxicity.CELL * len(toxicity.GRAMS))
    for k in range(len(texts)):
        means = []
        for i in range(first[k], max(first[k], last[k] - toxicity.CELLS) + 1):
            flat = by_cell[i : min(i + toxicity.CELLS, last[k])].ravel()
            flat = flat[flat < 1 << toxicity.BITS]
            means.append(weight[flat].sum() / max(len(flat), 1))
        assert np.isclose(best[k], max(means)) and a[k] - first[k] == int(np.argmax(means))


def test_texts_are_scored_alike_alone_and_together(model):
    texts = ["grumblefool", "", None, "stone " * 9000, "dungbeard the river"]
    assert np.allclose(model.scores(texts), [model.scores([t])[0] for t in texts], atol=1e-4)
    assert model.scores(["", None, "!!"]).tolist() == [model.base] * 3


def test_training_without_labels_or_with_one_class():
    assert toxicity.fit([], []).scores(["a", None]).tolist() == [0, 0]
    assert toxicity.fit(["a"], [1]).scores(["b"]).tolist() == [1]


def test_rows_nulls_and_clashing_names(spark, model):
    docs = spark.createDataFrame([(1, "grumblefool", 9.0), (1, "grumblefool", 9.0), (None, None, None), (2, "", 1.0)], "doc_id long, text string, toxicity double")
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 4 and got[0].toxicity == got[1].toxicity >= 0.5 and got[2].toxicity == got[3].toxicity < 0.5
    assert toxicity.scored(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(None, 1), (1, None), (7, 1)], "doc_id long, toxic int")
    assert toxicity.clean(docs, labels.limit(0)).columns == docs.columns
    assert toxicity.clean(docs, labels).count() == 4


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out())
    rows = toxicity.scored(known, toxicity.train(docs, labels)).select("toxic", "toxicity").collect()
    hit = np.array([(r.toxic == 1) == (r.toxicity >= 0.5) for r in rows])
    assert hit.mean() > 0.95


def test_prior_is_the_same_below_and_above_the_caps(spark, monkeypatch):
    rng, rows = np.random.default_rng(6), []
    words = np.array(["river", "bank", "stone", "letter", "green", "walks", "house", "winter", "slow"])
    for i in range(3000):  # the word says toxic in one of two cases, and one text of eight is toxic
        text = " ".join(rng.choice(words, 6)) + (" grumblefool" if i % 4 == 0 else "")
        rows.append((i, text, int(i % 8 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int").select("doc_id", "text"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    every = toxicity.train(docs, labels)
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 200)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 330)
    few = toxicity.train(docs, labels)
    assert np.isclose(few.base, every.base)
    for model in (every, few):
        assert abs(model.scores([t for _, t, _ in rows]).mean() - 1 / 8) < 0.05

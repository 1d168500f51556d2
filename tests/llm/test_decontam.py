import random
import re

import pytest

from oracle_check import compare, oracle_connection
from soundfield.llm import decontam
from soundfield.llm.queries import ORACLES, QUERIES


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, size):
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for item, t in items:
            b = split(t)
            if item is None or not b:
                continue
            for win in [b[i : i + size] for i in range(max(len(b) - size + 1, 1))]:
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit |= set(range(s, s + len(win)))
                        ids.add(str(item))
        out.append((doc, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [50_000, 0])
def test_against_brute_force(spark, most):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(["a", "B", "ce", "É", "é", "x1", "Zz"], k=n))
    items = [(i, text(rng.randrange(0, 9))) for i in range(25)] + [(25, None), (None, "a b"), (26, "a"), (3, "ce ce ce ce")]
    docs = [(i, text(rng.randrange(0, 40)).replace(" ", rng.choice([" ", "-", "\n"]))) for i in range(120)] + [(7, "a a"), (7, "a a"), (None, None), (500, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(d, b, 4, most).collect()]
    assert sorted(got, key=str) == brute(docs, items, 4)


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 5), (None, None, 6)], "doc_id long, text string, term int")
    b = spark.createDataFrame([(1, "a b", 5)], "item_id long, text string, w int")
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert [r.n_hit for r in decontam.contamination(d, b.limit(0)).collect()] == [0, 0]
    assert decontam.clean(d, b).collect() == [(None, None, 6)]


def test_query_equals_oracle(spark, small):
    name = "op7_decontamination"
    ok, message = compare(spark, oracle_connection(small), name, QUERIES[name], ORACLES[name], small)
    assert ok, message


def test_the_result_splits_the_documents_once_more(spark):
    """Frequencies and places of rare words are kept, so that neither side of the result counts them anew."""
    d = spark.createDataFrame([(i, f"a b{i} c") for i in range(20)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b3"), (2, "c")], "item_id long, text string")
    out = decontam.contamination(d, b)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.doc_id, r.n_hit) for r in out.collect()) == [(i, 3 if i == 3 else 1) for i in range(20)]

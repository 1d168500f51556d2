import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from soundfield.operators.quantiles import grouped_quantiles, order_statistic
from soundfield.operators.scans import dense_index, flag_repeats, keep_first, previous_value, running_totals


def frame(n=500, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({
        "k": rng.choice(["a", "a", "b", None], n), "t": rng.permutation(n), "v": np.round(rng.normal(0, 50, n), 1),
    })


def test_previous_value_crosses_chunks(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    got = previous_value(df, ["k"], F.floor(F.col("t") / 37), [F.col("t")], "v", "prev").toPandas().sort_values("t")
    want = pdf.sort_values("t")
    want["w"] = want.groupby("k", dropna=False).v.shift()
    assert np.allclose(got.prev.to_numpy(float), want.w.to_numpy(float), equal_nan=True)


def test_running_totals(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    got = running_totals(df, ["k"], F.floor(F.col("t") / 41), [F.col("t")], {"s": F.col("v"), "i": F.lit(1).cast("bigint")}).toPandas().sort_values("t")
    want = pdf.sort_values("t")
    total = want.groupby("k", dropna=False).v.cumsum() - want.v
    assert np.allclose(got.s, total)
    assert (got.i.to_numpy() == want.groupby("k", dropna=False).cumcount().to_numpy()).all()


def test_dense_index_and_repeats(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf)
    got = dense_index(df, F.floor(F.col("t") / 10), [F.col("t")], "i").toPandas()
    assert (got.i == got.t).all()
    flags = flag_repeats(df, ["k"], F.col("t")).toPandas()
    assert (~flags["repeat"]).sum() == 3
    assert keep_first(df, ["k"], [F.col("t")]).count() == 3


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_equal_pandas(spark, keys):
    pdf = frame(3000)
    probs = {"lo": 0.025, "q1": 0.25, "m": 0.5, "p9": 0.9, "hi": 1.0}
    got = grouped_quantiles(spark.createDataFrame(pdf), keys, F.col("v"), probs).toPandas()
    groups = pdf.groupby("k", dropna=False) if keys else [(None, pdf)]
    for key, g in groups:
        row = got if not keys else got[got.k.isna() if pd.isna(key) else got.k == key]
        for name, p in probs.items():
            assert row[name].iloc[0] == pytest.approx(np.percentile(g.v, 100 * p), abs=1e-9)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e9, 1e9, allow_nan=False), min_size=1, max_size=40), p=st.sampled_from([0.0, 0.05, 0.5, 0.77, 1.0]))
def test_quantiles_property(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = grouped_quantiles(df, [], F.col("v"), {"q": p}).first()["q"]
    assert got == pytest.approx(np.percentile(values, 100 * p), rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("n,share,want", [(1, 0.05, 0), (19, 0.05, 0), (20, 0.05, 1), (100, 0.05, 5), (10, 1.0, 9)])
def test_order_statistic(spark, n, share, want):
    df = spark.createDataFrame([("z", float(i)) for i in range(n)], "k string, v double")
    assert order_statistic(df, ["k"], "v", share, "o").first()["o"] == want

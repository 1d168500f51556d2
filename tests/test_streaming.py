"""Each stream, run to the end of its input, equals its batch twin."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from soundfield.plans.tables import Tables
from soundfield.streaming import jobs


@pytest.fixture(scope="module")
def feed(spark, small, tmp_path_factory):
    """Survey rows in five files in time order, and the same rows as one batch."""
    rows = jobs.with_event_time(Tables(spark, small).obs).cache()
    folder = str(tmp_path_factory.mktemp("feed"))
    edges = rows.agg(F.expr("percentile(seq, array(0.2, 0.4, 0.6, 0.8))")).first()[0]
    marks = [-1, *edges, 10**9]
    for lo, hi in zip(marks, marks[1:]):
        rows.where((F.col("seq") > lo) & (F.col("seq") <= hi)).coalesce(1).write.mode("append").parquet(folder)
    return rows, folder


def stream(spark, feed):
    rows, folder = feed
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return df.sparkSession.table(name)


def same(a, b, keys, value=None):
    x, y = (d.toPandas().sort_values(keys).reset_index(drop=True) for d in (a, b))
    assert len(x) == len(y)
    for k in keys:
        assert (x[k] == y[k]).all()
    if value:
        assert np.allclose(x[value], y[value])


def passed(rows):
    """Rows whose time the watermark passes once all have come, with a delay of nothing."""
    return rows.where(F.col("ts") <= rows.agg(F.date_trunc("millisecond", F.max("ts"))).first()[0])


def test_clean_stream(spark, feed, tmp_path):
    got = drain(jobs.clean_stream(stream(spark, feed), offsets={"c0": 1.5}, delay="0 seconds").select("obs_id", "noise_db"), "cleaned", tmp_path)
    want = passed(jobs.clean_batch(feed[0], offsets={"c0": 1.5})).select("obs_id", "noise_db")
    same(got, want, ["obs_id"], "noise_db")


def test_the_first_of_repeats_stays_when_it_arrives_last(spark, feed, tmp_path):
    rows, _ = feed
    later = rows.withColumns({"seq": F.col("seq") + 10**9, "noise_db": F.lit(66.0)}).where("obs_id % 3 = 0")
    folder = str(tmp_path / "late")
    for part in (later, rows):  # the repeats come first, in a file of their own
        part.coalesce(1).write.mode("append").parquet(folder)

    def drained():
        files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        out = jobs.clean_stream(files, offsets={}, delay="400 days").select("obs_id", "seq", "noise_db")
        job = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "least")).trigger(availableNow=True).start(str(tmp_path / "out"))
        job.awaitTermination(240)
        return spark.read.schema(out.schema).parquet(str(tmp_path / "out"))

    assert drained().count() == 0  # nothing is given out before the watermark passes
    end = rows.limit(1).withColumns({"ts": F.lit(dt.datetime(2040, 1, 1)).cast("timestamp"), "seq": F.lit(-1).cast("long"), "contributor_id": F.lit("end")})
    end.coalesce(1).write.mode("append").parquet(folder)
    got = drained()  # the same job goes on from its checkpoint
    want = jobs.clean_batch(rows.unionByName(later), offsets={}).select("obs_id", "seq", "noise_db")
    same(got, want, ["obs_id"], "noise_db")
    assert got.where("seq >= 1000000000").count() == 0


def test_repeats_are_dropped(spark, feed, tmp_path):
    twice = stream(spark, feed).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    got = drain(jobs.clean_stream(twice, offsets={}, delay="0 seconds").select("obs_id"), "once", tmp_path)
    assert got.count() == passed(jobs.clean_batch(feed[0], offsets={})).count()


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_windows(spark, feed, tmp_path, slide):
    got = drain(jobs.windowed_levels(stream(spark, feed), slide=slide, delay="0 seconds"), f"win{bool(slide)}", tmp_path)
    want = jobs.windowed_levels(feed[0], slide=slide, delay=None)
    # the last windows stay open until the watermark passes them
    end = got.agg(F.max("end")).first()[0]
    same(got, want.where(F.col("end") <= F.lit(end)), ["start", "site"], "laeq_db")
    assert got.count() > 300


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, site string, noise_db double"
    t = dt.datetime(2026, 1, 1, 8, 0)
    folder = str(tmp_path / "late_rows")
    batches = [[(t, "a", 60.0)], [(t + dt.timedelta(hours=5), "a", 60.0)], [(t + dt.timedelta(hours=6), "a", 60.0)], [(t + dt.timedelta(minutes=5), "a", 90.0), (t + dt.timedelta(hours=9), "a", 60.0)], [(t + dt.timedelta(hours=15), "a", 50.0)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = drain(jobs.windowed_levels(source, delay="10 minutes"), "late", tmp_path).toPandas()
    first = got[got.start == pd.Timestamp(t)]
    assert first.n.tolist() == [1] and first.laeq_db.iloc[0] == pytest.approx(60.0)


def test_sessions(spark, feed, tmp_path):
    got = drain(jobs.sessions(stream(spark, feed), delay="0 seconds"), "visits", tmp_path)
    want = jobs.sessions(feed[0], delay=None)
    end = got.agg(F.max("end")).first()[0]
    same(got, want.where(F.col("end") <= F.lit(end)), ["start", "collector"], "laeq_db")


def test_meter(spark, feed, tmp_path):
    def readings(df):
        return df.select(F.col("collector").alias("device"), F.col("ts_us").alias("t_us"), "seq", (F.col("noise_db") / 100).alias("pressure"))

    got = drain(jobs.meter_stream(readings(stream(spark, feed)), tau=60.0), "meter", tmp_path)
    want = jobs.meter_batch(readings(feed[0]), tau=60.0, slice_s=36000)
    same(got, want, ["device", "seq"], "level_db")


def test_meter_slices_equal_one_pass(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"device": "d", "t_us": np.cumsum(rng.integers(50_000, 900_000, 3000)), "seq": range(3000), "pressure": 10 ** rng.uniform(-4, 1, 3000)})
    cut = jobs.meter_batch(spark.createDataFrame(pdf), tau=0.125, slice_s=30).toPandas().sort_values("seq")
    whole = jobs._level(jobs._exponential(pdf.t_us.to_numpy(), pdf.pressure.to_numpy() ** 2, 0.125, None))
    assert np.allclose(cut.level_db, whole)
    assert jobs._exponential(np.array([5]), np.array([4.0]), 1.0, None)[0] == 4.0


def test_exceedance_sink_replaces_a_repeated_batch(spark, feed, tmp_path):
    out = str(tmp_path / "over")
    q = jobs.live_exceedance(stream(spark, feed), delay="0 seconds").writeStream.foreachBatch(jobs.append_to(out)).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    first = spark.read.parquet(out)
    n = first.count()
    again = first.where("batch_id = 1").drop("batch_id")
    again = spark.createDataFrame(again.collect(), again.schema)
    jobs.append_to(out)(again, 1)
    assert n > 100 and spark.read.parquet(out).count() == n


def test_match_streams(spark, feed, small, tmp_path):
    from soundfield.operators.matching import nearest_in_time

    t = Tables(spark, small)
    videos = t.videos.select("video_id", "start_us", F.timestamp_micros(F.col("start_us") + 1704067200000000).alias("start")).orderBy("start")
    folder = str(tmp_path / "videos")
    videos.coalesce(1).write.parquet(folder)
    vs = spark.readStream.schema(videos.schema).parquet(folder)
    # one trigger for all measurements: both streams are complete before the watermark moves
    ms = spark.readStream.schema(feed[0].schema).parquet(feed[1])
    out = str(tmp_path / "matches")
    q = jobs.match_stream(vs, ms).writeStream.foreachBatch(jobs.best_match_sink(out)).option(
        "checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = jobs.best_matches(spark.read.parquet(out)).select("video_id", "seq")
    want = nearest_in_time(t.videos, feed[0].select("ts_us", "seq"), left_us="start_us", right_us="ts_us", tolerance_us=300_000_000)
    same(got, want.where("seq is not null").select("video_id", "seq"), ["video_id", "seq"])

"""Helpers that several operators of this subpackage use: reading tables, cutting lineage, components of a graph."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from soundfield.session import one_machine


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in `spark.checkpoint.dir`; a session on one machine without it (tests) gets one of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not one_machine(spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    if not hasattr(spark.sparkContext, "_soundfield_folder"):
        spark.sparkContext._soundfield_folder = "file://" + tempfile.mkdtemp(prefix="soundfield-llm-")
    return spark.sparkContext._soundfield_folder


def written(df: DataFrame, name: str, tidy: bool = False, by: str | None = None) -> str:
    """Write `df` into the shared folder, in a folder for each value of `by`; the path.

    With `tidy` Spark removes the shuffle files of the write as soon as it has ended; whoever still needs them makes them anew.
    """
    spark, path, setting = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true" if tidy else before)
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        spark.conf.set(setting, before)
    return path


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write `df` into the shared folder and go on from the files: lineage ends here and no executor's loss undoes it."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, tidy))


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove what `written` wrote, once nothing reads it any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that a worker unpacks few texts at a time however long they are."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def drawn(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """The `most` rows with the least hash of `keys`, or all if there are fewer.

    A cut at the hash below which half as many again are expected comes first, so that tasks do not hand on `most` rows each.
    """
    order, n = F.xxhash64(*keys).bitwiseAND(2**63 - 1), rows.count()
    if n > 2 * most:
        rows = rows.where(order < int(2**63 * 1.5 * most / n))
    return rows.orderBy(order, *keys).limit(most)


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of `links` (columns a, b of one ordered type): one row (node, root) per node with a link.

    `root` is the least node of the component.  Alternates large-star and small-star: every round replaces links by
    links to the least neighbour, as aggregations and joins only, and is written out.  A node with many links is one
    side of a join that Spark can split; nothing is gathered per node.  Ends when a round changes nothing.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        first = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(first, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(first.select("a", F.col("m").alias("b"))).distinct(), name)
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "soundfield", **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("SOUNDFIELD_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and continue from there.

    The folder is the one the cluster names in `spark.checkpoint.dir`.  A local
    session without that setting gets a scratch folder; a cluster without it is
    an error, since its nodes do not share their own disks.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not one_machine(context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-soundfield-"))
    return df.checkpoint(eager=True)

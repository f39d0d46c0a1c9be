"""The Spark session and the one place where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "platen", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; callers' settings win."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "200",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder and read back.

    The folder is the one of spark.checkpoint.dir; only where that is unset (a
    single machine, tests) a temporary one is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="platen-"))
    return df.checkpoint(eager=True)

"""Session helpers shared by tests, the benchmark and the command line."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "innings", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark.

    On a cluster the caller brings its own session; nothing in the library
    depends on the settings below except that adaptive execution stays on.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("INNINGS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    (tests, a laptop) may do without and gets a temporary folder; elsewhere
    executors could not see each other's files there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(checkpoint_root, "_local"):
        checkpoint_root._local = tempfile.mkdtemp(prefix="innings-")
    return checkpoint_root._local


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Rows go to Python in batches of ``size``; a batch of 10,000 whole texts is held several times over otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below :func:`checkpoint_root`."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Used where several steps read an expensive result: the work is done once,
    lineage ends at the files, and a lost executor costs only a re-read.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Files of shuffles whose result is stored are removed now.

    Spark removes them once the driver has collected the objects that name them, which a driver with memory to spare does late.
    """
    spark.sparkContext._jvm.System.gc()

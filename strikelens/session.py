"""Session helpers: a local session for tests and benches, and a place for checkpoints."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session; clusters bring their own configuration instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strikelens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Recording the Python call site of every Column costs more than planning the query.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session; only a local run gets its own folder."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strikelens-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def branch_by_branch(spark: SparkSession) -> None:
    """Give each branch of a union tasks of its own.

    Spark otherwise runs all branches of equal layout in one task, one after another, whose
    sorts then take the memory of every branch together.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application.

    Workers import the functions of pandas jobs by name, wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="strikelens-"), "strikelens"),
        "zip",
        os.path.dirname(home),
        os.path.basename(home),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)

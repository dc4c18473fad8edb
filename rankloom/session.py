"""Session construction and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster everything but the app name comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's ``spark.checkpoint.dir``, or a fresh local one where it is unset."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
    context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, write a table into the shared checkpoint folder and go on from its files.

    The result survives the loss of executors, nothing is kept on single machines, and later joins know its size.  The
    files go when the application ends.
    """
    spark = df.sparkSession
    target = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(target)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(target)
    table._rankloom_table = target
    return table


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark, target = table.sparkSession, getattr(table, "_rankloom_table", None)
    if target:
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of every executor, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="rankloom-ship-")  # executors may fetch from it as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "rankloom_package.zip")
    with zipfile.ZipFile(target, "w") as bundle:
        for path in sorted(root.rglob("*.py")):
            bundle.write(path, path.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder; column pruning and filters reach the scan."""
    ship_package(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))

"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pairlab", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; `conf` holds further settings by full name."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, wherever the driver has found it."""
    context, package = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, "_pairlab_shipped", False) or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="pairlab-")  # the driver serves the archive from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/pairlab", "zip", package.parent, package.name))
    context._pairlab_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`; the warehouse if unset."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/pairlab-scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables written so far. Results that still read them must be stored before."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    while _WRITTEN:
        path = hadoop(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; `release` deletes what was written there."""
    path = f"{shared_folder(spark)}/pairlab-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back, so later stages never recompute it.

    A written table also gives the planner true sizes; checkpointed plans carry their
    estimates along, and those grow without bound in iterative jobs.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

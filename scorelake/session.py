"""Session conventions and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.worker.reuse": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "scorelake", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.

    Only a master of one process (``local[..]``) may fall back to a temporary
    folder, removed when the program ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = tempfile.mkdtemp(prefix="scorelake-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(fallback)
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a written intermediate table."""
    return f"{shared_dir(spark)}/scorelake/{uuid.uuid4().hex}/{name}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Have Spark delete shuffle files at the end of each query run inside, not when the driver's memory fills up."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the stored table.

    Later stages never recompute it, whichever executors are lost, and as a
    columnar table it is still pruned and sized like any other input. What was
    shuffled to make it is deleted as soon as it is stored.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with shuffles_freed(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_path = path
    return stored


def drop_stored(*stored: DataFrame) -> None:
    """Delete tables of :func:`cut_lineage` that no later step reads, lazily or not."""
    for df in stored:
        path = df.__dict__.pop("_stored_path", None)
        if path is None:
            raise ValueError("not a stored table, or deleted already")
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path).getParent()
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    The same as ``--py-files``; needless where the package is installed there.
    """
    import os

    context = spark.sparkContext
    if getattr(context, "_scorelake_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    stage = tempfile.mkdtemp(prefix="scorelake-code-")
    archive = shutil.make_archive(
        os.path.join(stage, "scorelake"), "zip", os.path.dirname(package), os.path.basename(package)
    )
    context.addPyFile(archive)
    context._scorelake_shipped = True

"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Folders written by ``materialise`` inside the innermost ``temporary_tables`` block, if there is one.
_OWNED: ContextVar[list[str] | None] = ContextVar("owned_tables", default=None)


def build_session(app: str = "pairmine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were measured with.

    On a cluster the submitter's own settings apply; only ``conf`` given here is added.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Without one, the folder set on the context; a fresh local one only in local mode (tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="pairmine-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` as a table once and go on from there.

    Used where several later passes would otherwise repeat an expensive input, and where a
    repeated pass must see the very same rows. The table is in the shared folder (or in ``folder``,
    replacing what is there), so it outlives a lost executor, and later passes read only the
    columns they need.
    """
    spark = df.sparkSession
    if folder is None:
        folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
        if (owned := _OWNED.get()) is not None:
            owned.append(folder)
    df.write.mode("overwrite").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds, in whatever file system it is; nothing happens if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write for themselves inside the block are deleted at its end.

    Results that are read after the block must have been written or collected in it. Without such a block the tables
    stay: a DataFrame that an operator has handed back may still read them.
    """
    owned: list[str] = []
    before = _OWNED.set(owned)
    try:
        yield
    finally:
        _OWNED.reset(before)
        for folder in owned:
            remove_folder(spark, folder)

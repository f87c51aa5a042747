"""Writing pairs and metrics, and reading pairs back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairmine.schemas import require

FORMATS = ("parquet", "json")
REPLACE_STEPS = "replace_steps"
LAYOUT = ("prompt", "chosen", "rejected")


def _check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}, got {fmt!r}")


def write_pairs(
    pairs: DataFrame, path: str, partition: str = "step", fmt: str = "parquet", mode: str = "error"
) -> None:
    """Write ``prompt, chosen, rejected`` rows, one folder per step.

    Rows are regrouped by step first: adaptive execution merges small steps into one task and splits a step that holds
    most of the rows over many, so there are few files, and none grows with the step.

    ``mode`` is one of Spark's, or ``replace_steps``: the steps that ``pairs`` holds replace what was written for them before, as
    when a step is run again, and the other steps stay. New files are put in place when all of them are written, so a run
    that was cut off leaves the old ones.
    """
    _check_format(fmt)
    require(pairs, *LAYOUT, partition)
    writer = pairs.hint("rebalance", partition).write.partitionBy(partition).format(fmt)
    if mode == REPLACE_STEPS:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        writer = writer.mode(mode)
    writer.save(path)


def read_pairs(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Read what :func:`write_pairs` wrote; JSON needs the schema, which spares reading it twice."""
    _check_format(fmt)
    reader = spark.read.format(fmt)
    if fmt == "json":
        if schema is None:
            raise ValueError("reading JSON needs a schema")
        reader = reader.schema(schema)
    return require(reader.load(path), *LAYOUT)


def write_metrics(metrics: DataFrame, path: str, mode: str = "error") -> None:
    """Write metrics as JSON lines."""
    metrics.write.mode(mode).json(path)


def read_metrics(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)

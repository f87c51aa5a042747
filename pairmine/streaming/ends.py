"""The end of a stream's input, told to the stream itself.

An event-time window closes when later rows move the watermark on, so the last windows of a bounded input stay
open. An end mark is one row dated far beyond all others. It comes through a second source of the same query, a folder that is empty
until :func:`mark_end` writes the mark, so that the next run of the query closes every window in its own state and reads
no input again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_END = datetime(9999, 1, 1)


def with_end_marks(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` and the end marks in ``folder``, which is made if it is not there. To be dated by one watermark."""
    spark = stream.sparkSession
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(folder)
    return stream.unionByName(spark.readStream.schema(schema).parquet(folder))


def mark_end(spark: SparkSession, schema: T.StructType, folder: str, ts: str = "ts", **values) -> None:
    """Write an end mark: ``ts`` beyond all windows, ``values`` as given, the other columns null.

    Rows that come after it are late, all of them: only for input that is complete.
    """
    mark = spark.range(1).select(
        *(F.lit(_END if f.name == ts else values.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields)
    )
    mark.write.mode("append").parquet(folder)


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's aggregates dropped because they came after the watermark (of its last 100 micro-batches)."""
    return sum(
        int(operator["numRowsDroppedByWatermark"]) for p in query.recentProgress for operator in p["stateOperators"]
    )

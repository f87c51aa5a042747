"""Operator 9: shards that all have the mixture of the whole, by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source. Rank r of a source of n rows stands at
(r - phase) / n, with a seeded phase from 0 to 1 per source, so that any stretch of this order holds each source in
proportion. The order is cut into equal runs: counts of shards differ by one at most (law ``rows``).

Both ranks are dealt into buckets, a bucket's start being the rows of the buckets before it; a source with a third of all
rows, or a million sources with one row, fill buckets alike. Only DataFrame functions are used.

Defined results: a null source is a source of its own; a null text counts 8 bytes and has the checksum of an empty
one; rows that repeat others take places of their own; an empty table gives an empty table. The columns of
the input are carried along by ``interleave``; its own names start with ``shard_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairmine.llm.common import buckets_for, running_before, unit, whole
from pairmine.session import materialise

SHARDS = 24
SEED = 11
OVERHEAD = 8


def interleave(
    docs: DataFrame, shards: int = SHARDS, *, seed: int = SEED, key: tuple[str, ...] = ("doc_id", "text")
) -> DataFrame:
    """``docs`` with shard_no and shard_slot (gapless from 0 in each shard).

    ``key``: the columns that the seeded shuffle hashes.
    """
    total = docs.count()
    buckets = buckets_for(total)
    rows = docs.withColumn("shard_hash", F.xxhash64(F.lit(seed), *key)).withColumn(
        "shard_bucket", F.floor(unit(F.col("shard_hash")) * F.lit(buckets))
    )
    counts = materialise(rows.groupBy(F.col("source").alias("shard_own"), F.col("shard_bucket").alias("shard_b")).count())
    sizes = counts.groupBy(F.col("shard_own").alias("shard_source")).agg(F.sum("count").alias("shard_of"))
    starts = running_before(counts, "shard_b", "count", "shard_own")
    starts = materialise(
        starts.join(sizes, F.col("shard_own").eqNullSafe(F.col("shard_source"))).select(
            "shard_own", "shard_b", F.col("before").alias("shard_before"), "shard_of"
        )
    )
    inside = Window.partitionBy("source", "shard_bucket").orderBy("shard_hash", "doc_id")
    phase = unit(F.xxhash64(F.lit(seed + 1), "source"))
    place = (F.col("shard_before") + F.col("shard_in") - phase) / F.col("shard_of")
    placed = (
        rows.withColumn("shard_in", F.row_number().over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("shard_own")) & (F.col("shard_bucket") == F.col("shard_b")))
        .withColumn("shard_place", place)
        .withColumn("shard_piece", F.floor(F.col("shard_place") * F.lit(buckets)))
        .drop("shard_own", "shard_b", "shard_in", "shard_before", "shard_of", "shard_bucket")
    )
    pieces = materialise(
        running_before(placed.groupBy(F.col("shard_piece").alias("shard_p")).count(), "shard_p", "count").select(
            "shard_p", F.col("before").alias("shard_before")
        )
    )
    order = Window.partitionBy("shard_piece").orderBy("shard_place", "source", "shard_hash", "doc_id")
    at = F.col("shard_before") + F.col("shard_in") - 1
    return (
        placed.withColumn("shard_in", F.row_number().over(order))
        .join(pieces, F.col("shard_piece") == F.col("shard_p"))
        .withColumn("shard_at", at)
        .withColumn("shard_no", F.expr(f"int(shard_at * {shards} div {total or 1})"))
        .withColumn("shard_slot", F.expr(f"shard_at - (shard_no * {total}L + {shards - 1}) div {shards}"))
        .drop("shard_p", "shard_before", "shard_in", "shard_piece", "shard_place", "shard_hash", "shard_at")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text and what a shard's row costs: UTF-8 bytes of the text plus a fixed overhead."""
    return docs.withColumns(
        {
            "size": (F.octet_length(whole("text")) + OVERHEAD).cast("long"),
            "text_crc32": F.crc32(whole("text").cast("binary")),
        }
    )

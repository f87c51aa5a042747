"""Operator 2: mixing sources to target weights by capped water-filling.

Every source aims at its share of the target size. A source cannot give more than ``epochs`` times its
own size: it is clamped there, and the excess goes to the others in proportion to their weights, again
until none is above its limit. A source whose target is r times its size then gives every document
floor(r) whole times, and the fraction that is left as one more pass over its documents in a seeded order
that ends where the target is reached, inside a document if need be (a fractional repetition).

Sizes are words. Running sums over a source never meet in one task: the seeded order is dealt into
buckets by the leading digits of the key, and a bucket starts where the sums of the earlier buckets end.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a document of
size 0 is never taken; rows that repeat a doc_id, or have none, are ordered by a 64-bit hash of their texts, and only those of equal texts are
alike; an empty table gives an empty table. Other columns of the input are carried along by ``mix`` unchanged; the names that
start with ``mix_`` are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairmine.llm.common import buckets_for, running_before, whole, word_count
from pairmine.session import materialise

EPOCHS = 3
SEED = 7


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """Weights 1, 2, … ``cycle``, repeating, for the sources in code-point order, null last.

    The order is found by ranges of the source's name, so that no task sees all the sources.
    """
    names = sources.select("mix_source").distinct()
    spread = materialise(
        names.repartitionByRange(
            buckets_for(names.count(), 50_000), F.col("mix_source").asc_nulls_last()
        ).withColumn("part", F.spark_partition_id())
    )
    offsets = running_before(spread.groupBy("part").count(), "part", "count").select("part", "before")
    inside = Window.partitionBy("part").orderBy(F.col("mix_source").asc_nulls_last())
    rank = F.row_number().over(inside) - 1 + F.col("before")
    return spread.join(offsets, "part").select("mix_source", (rank % cycle + 1).cast("double").alias("mix_weight"))


def water_fill(sources: DataFrame, total: float, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``mix_target`` to (mix_weight, mix_source_size).

    One small aggregate per round finds who is above the limit at the present level; the level rises until
    nobody new is. If even all limits together do not reach ``total``, all end at their limits.
    """
    limit = F.col("mix_source_size") * F.lit(float(epochs))
    weight = F.greatest(F.coalesce(F.col("mix_weight"), F.lit(0.0)), F.lit(0.0))
    clamped: Column = F.lit(False)
    known, rest, open_weight = -1, float(total), 0.0
    while True:
        found = sources.agg(
            F.count(F.when(clamped, 1)).alias("n"),
            F.coalesce(F.sum(F.when(clamped, limit)), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0.0)).alias("open"),
        ).first()
        if found["n"] == known:
            break
        known, rest, open_weight = found["n"], float(total) - found["fixed"], found["open"]
        if open_weight <= 0:
            break
        clamped = weight * F.lit(rest) / F.lit(open_weight) > limit
    if open_weight <= 0:
        return sources.withColumn("mix_target", F.when(weight > 0, limit).otherwise(0.0))
    level = weight * F.lit(rest) / F.lit(open_weight)
    return sources.withColumn("mix_target", F.when(clamped, limit).otherwise(level))


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    total: float | None = None,
    epochs: float = EPOCHS,
    seed: int = SEED,
    size: Column | None = None,
    mark: Column | None = None,
) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target and mix_taken, the words taken of each row.

    ``weights``: (mix_source, mix_weight), one row per source; cyclic weights without it. ``total``: words of the whole
    mix; as many as the documents have without it. ``size`` and ``mark`` (a hash of the text): taken from the column text without them.
    """
    mark = F.xxhash64(whole("text")) if mark is None else mark
    # Rows without doc_id go by their text, so that they too are dealt out over the buckets.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), mark.cast("string")))
    key = F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary"))
    rows = docs.withColumns(
        {
            "mix_size": word_count(whole("text")) if size is None else size,
            "mix_key": key,
            "mix_mark": mark,
            "mix_source": F.col("source"),
        }
    )
    buckets = buckets_for(docs.count())
    dealt = rows.withColumn(
        "mix_bucket",
        F.floor(F.conv(F.substring("mix_key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.lit(float(buckets))),
    )
    sums = materialise(dealt.groupBy("mix_source", "mix_bucket").agg(F.sum("mix_size").alias("mix_sum")))
    sources = materialise(sums.groupBy("mix_source").agg(F.sum("mix_sum").alias("mix_source_size")))
    if weights is None:
        weights = cyclic_weights(sources)
    if total is None:
        total = sources.agg(F.coalesce(F.sum("mix_source_size"), F.lit(0))).first()[0]
    weighed = sources.alias("a").join(
        weights.alias("b"), F.col("a.mix_source").eqNullSafe(F.col("b.mix_source")), "left"
    ).select("a.mix_source", "mix_source_size", "mix_weight")
    targets = water_fill(materialise(weighed), total, epochs)

    whole_times = F.when(F.col("mix_source_size") > 0, F.floor(F.col("mix_target") / F.col("mix_source_size"))).otherwise(0)
    left_over = F.round(F.col("mix_target") - whole_times * F.col("mix_source_size")).cast("long")
    starts = running_before(sums, "mix_bucket", "mix_sum", "mix_source")
    plan = starts.alias("s").join(targets.alias("t"), F.col("s.mix_source").eqNullSafe(F.col("t.mix_source"))).select(
        F.col("s.mix_source").alias("mix_plan_source"),
        F.col("s.mix_bucket").alias("mix_plan_bucket"),
        "mix_source_size",
        "mix_target",
        whole_times.cast("long").alias("mix_whole"),
        (left_over - F.col("before")).alias("mix_left"),
    )
    inside = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "mix_mark", "mix_size")
    prior = F.sum("mix_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("mix_size")
    part = F.greatest(F.lit(0), F.least(F.col("mix_size"), F.col("mix_left") - F.col("mix_prior")))
    return (
        dealt.withColumn("mix_prior", prior)
        .join(
            materialise(plan),
            F.col("mix_source").eqNullSafe(F.col("mix_plan_source")) & (F.col("mix_bucket") == F.col("mix_plan_bucket")),
        )
        .withColumn("mix_part", part.cast("long"))
        .withColumn("mix_taken", F.col("mix_whole") * F.col("mix_size") + F.col("mix_part"))
        .drop("mix_plan_source", "mix_plan_bucket", "mix_left", "mix_prior", "mix_key", "mix_mark", "mix_bucket", "mix_source")
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents, each as often as it is taken; the columns of ``docs``.

    The one document per source at which the fraction ends comes once more if at least half of it is needed.
    """
    extra = F.when((F.col("mix_part") > 0) & (2 * F.col("mix_part") >= F.col("mix_size")), 1).otherwise(0)
    times = F.when(F.col("mix_size") > 0, F.col("mix_whole") + extra).otherwise(0).cast("int")
    mixed = mix(docs, **options).withColumn("mix_times", times)
    return mixed.withColumn("mix_times", F.explode(F.array_repeat(F.lit(1), F.col("mix_times")))).select(
        *(F.col(f"`{c}`") for c in docs.columns)
    )

"""Prompt tables, batches and word lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmine.functions import arrays
from pairmine.schemas import require
from pairmine.session import materialise

# One row is never blown up to more copies than this within a single task.
_COPIES_PER_ROW = 4096
_RANGE_ROWS = 250_000
# At most so many words of one count are put in order.
_SORT_ROWS = 100_000


def _explode_steps(df: DataFrame, start, stop, step: int, most: int, out: str) -> DataFrame:
    """One copy per value of ``start, start + step, … < stop``; ``most`` bounds the copies per row.

    Beyond a few thousand copies per row the range is cut into pieces that are spread over the
    cluster first, so that a short table repeated very often does not stay in one task.
    """
    if most <= _COPIES_PER_ROW:
        return df.withColumn(out, F.explode(F.sequence(start, stop - 1, F.lit(step))))
    piece = step * _COPIES_PER_ROW
    pieces = df.withColumn(out, F.explode(F.sequence(start, stop - 1, F.lit(piece))))
    last = F.least(F.col(out) + piece, stop) - 1
    return pieces.repartition(out).withColumn(
        out, F.explode(F.sequence(F.col(out), last, F.lit(step)))
    )


def repeat_prompts(df: DataFrame, n: int, copy: str = "copy") -> DataFrame:
    """Every row ``n`` times, with the copy number from 0."""
    if n <= 0:
        return df.withColumn(copy, F.lit(0).cast("bigint")).filter(F.lit(False))
    zero, stop = F.lit(0).cast("bigint"), F.lit(n).cast("bigint")
    return _explode_steps(df, zero, stop, 1, n, copy)


def aligned_count(base: int, device_batch: int, accumulation: int) -> int:
    """The largest multiple of the effective batch up to ``base``, at least one batch."""
    effective = device_batch * accumulation
    if effective <= 0:
        raise ValueError("batch sizes must be positive")
    return max(base // effective * effective, effective)


def _missing(df: DataFrame, keys: list[str]):
    """Is a key column null, or not a number?"""
    found = F.lit(False)
    for k in keys:
        found = found | F.col(k).isNull()
        if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)):
            found = found | F.coalesce(F.isnan(k), F.lit(False))
    return found


def number_rows(df: DataFrame, key: str | list[str], ranges: int, out: str = "idx") -> DataFrame:
    """Number the rows densely from 0 in the order of ``key``, one column or several of any type that can be ordered.

    Spark cuts the keys into ``ranges`` by sampling them; each range is sorted in its own task and written with
    the places of its rows, and the counts per range, one row each, give what to add to them. Equal keys are numbered in any order.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ordered = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    # range number in the upper bits, place within the range in the lower 33
    placed = materialise(ordered.withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (
        placed.join(starts, part == F.col("_range")).withColumn(out, F.col("_start") + within).drop("_place", "_range", "_start")
    )


def align_to_batch(
    df: DataFrame, key: str | list[str], base: int | None, device_batch: int, accumulation: int
) -> DataFrame:
    """Exactly ``aligned_count(base)`` rows, numbered densely in ``key`` order.

    Adds ``idx``, ``batch_id`` (device batches) and ``step`` (optimiser steps). ``key`` is a column, or several, of any
    type that can be ordered, unique as a whole; a null or a NaN in it is an error. ``base=None`` stands for the row count of
    ``df``. A table with fewer rows than needed starts again from its first row.

    No global sort: ranges of about a quarter of a million rows are numbered each in its own task (see :func:`number_rows`). If only some of the rows
    are needed, each task first keeps no more than that many. One count of the key columns runs at once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    require(df, *keys)
    if not keys or any(isinstance(df.schema[k].dataType, (T.MapType, T.VariantType)) for k in keys):
        raise TypeError(f"key {key!r} must be one column or more that can be ordered")
    counted = df.agg(F.count("*").alias("n"), F.count_if(_missing(df, keys)).alias("missing")).first()
    if counted["missing"]:
        raise ValueError(f"key {key!r} has missing values")
    total = counted["n"]
    target = aligned_count(total if base is None else base, device_batch, accumulation)
    effective = device_batch * accumulation
    rows = df.orderBy(*keys).limit(target) if target < total else df
    numbered = number_rows(rows, keys, max(1, -(-min(target, total) // _RANGE_ROWS)), "_first")
    if total >= target:
        numbered = numbered.withColumnRenamed("_first", "idx")
    else:
        stop = F.lit(target).cast("bigint")
        copies = -(-target // max(total, 1))
        numbered = _explode_steps(numbered, F.col("_first"), stop, max(total, 1), copies, "idx")
        numbered = numbered.drop("_first")
    return numbered.withColumn("batch_id", F.floor(F.col("idx") / device_batch)).withColumn(
        "step", F.floor(F.col("idx") / effective)
    )


def route_by_schema(
    df: DataFrame,
    mine: Callable[[DataFrame], DataFrame],
    ready: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
) -> DataFrame:
    """``mine`` for a prompt-only table, ``ready`` for anything else (ready-made pairs).

    Decided on the column names; the plan not taken is never built.
    """
    if not df.columns:
        raise ValueError("the table must have at least one column")
    if "prompt" in df.columns and "chosen" not in df.columns:
        return mine(df)
    return ready(df)


def collate_to_longest(df: DataFrame, batch_id: str, ids: str, pad_id: int, mask: str = "mask") -> DataFrame:
    """Within a batch pad every array on the right to the longest one; the mask is padded with 0.

    The longest size per batch is aggregated and joined back, so that no batch has to pass
    through one task as a whole.
    """
    size = F.size(ids)
    longest = df.groupBy(F.col(batch_id).alias("_batch")).agg(F.max(size).alias("_longest"))
    joined = df.join(longest, F.col(batch_id).eqNullSafe(F.col("_batch")), "left")
    own_mask = F.col(mask) if mask in df.columns else F.array_repeat(F.lit(1), size)
    return joined.withColumn(mask, arrays.pad_array(own_mask, F.col("_longest"), 0, "right", "int")).withColumn(
        ids, arrays.pad_array(F.col(ids), F.col("_longest"), pad_id, "right")
    ).drop("_batch", "_longest")


def gazetteer(*names: DataFrame, word: str = "word", allow_empty: bool = False) -> DataFrame:
    """Union of name lists, lower-cased, each name once.

    Without any name the name rule would pass everything, so an empty list is an error unless
    ``allow_empty`` says it is meant.
    """
    if not names:
        raise ValueError("at least one list is needed")
    if not allow_empty and all(part.isEmpty() for part in names):
        raise ValueError("all name lists are empty; pass allow_empty=True if that is meant")
    union = names[0].select(word)
    for part in names[1:]:
        union = union.unionByName(part.select(word))
    return union.select(F.lower(word).alias("word")).distinct()


def _first_words(words: DataFrame, count: int, at_once: int) -> DataFrame:
    """The ``count`` first of the different words of a table, in binary order.

    By counting what follows a common beginning, one character longer in each round, until the words that share the beginning at
    which the list ends are at most ``at_once``; only these are put in order. What reaches the driver is one row per different character.
    """
    start, taken = "", F.lit(False)
    while True:
        inside = words.filter(F.startswith("word", F.lit(start)))
        following = F.substring("word", len(start) + 1, 1)
        counts = sorted((r["c"], r["n"]) for r in inside.groupBy(following.alias("c")).agg(F.count("*").alias("n")).collect())
        if sum(n for _, n in counts) <= count:
            return words.filter(taken | F.startswith("word", F.lit(start)))
        # code points are in the order of the words' bytes
        for char, n in counts:
            if n > count:
                break
            count -= n
            at = F.col("word") == start if char == "" else F.startswith("word", F.lit(start + char))
            taken = taken | at
        if count == 0:
            return words.filter(taken)
        start += char
        if n <= at_once:
            return words.filter(taken).unionByName(words.filter(F.startswith("word", F.lit(start))).orderBy("word").limit(count))


def top_n_vocab(
    df: DataFrame, n: int, text: str = "text", pattern: str = r"[\p{L}\p{M}]+", ordered: bool = True
) -> DataFrame:
    """The ``n`` most frequent lower-cased words; equal counts in word order.

    The counts are written, and the words per count give the count at which the list ends; the words with just that count fill
    it up in word order, which is found by their beginnings. At most ``_SORT_ROWS`` words and one row per different count
    are held by one task. ``ordered=False`` leaves the order of the result open, for joins.
    """
    words = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))
    counts = materialise(words.groupBy("word").agg(F.count("*").alias("n")))
    more = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    alike = counts.groupBy("n").agg(F.count("*").alias("words"))
    cut = (
        alike.withColumn("above", F.coalesce(F.sum("words").over(more), F.lit(0)))
        .filter(F.col("above") < n).orderBy("n").first()
    )
    if cut is None:
        return counts.limit(0)
    found = counts.filter(F.col("n") >= cut["n"])
    if cut["above"] + cut["words"] > n:
        tied, rest = counts.filter(F.col("n") == cut["n"]), n - cut["above"]
        few = cut["words"] <= _SORT_ROWS
        last = tied.orderBy("word").limit(rest) if few else _first_words(tied, rest, _SORT_ROWS)
        found = counts.filter(F.col("n") > cut["n"]).unionByName(last)
    return found.orderBy(F.desc("n"), "word") if ordered else found

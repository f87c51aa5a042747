"""Connected components of a graph given as links, by alternating large-star and small-star steps.

Every step is an aggregate per node and a join back to the links, so a hub with very many links is a skewed join, which
adaptive execution splits because both sides are written tables. Steps are repeated until no link changes; each
round is written to the shared folder, so that lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.session import materialise


def _to_smallest(links: DataFrame, keep_self: bool) -> DataFrame:
    """Links (u, v) of each u moved to the smallest node that u knows, itself included."""
    least = materialise(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = links.join(least, "u")
    if keep_self:  # small star: u and its smaller neighbours hang on the smallest
        moved = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
    larger = joined.filter(F.col("v") > F.col("u"))
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _digest(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that is on a link; ``root`` is the smallest node reachable.

    ``links``: two columns of longs, in any direction, repeated or not; a link of a node with itself says nothing.
    No links give an empty table.
    """
    a, b = links.columns
    larger, smaller = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = materialise(links.select(larger, smaller).filter("u <> v").distinct())
    seen = _digest(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(_to_smallest(both, keep_self=False))
        now = materialise(_to_smallest(large, keep_self=True))
        then, seen = seen, _digest(now)
        if then == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

"""Operator 3: removal of lines that many documents share.

Lines are exploded with their position and a 128-bit hash of their normalised form (white space stripped at both
ends, A-Z lower-cased). One aggregate per hash, combined before the shuffle, gives the smallest and the largest doc_id
that holds it; a hash held by two documents or more is shared. The shared ones are written and joined back, so that a
line that a third of all documents holds is an ordinary skewed join for adaptive execution; what comes out
are the positions to drop, at most one per line.

Defined results: a null or empty text is one empty line; a null doc_id is one document that comes after all others; rows
that repeat a doc_id are the same document; lines below ``min_chars`` code points always stay; of a text of any length
every line is looked at; an empty table gives an empty table. Other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import SPACES, lower_ascii, whole
from pairmine.session import materialise

MIN_CHARS = 10
_LAST = 2**63 - 1


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_documents: int = 2) -> DataFrame:
    """doc_id, kept (the text without its dropped lines), n_lines, n_dropped; a row for each row of ``docs``."""
    rows = docs.select("doc_id", whole("text").alias("text")).withColumns(
        {"owner": F.coalesce("doc_id", F.lit(_LAST)), "mark": F.xxhash64("text")}
    )
    lines = rows.select("owner", "mark", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    key = lower_ascii(F.btrim("line", F.lit(SPACES)))
    hashed = materialise(
        lines.withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("owner", "mark", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    holders = hashed.groupBy("h1", "h2")
    if min_documents == 2:
        shared = holders.agg(F.min("owner").alias("first"), F.max("owner").alias("last"))
        shared = shared.filter(F.col("first") < F.col("last")).select("h1", "h2", "first")
    else:
        each = hashed.select("h1", "h2", "owner").distinct().groupBy("h1", "h2")
        shared = each.agg(F.min("owner").alias("first"), F.count(F.lit(1)).alias("n"))
        shared = shared.filter(F.col("n") >= min_documents).select("h1", "h2", "first")
    dropped = (
        hashed.join(materialise(shared), ["h1", "h2"])
        .filter(F.col("owner") > F.col("first"))
        .groupBy("owner", "mark")
        .agg(F.collect_set("at").alias("gone"))
    )
    split = F.split("text", "\n", -1)
    return (
        rows.join(dropped, ["owner", "mark"], "left")
        .withColumn("lines", split)
        .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        .withColumn("stay", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
        .select(
            "doc_id",
            F.when(F.size("gone") == 0, F.col("text"))
            .otherwise(F.array_join(F.transform("stay", lambda i: F.get("lines", i)), "\n"))
            .alias("kept"),
            F.size("lines").cast("long").alias("n_lines"),
            F.size("gone").cast("long").alias("n_dropped"),
        )
    )

"""Small column helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What counts as white space, and a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one window of a dealt-out order holds on average.
BUCKET_ROWS = 2000


def whole(text: str | Column) -> Column:
    """The text; a null one counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text, in order; an empty array for none."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out(doc_id: str, modulus: int) -> Column:
    """Rows that a model must not learn from: crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == 2, F.lit(False))


def buckets_for(rows: int, each: int = BUCKET_ROWS) -> int:
    return max(1, math.ceil(rows / each))


def unit(bits: Column) -> Column:
    """A 64-bit hash as a number from 0 up to, not including, 1 (53 bits of it)."""
    return F.shiftrightunsigned(bits, 11).cast("double") * F.lit(2.0**-53)


def running_before(counts: DataFrame, bucket: str, amount: str, *within: str) -> DataFrame:
    """Per bucket, what the earlier buckets (of the same ``within``) hold together."""
    window = Window.partitionBy(*within) if within else Window.partitionBy()
    before = window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum(amount).over(before), F.lit(0)).cast("long"))

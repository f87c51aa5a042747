"""Rule-based quality of candidate words.

The word lists (lexicon, names, common words, tags) are tables with one row per word; lexicon and
names are folded into one table first, so that candidates are joined once. The facts are written before they are
joined: Spark broadcasts them while their size allows it, and otherwise both sides of the join are plain
shuffles, which adaptive execution can split at popular words (it cannot if a side comes straight from an aggregate).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.functions import text as tx
from pairmine.schemas import require
from pairmine.session import materialise

# The part of speech and the tags the rules ask for.
NOUN = "n"
COMMON_NOUN_TAG = "NN"
PROPER_NOUN_TAG = "NNP"

RULES = ("lexicon", "common")


def _only(df: DataFrame, word: str, value: str, what: str) -> DataFrame:
    """One row per word; a word listed twice stops the job."""
    duplicate = F.raise_error(F.concat(F.lit(f"{what} lists this word twice: "), F.col(word)))
    return df.groupBy(word).agg(
        F.when(F.count("*") > 1, duplicate).otherwise(F.max(value)).alias(value)
    )


def _attach(df: DataFrame, facts: DataFrame, key: Column) -> DataFrame:
    return df.join(materialise(facts), key == F.col("_word"), "left").drop("_word")


def lexicon_noun(
    df: DataFrame, lexicon: DataFrame, word: str = "word", out: str = "is_noun"
) -> DataFrame:
    """Is the word in the lexicon with a noun as its first sense?

    The lexicon holds surface forms; inflected forms must be listed themselves.
    """
    require(lexicon, "word", "first_pos")
    lowered = lexicon.withColumn("word", F.lower("word"))
    facts = _only(lowered, "word", "first_pos", "the lexicon").select(
        F.col("word").alias("_word"), (F.col("first_pos") == NOUN).alias("_noun")
    )
    key = F.lower(tx.trim_space(F.col(word)))
    return _attach(df, facts, key).withColumn(out, F.coalesce("_noun", F.lit(False))).drop("_noun")


def _flag(df: DataFrame, words: DataFrame, word: str, out: str) -> DataFrame:
    facts = words.select(F.col("word").alias("_word")).distinct().withColumn("_hit", F.lit(True))
    key = F.lower(tx.trim_space(F.col(word)))
    return _attach(df, facts, key).withColumn(out, F.col("_hit").isNotNull()).drop("_hit")


def not_in_gazetteer(
    df: DataFrame, gazetteer: DataFrame, word: str = "word", out: str = "not_a_name"
) -> DataFrame:
    """Is the word absent from the known names? Rows are flagged, none is dropped."""
    lowered = gazetteer.select(F.lower("word").alias("word"))
    return _flag(df, lowered, word, "_known").withColumn(out, ~F.col("_known")).drop("_known")


def in_common_vocab(
    df: DataFrame, common: DataFrame, word: str = "word", out: str = "is_common"
) -> DataFrame:
    """Is the word among the common words?"""
    return _flag(df, common, word, out)


def _tag_ok(word: Column, tag: Column) -> Column:
    capitalised = (F.length(word) > 1) & F.rlike(word, F.lit(r"^\p{Lu}")) & (tag != PROPER_NOUN_TAG)
    return F.coalesce((tag == COMMON_NOUN_TAG) & ~capitalised, F.lit(False))


def tag_rule(df: DataFrame, tags: DataFrame, word: str = "word", out: str = "tag_ok") -> DataFrame:
    """Common noun tag, and not written with a capital unless tagged as a proper noun.

    ``tags`` is keyed by the word as written, since the capital matters.
    """
    require(tags, "word", "tag")
    facts = _only(tags, "word", "tag", "the tag table").withColumnRenamed("word", "_word")
    facts = facts.withColumnRenamed("tag", "_tag")
    written = tx.trim_space(F.col(word))
    return (
        _attach(df, facts, written).withColumn(out, _tag_ok(written, F.col("_tag"))).drop("_tag")
    )


def word_facts(lexicon: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Lexicon and names as one table: ``word, first_pos, is_name``."""
    require(lexicon, "word", "first_pos")
    no_pos, no_name = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    lowered = F.lower("word").alias("word")
    union = lexicon.select(lowered, "first_pos", no_name.alias("is_name")).unionByName(
        gazetteer.select(lowered, no_pos.alias("first_pos"), F.lit(True).alias("is_name"))
    )
    twice = F.raise_error(F.concat(F.lit("the lexicon lists this word twice: "), F.col("word")))
    return union.groupBy("word").agg(
        F.when(F.count("first_pos") > 1, twice).otherwise(F.max("first_pos")).alias("first_pos"),
        F.coalesce(F.bool_or("is_name"), F.lit(False)).alias("is_name"),
    )


def quality_score(
    df: DataFrame,
    rules: str | Callable[[Column], Column] = "lexicon",
    word: str = "word",
    lexicon: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    common: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """Add ``quality`` (1.0 or 0.0) and ``reason`` (first rule that failed, or ``ok``).

    ``lexicon``: format, then noun by lexicon, then not a known name. ``common``: format, then common
    word, then tag rule. A function from Column to Column (a pandas UDF fits) is used as it is;
    1.0 and above counts as good.
    """
    if callable(rules):
        score = F.coalesce(rules(F.col(word)).cast("double"), F.lit(0.0))
        reason = F.when(F.col("quality") >= 1.0, "ok").otherwise("custom rule")
        return df.withColumn("quality", score).withColumn("reason", reason)
    written = tx.trim_space(F.col(word))
    if rules == "lexicon":
        if lexicon is None or gazetteer is None:
            raise ValueError("rules 'lexicon' needs lexicon and gazetteer")
        facts = word_facts(lexicon=lexicon, gazetteer=gazetteer)
        facts = facts.select(F.col("word").alias("_word"), "first_pos", "is_name")
        joined = _attach(df, facts, F.lower(written))
        reason = (
            F.when(~tx.format_ok(F.col(word)), "format")
            .when(~F.coalesce(F.col("first_pos") == NOUN, F.lit(False)), "not noun")
            .when(F.col("is_name"), "known name")
            .otherwise("ok")
        )
        used = ["first_pos", "is_name"]
    elif rules == "common":
        if common is None or tags is None:
            raise ValueError("rules 'common' needs common and tags")
        joined = in_common_vocab(df, common, word, "_common")
        joined = tag_rule(joined, tags, word, "_tag_ok")
        reason = (
            F.when(~tx.format_ok(F.col(word)), "format")
            .when(~F.col("_common"), "not common")
            .when(~F.col("_tag_ok"), "tag")
            .otherwise("ok")
        )
        used = ["_common", "_tag_ok"]
    else:
        raise ValueError(f"unknown rules {rules!r}; expected one of {RULES} or a function")
    scored = joined.withColumn("reason", reason).drop(*used)
    return scored.withColumn("quality", F.when(F.col("reason") == "ok", 1.0).otherwise(0.0))


def quality_reasons(scored: DataFrame) -> DataFrame:
    """How many candidates met which reason."""
    return scored.groupBy("reason").agg(F.count("*").alias("n"))

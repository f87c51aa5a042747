"""From sampled completions to unique candidate words per prompt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.functions import text as tx
from pairmine.schemas import require

MODES = ("train", "eval")


def expand_samples(df: DataFrame, k: int, idx: str = "sample_idx") -> DataFrame:
    """Every prompt ``k`` times with the sample index from 0."""
    if k <= 0:
        raise ValueError("k must be positive")
    return df.withColumn(idx, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def normalise(df: DataFrame, mode: str = "train", text: str = "text", word: str = "word") -> DataFrame:
    """The candidate word of each completion, lower-cased.

    ``train`` drops completions without a word. ``eval`` keeps every row: no token at all gives
    the empty marker, punctuation alone gives ``""``.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    require(df, text)
    if mode == "train":
        return df.withColumn(word, F.lower(tx.last_word(F.col(text)))).filter(F.col(word) != "")
    token = tx.last_token(F.col(text))
    bare = F.btrim(token, F.lit(tx.EDGE_PUNCTUATION))
    return df.withColumn(word, F.when(token == "", F.lit(tx.EMPTY_MARK)).otherwise(F.lower(bare)))


def dedupe_keep_first(
    df: DataFrame, prompt: str | list[str] = "prompt_id", word: str = "word", idx: str = "sample_idx"
) -> DataFrame:
    """Unique words per prompt, each with the index where it first occurs."""
    keys = [prompt] if isinstance(prompt, str) else list(prompt)
    return df.groupBy(*keys, word).agg(F.min(idx).alias(idx))


def candidate_census(
    prompts: DataFrame, completions: DataFrame, prompt: str = "prompt_id", text: str = "text"
) -> DataFrame:
    """Per prompt: samples generated, samples with a word, unique words, and a status."""
    words = completions.select(prompt, F.lower(tx.last_word(F.col(text))).alias("_w"))
    # one row per distinct word first, so that a popular prompt is counted in many tasks
    distinct = words.groupBy(prompt, "_w").agg(F.count("*").alias("_n"))
    counts = distinct.groupBy(F.col(prompt).alias("_p")).agg(
        F.sum("_n").alias("generated"),
        F.sum(F.when(F.col("_w") != "", F.col("_n")).otherwise(0)).alias("non_empty"),
        F.count_if(F.col("_w") != "").alias("unique_words"),
    )
    joined = prompts.select(prompt).join(counts, F.col(prompt) == F.col("_p"), "left").drop("_p")
    filled = joined.fillna(0, ["generated", "non_empty", "unique_words"])
    status = (
        F.when(F.col("generated") == 0, "no completions")
        .when(F.col("unique_words") == 0, "no words")
        .otherwise("ok")
    )
    return filled.withColumn("status", status)

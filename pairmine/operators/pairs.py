"""Choosing one preferred and one rejected candidate per prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.operators.diversity import group_columns
from pairmine.schemas import require
from pairmine.session import materialise

# Fixed value: the score from which a candidate is good.
GOOD_FROM = 1.0

TIES = ("first", "seeded")


def split_quality(df: DataFrame, threshold: float = GOOD_FROM, out: str = "is_good") -> DataFrame:
    """Flag good candidates; a missing score counts as 0."""
    return df.withColumn(out, F.coalesce(F.col("quality"), F.lit(0.0)) >= threshold)


def _tie_order(tie: str, keys: list[str], idx: str, word: str, seed: int) -> list[Column]:
    if tie == "first":
        return [F.col(idx)]
    if tie == "seeded":
        return [F.xxhash64(F.lit(seed), *keys, word), F.col(idx)]
    raise ValueError(f"tie must be one of {TIES}, got {tie!r}")


def _picks(keys: list[str], idx: str, word: str, tie: str, seed: int, threshold: float):
    good = F.coalesce(F.col("quality"), F.lit(0.0)) >= threshold
    order = _tie_order(tie, keys, idx, word, seed)
    diversity = F.coalesce(F.col("diversity"), F.lit(0.0))  # a missing one wins over none
    value = F.struct(F.col(word).alias("word"), F.col(idx).alias("idx"), diversity.alias("diversity"))
    chosen = F.min_by(value, F.when(good, F.struct(-diversity, *order)))
    rejected = F.min_by(value, F.when(~good, F.struct(diversity, *order)))
    return chosen, rejected


def _unpack(df: DataFrame, keys: list[str], *sides: str) -> DataFrame:
    columns = []
    for side in sides:
        pick = F.col("_" + side)
        columns += [
            pick["word"].alias(side),
            pick["idx"].alias(f"{side}_idx"),
            pick["diversity"].alias(f"{side}_diversity"),
        ]
    return df.select(*keys, *columns)


def pick_chosen(
    df: DataFrame,
    group: str | list[str] = "prompt_id",
    idx: str = "sample_idx",
    word: str = "word",
    tie: str = "first",
    seed: int = 0,
    threshold: float = GOOD_FROM,
) -> DataFrame:
    """The most diverse good candidate of each prompt that has one.

    Ties: ``first`` takes the smallest index, ``seeded`` the smallest hash of seed, prompt and word;
    both are the same however the rows are spread.
    """
    keys = group_columns(group)
    require(df, *keys, idx, word, "quality", "diversity")
    chosen, _ = _picks(keys, idx, word, tie, seed, threshold)
    picked = df.groupBy(*keys).agg(chosen.alias("_chosen")).filter(F.col("_chosen").isNotNull())
    return _unpack(picked, keys, "chosen")


def pick_rejected(
    df: DataFrame,
    group: str | list[str] = "prompt_id",
    idx: str = "sample_idx",
    word: str = "word",
    tie: str = "first",
    seed: int = 0,
    threshold: float = GOOD_FROM,
) -> DataFrame:
    """The least diverse bad candidate of each prompt that has one (ties as in ``pick_chosen``)."""
    keys = group_columns(group)
    require(df, *keys, idx, word, "quality", "diversity")
    _, rejected = _picks(keys, idx, word, tie, seed, threshold)
    picked = df.groupBy(*keys).agg(rejected.alias("_rejected")).filter(F.col("_rejected").isNotNull())
    return _unpack(picked, keys, "rejected")


def mine_pairs(
    df: DataFrame,
    group: str | list[str] = "prompt_id",
    idx: str = "sample_idx",
    word: str = "word",
    tie: str = "first",
    seed: int = 0,
    threshold: float = GOOD_FROM,
) -> DataFrame:
    """One pair per prompt that has both a good and a bad candidate.

    Both picks are aggregates of one grouping, combined before the shuffle, so a prompt with very
    many candidates sends only its best ones.
    """
    keys = group_columns(group)
    require(df, *keys, idx, word, "quality", "diversity")
    chosen, rejected = _picks(keys, idx, word, tie, seed, threshold)
    picked = df.groupBy(*keys).agg(chosen.alias("_chosen"), rejected.alias("_rejected"))
    both = picked.filter(F.col("_chosen").isNotNull() & F.col("_rejected").isNotNull())
    return _unpack(both, keys, "chosen", "rejected")


def max_target_filter(
    pairs: DataFrame,
    longest: int,
    chosen_tokens: Column,
    rejected_tokens: Column,
) -> DataFrame:
    """Keep pairs whose sides both have at most ``longest`` tokens.

    The token counts are columns from the user's tokenizer; a missing count stops the job, since
    neither keeping nor dropping the pair would be right.
    """
    missing = F.raise_error(F.lit("a picked word has no token count")).cast("boolean")
    counted = chosen_tokens.isNotNull() & rejected_tokens.isNotNull()
    return pairs.filter(F.when(counted, (chosen_tokens <= longest) & (rejected_tokens <= longest)).otherwise(missing))


def pair_audit(
    df: DataFrame, group: str | list[str] = "prompt_id", threshold: float = GOOD_FROM
) -> DataFrame:
    """For each prompt with candidates but no pair: what was missing, and how many there were."""
    keys = group_columns(group)
    good = F.coalesce(F.col("quality"), F.lit(0.0)) >= threshold
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("candidates"), F.count_if(good).alias("n_good")
    )
    no_pair = counts.filter((F.col("n_good") == 0) | (F.col("n_good") == F.col("candidates")))
    reason = F.when(F.col("n_good") == 0, "no good").otherwise("no bad")
    return no_pair.select(
        *keys, "candidates", "n_good", (F.col("candidates") - F.col("n_good")).alias("n_bad"), reason.alias("no_pair_reason")
    )


def audit_lines(
    df: DataFrame,
    group: str | list[str] = "prompt_id",
    word: str = "word",
    threshold: float = GOOD_FROM,
) -> DataFrame:
    """The candidates behind :func:`pair_audit`, one row each, with ``word(quality)`` and
    ``word(diversity)`` written out.

    Rows instead of a list per prompt, so that a prompt with very many candidates stays spread.
    The scored candidates are written first, since they are counted and then listed.
    """
    keys = group_columns(group)
    df = materialise(df)
    audit = pair_audit(df, keys, threshold)
    renamed = audit.select(*[F.col(k).alias("_a_" + k) for k in keys], "candidates", "no_pair_reason")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col("_a_" + k))
    lines = df.join(renamed, condition).drop(*["_a_" + k for k in keys])
    diversity = F.when(
        F.col("candidates") > 1, F.format_string("%s(%.3f)", F.col(word), F.round("diversity", 3))
    ).otherwise("N/A")
    return lines.withColumn(
        "quality_text",
        F.format_string("%s(%.1f)", F.col(word), F.coalesce(F.col("quality"), F.lit(0.0))),
    ).withColumn("diversity_text", diversity)

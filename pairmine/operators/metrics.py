"""Preference loss, rewards and metrics per batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairmine.functions import preference as pf
from pairmine.schemas import require
from pairmine.settings import DEFAULTS

LOGPS = ("policy_chosen", "policy_rejected", "ref_chosen", "ref_rejected")

# The names of the metrics, in report order.
METRICS = (
    "loss",
    "rewards_chosen",
    "rewards_rejected",
    "rewards_accuracy",
    "rewards_margins",
    "logps_rejected",
    "logps_chosen",
    "logits",
    "valid_pairs_frac",
)


def sequence_logps(
    df: DataFrame, sequence: str | list[str], logp: str = "logp", mask: str = "mask"
) -> DataFrame:
    """Long form of ``sequence_logp``: one row per token in, one sum per sequence out."""
    keys = [sequence] if isinstance(sequence, str) else list(sequence)
    kept = F.when(F.col(mask).cast("int") != 0, F.col(logp)).otherwise(0.0)
    return df.groupBy(*keys).agg(F.sum(kept).alias("sequence_logp"))


def complete_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs with all four log-probabilities; the others are not valid pairs."""
    return pairs.dropna(subset=list(LOGPS))


def pair_terms(
    pairs: DataFrame, loss: str = "sigmoid", beta: float = DEFAULTS.beta
) -> DataFrame:
    """Add logits, loss, both rewards, the margin and whether the pair is ranked right."""
    require(pairs, *LOGPS)
    logits = pf.dpo_logits(*[F.col(c) for c in LOGPS])
    terms = pairs.withColumns(
        {
            "logits": logits,
            "reward_chosen": pf.reward(F.col("policy_chosen"), F.col("ref_chosen"), beta),
            "reward_rejected": pf.reward(F.col("policy_rejected"), F.col("ref_rejected"), beta),
        }
    )
    return terms.withColumns(
        {
            "loss": pf.dpo_loss(F.col("logits"), loss, beta),
            "margin": F.col("reward_chosen") - F.col("reward_rejected"),
            "accurate": F.col("reward_chosen") > F.col("reward_rejected"),
        }
    )


def _means() -> list[Column]:
    sources = {
        "loss": F.col("loss"),
        "rewards_chosen": F.col("reward_chosen"),
        "rewards_rejected": F.col("reward_rejected"),
        "rewards_accuracy": F.col("accurate").cast("double"),
        "rewards_margins": F.col("margin"),
        "logps_rejected": F.col("policy_rejected"),
        "logps_chosen": F.col("policy_chosen"),
        "logits": F.col("logits"),
    }
    return [F.avg(source).alias(name) for name, source in sources.items()]


def batch_metrics(
    pairs: DataFrame,
    batches: DataFrame,
    batch: str = "batch_id",
    batch_size: str = "batch_size",
    loss: str = "sigmoid",
    beta: float = DEFAULTS.beta,
) -> DataFrame:
    """The nine metrics of every batch in ``batches``; all 0.0 where a batch has no valid pair.

    Pairs are averaged per batch before the join, so the join sees one row per batch on both sides.
    """
    require(batches, batch, batch_size)
    terms = pair_terms(complete_pairs(pairs), loss, beta)
    per_batch = terms.groupBy(F.col(batch).alias("_batch")).agg(*_means(), F.count("*").alias("_pairs"))
    joined = batches.join(per_batch, F.col(batch) == F.col("_batch"), "left")
    fraction = F.col("_pairs") / F.col(batch_size)
    filled = [
        F.coalesce(fraction if m == "valid_pairs_frac" else F.col(m), F.lit(0.0)).alias(m)
        for m in METRICS
    ]
    return joined.select(batch, *filled)


def group_metrics(
    prompts: DataFrame,
    group: Column | list[Column],
    loss: str = "sigmoid",
    beta: float = DEFAULTS.beta,
) -> DataFrame:
    """The nine metrics per group of a table that holds every prompt of the batch.

    A prompt without a valid pair has a missing log-probability; it only lowers
    ``valid_pairs_frac``. One grouping and no join, so it also runs on a stream.
    """
    groups = [group] if isinstance(group, Column) else list(group)
    complete = F.lit(True)
    for name in LOGPS:
        complete = complete & F.col(name).isNotNull()
    terms = pair_terms(prompts, loss, beta).withColumn("_valid", complete)
    for name in ("loss", "reward_chosen", "reward_rejected", "accurate", "margin", "logits",
                 "policy_chosen", "policy_rejected"):
        terms = terms.withColumn(name, F.when(F.col("_valid"), F.col(name)))
    fraction = F.avg(F.col("_valid").cast("double")).alias("valid_pairs_frac")
    return terms.groupBy(*groups).agg(*_means(), fraction).fillna(0.0, list(METRICS))


def mean_of_batches(per_batch: DataFrame, group: Column) -> DataFrame:
    """The nine metrics per group as means over batches: every batch has the same weight, whatever its number of pairs."""
    return per_batch.groupBy(group).agg(*[F.avg(name).alias(name) for name in METRICS])


def step_window_metrics(
    prompts: DataFrame,
    step: str = "step",
    every: int = DEFAULTS.logging_steps,
    loss: str = "sigmoid",
    beta: float = DEFAULTS.beta,
    batch: str | None = None,
) -> DataFrame:
    """The nine metrics over tumbling windows of ``every`` steps, named by their first step.

    Each is the mean of the values of the steps' batches, with the zeros of a batch without a valid pair, whatever the
    number of pairs in a batch. Without ``batch`` a step is one batch.
    """
    groups = [F.col(step).alias("_step")] + ([F.col(batch).alias("_batch")] if batch else [])
    per_batch = group_metrics(prompts, groups, loss, beta)
    return mean_of_batches(per_batch, (F.floor(F.col("_step") / every) * every).alias("first_step"))


def sample_pairs_log(
    pairs: DataFrame,
    order: list[str],
    step: str = "step",
    logging_steps: int = DEFAULTS.logging_steps,
    first: int = 3,
    loss: str = "sigmoid",
    beta: float = DEFAULTS.beta,
) -> DataFrame:
    """The first pairs of every fifth logged step, with the step's accuracy and margin.

    ``step`` counts optimiser steps, as numbered by ``align_to_batch``.

    The row-number filter is applied to each partition before the shuffle, so a step with very
    many pairs sends only its first ones.
    """
    require(pairs, step, *order)
    logged = complete_pairs(pairs).filter(F.col(step) % (5 * logging_steps) == 0)
    terms = pair_terms(logged, loss, beta)
    of_step = terms.groupBy(F.col(step).alias("_step")).agg(
        F.avg(F.col("accurate").cast("double")).alias("accuracy"), F.avg("margin").alias("margin")
    )
    within = Window.partitionBy(step).orderBy(*order)
    ranked = logged.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= first)
    return ranked.join(of_step, F.col(step) == F.col("_step")).drop("_step")

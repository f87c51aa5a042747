"""Metrics of training steps from prompts, pairs and log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.operators import metrics as mt
from pairmine.schemas import require
from pairmine.settings import DEFAULTS


def step_metrics(
    prompts: DataFrame,
    pairs: DataFrame,
    logps: DataFrame,
    batch: str = "batch_id",
    prompt: str = "prompt_id",
    loss: str = "sigmoid",
    beta: float = DEFAULTS.beta,
) -> DataFrame:
    """The nine metrics of every batch of ``prompts`` (one row per prompt, with its batch).

    A prompt counts as valid if it has a pair and all four log-probabilities; a batch without any
    valid prompt has zeros.
    """
    require(prompts, batch, prompt)
    require(logps, prompt, *mt.LOGPS)
    known = pairs.select(prompt).join(logps.select(prompt, *mt.LOGPS), prompt)
    joined = prompts.select(batch, prompt).join(known, prompt, "left")
    return mt.group_metrics(joined, F.col(batch), loss, beta)

"""Preference metrics over tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.operators.metrics import METRICS, group_metrics, mean_of_batches
from pairmine.settings import DEFAULTS


def stream_step_metrics(
    prompts: DataFrame,
    window: str = "1 hour",
    delay: str | None = "10 minutes",
    ts: str = "ts",
    loss: str = "sigmoid",
    beta: float = DEFAULTS.beta,
    batch: str | None = None,
) -> DataFrame:
    """The nine metrics per window of a table or stream of prompts.

    With ``batch`` they are means over the batches of the window, each with the same weight and with zeros if it has no valid
    pair, as values logged per batch would be. On a stream these are two aggregates in a row: the state holds one row per open
    window and batch, and one per open window; the watermark that closes the batches' windows closes the means. A batch whose
    prompts lie in two windows is a batch of each. Without ``batch`` all prompts of a window count alike.

    The same plan for both; ``delay=None`` leaves the watermark out for a batch table.
    """
    timed = prompts if delay is None else prompts.withWatermark(ts, delay)
    own = F.window(ts, window).alias("_window")
    if batch is None:
        metrics = group_metrics(timed, own, loss, beta)
    else:
        per_batch = group_metrics(timed, [own, F.col(batch).alias("_batch")], loss, beta)
        metrics = mean_of_batches(per_batch, F.window("_window", window).alias("_window"))
    return metrics.select(F.col("_window.start").alias("window_start"), *METRICS)

"""Pairs from completions that arrive continuously."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairmine.operators import candidates as cd
from pairmine.operators import pairs as pr
from pairmine.session import materialise, remove_folder, temporary_tables
from pairmine.streaming.ends import late_rows, mark_end, with_end_marks

GROUP = ["window_start", "prompt_id"]
COLUMNS = ["prompt_id", "sample_idx", "text"]


def closed_candidates(
    completions: DataFrame, window: str, delay: str | None, ts: str = "ts"
) -> DataFrame:
    """Unique words per window and prompt; on a stream a window comes out once it is closed.

    State is one small row per window, prompt and word, spread by all three, instead of a list per
    prompt. All words of a window close together, so each micro-batch holds whole groups.
    ``delay=None`` is the batch form.
    """
    timed = completions if delay is None else completions.withWatermark(ts, delay)
    words = cd.normalise(timed, "train")
    unique = words.groupBy(F.window(ts, window).alias("_window"), "prompt_id", "word").agg(
        F.min("sample_idx").alias("sample_idx")
    )
    return unique.select(
        F.col("_window.start").alias("window_start"), "prompt_id", "word", "sample_idx"
    )


def stream_pairs(
    completions: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    window: str = "1 hour",
    delay: str = "10 minutes",
    ts: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start the stream: closed groups are scored, mined and written under ``path/pairs``.

    ``score`` turns the closed candidates (grouped by ``GROUP``) into scored ones. Each micro-batch
    overwrites its own ``epoch_id`` folder of pairs, so a repeated one leaves each pair once. Samples later
    than the watermark are dropped. The next run after :func:`end_input` closes all windows.
    """
    own = with_end_marks(completions.select(ts, *COLUMNS), f"{path}/end")
    closed = closed_candidates(own, window, delay, ts)

    def write(batch: DataFrame, epoch_id: int) -> None:
        write_epoch(batch, epoch_id, score, path)

    writer = closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()


def end_input(completions: DataFrame, path: str, ts: str = "ts") -> None:
    """Tell the stream that writes to ``path`` that its input is complete."""
    # The mark needs a word: a row without one is taken out before the watermark sees it.
    schema = completions.select(ts, *COLUMNS).schema
    mark_end(completions.sparkSession, schema, f"{path}/end", ts, text="end")


def stream_pairs_to_end(
    completions: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    window: str = "1 hour",
    delay: str = "10 minutes",
    ts: str = "ts",
) -> None:
    """Run the stream over all input there is, then close it: every window is mined, and the input read once.

    ``path/late`` says how many rows came too late: samples with a word, those alike in window, prompt and word counting
    once for each task that read them.
    """
    spark, late = completions.sparkSession, 0
    for last in (False, True):
        if last:
            end_input(completions, path, ts)
        query = stream_pairs(completions, score, path, checkpoint, window, delay, ts)
        query.awaitTermination()
        late += late_rows(query)
    spark.createDataFrame([(late,)], "late_rows bigint").write.mode("append").parquet(f"{path}/late")


def write_epoch(
    batch: DataFrame, epoch_id: int, score: Callable[[DataFrame], DataFrame], path: str
) -> None:
    """Mine one micro-batch into its own folder, replacing what an earlier attempt left there."""
    spark, folder = batch.sparkSession, f"{path}/candidates/epoch_id={epoch_id}"
    with temporary_tables(spark):
        # Written once: scoring passes over the closed groups more than one time.
        mined = pr.mine_pairs(score(materialise(batch, folder)), GROUP)
        mined.write.mode("overwrite").parquet(f"{path}/pairs/epoch_id={epoch_id}")
    remove_folder(spark, folder)

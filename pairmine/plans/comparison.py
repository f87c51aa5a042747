"""Raw outputs of several runs to one report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.functions.text import strip_prompt_echo
from pairmine.operators import evaluation as ev
from pairmine.operators.candidates import normalise
from pairmine.schemas import require


def output_words(outputs: DataFrame) -> DataFrame:
    """The word of each raw output: ``run, sample_idx, prompt, text`` in, echo of the prompt removed."""
    require(outputs, "run", "sample_idx", "prompt", "text")
    answers = outputs.withColumn("text", strip_prompt_echo(F.col("text"), F.col("prompt")))
    return normalise(answers, "eval").select("run", "sample_idx", "word")


def report_on_outputs(
    outputs: DataFrame,
    embeddings: DataFrame | Callable[[DataFrame], DataFrame],
    baseline: str,
    **options,
) -> DataFrame:
    """Vocabulary and semantic spread of every run, with the differences to the baseline run."""
    return ev.run_report(output_words(outputs), embeddings, baseline, **options)

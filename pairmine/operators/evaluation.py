"""Vocabulary and semantic spread of runs, and their comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.functions.text import EMPTY_MARK
from pairmine.operators.diversity import (
    attach_embeddings,
    average_of_sums,
    group_columns,
    group_spread,
    similarity_profile,
    unit_sums,
)
from pairmine.session import materialise

MODES = ("avg", "max")


def run_words(runs: DataFrame, run: str = "run", word: str = "word") -> DataFrame:
    """The unique words of each run with their counts, without the empty marker."""
    counts = runs.groupBy(run, word).agg(F.count("*").alias("n"))
    return counts.filter(F.col(word) != EMPTY_MARK)


def vocabulary_summary(runs: DataFrame, run: str = "run", word: str = "word") -> DataFrame:
    """Per run: all words generated (markers included) and unique words.

    Counted from one row per run and word, so that a large run is counted in many tasks. The sorted
    list of words is :func:`vocabulary_list`.
    """
    return _summary(runs.groupBy(run, word).agg(F.count("*").alias("n")), run, word)


def _summary(counts: DataFrame, run: str, word: str) -> DataFrame:
    return counts.groupBy(run).agg(
        F.sum("n").alias("total_words"),
        F.count_if(F.col(word) != EMPTY_MARK).alias("unique_words"),
    )


def vocabulary_list(runs: DataFrame, run: str = "run", word: str = "word") -> DataFrame:
    """The unique words of each run in order, one row each."""
    return run_words(runs, run, word).orderBy(run, word)


def avg_pairwise_similarity(
    df: DataFrame, group: str | list[str] = "run", vector: str = "embedding"
) -> DataFrame:
    """Mean cosine over all ordered pairs of different rows of a group; 0.0 below two rows.

    Linear in the rows: (‖Σu‖² − Σ‖u‖²) / (n(n − 1)) over unit vectors u. A group of any size sends one row per
    batch of input rows.
    """
    keys = group_columns(group)
    sums = unit_sums(df.filter(F.col(vector).isNotNull()), keys, vector)
    average = average_of_sums(F.col("_n"), F.col("_whole"), F.col("_own"))
    return sums.select(*keys, F.col("_n").alias("n"), average.alias("avg_similarity"))


def _with_missing(figures: DataFrame, df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Every group of ``df``, with ``missing_vectors``: its rows that have no vector and take no part."""
    counts = df.groupBy(*[F.col(k).alias("_m_" + k) for k in keys]).agg(F.count_if(F.col(vector).isNull()).alias("missing_vectors"))
    own = F.lit(True)
    for k in keys:
        own = own & F.col("_m_" + k).eqNullSafe(F.col(k))
    rest = [c for c in figures.columns if c not in keys]
    return counts.join(figures, own, "left").select(*[F.col("_m_" + k).alias(k) for k in keys], *rest, "missing_vectors")


def min_positive_similarity(
    df: DataFrame,
    group: str | list[str] = "run",
    id: str = "word",
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """The smallest similarity above 0 in each group, NULL where there is none, and ``missing_vectors``."""
    keys = group_columns(group)
    present = df.filter(F.col(vector).isNotNull())
    profile = similarity_profile(present, keys, id, vector, **options)
    lowest = profile.groupBy(*keys).agg(F.min("min_positive_sim").alias("min_positive_similarity"))
    return _with_missing(lowest, df, keys, vector)


def diversity_score(
    df: DataFrame,
    group: str | list[str] = "run",
    id: str = "word",
    vector: str = "embedding",
    mode: str = "avg",
    **options,
) -> DataFrame:
    """1 − average similarity (``avg``) or 1 − highest similarity (``max``), NULL below two rows, and ``missing_vectors``."""
    keys = group_columns(group)
    if mode == "avg":
        average = avg_pairwise_similarity(df, keys, vector)
        score = average.select(
            *keys, F.when(F.col("n") >= 2, 1 - F.col("avg_similarity")).alias("diversity_score")
        )
    elif mode == "max":
        present = df.filter(F.col(vector).isNotNull())
        profile = similarity_profile(present, keys, id, vector, lowest=False, **options)
        score = profile.groupBy(*keys).agg((1 - F.max("max_sim")).alias("diversity_score"))
    else:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    return _with_missing(score, df, keys, vector)


def vocabulary_compare(
    runs: DataFrame, a: str, b: str, run: str = "run", word: str = "word"
) -> DataFrame:
    """Each word of two runs with the side it is on: ``only_a``, ``only_b`` or ``both``."""
    words = runs.filter(F.col(run).isin(a, b) & (F.col(word) != EMPTY_MARK))
    seen = words.groupBy(word).agg(
        F.bool_or(F.col(run) == a).alias("_a"), F.bool_or(F.col(run) == b).alias("_b")
    )
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "only_a").otherwise("only_b")
    return seen.select(word, side.alias("side"))


def run_report(
    runs: DataFrame,
    embeddings: DataFrame | Callable[[DataFrame], DataFrame],
    baseline: str,
    run: str = "run",
    word: str = "word",
    key: str = "word",
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """All figures of every run beside each other, with the differences to the baseline run.

    A higher minimum similarity means that the two words farthest apart moved closer together. Words without a vector
    take no part in the similarities; ``missing_vectors`` counts them.
    ``runs`` is read once: all figures come from the count per run and word, which is written first.
    """
    counts = materialise(runs.groupBy(run, word).agg(F.count("*").alias("n")))
    summary = _summary(counts, run, word)
    words = counts.filter(F.col(word) != EMPTY_MARK).select(run, F.col(word).alias(key))
    vectors = attach_embeddings(words, embeddings, key, vector).filter(F.col(vector).isNotNull())
    spread = group_spread(vectors, run, key, vector, group_sizes=words, **options).select(
        run, "n", "avg_similarity", F.col("min_positive_sim").alias("min_positive_similarity"), (1 - F.col("max_sim")).alias("diversity_max")
    )
    report = (
        summary.join(spread, run, "left")
        .withColumn("missing_vectors", F.col("unique_words") - F.coalesce("n", F.lit(0)))
        .drop("n")
        .withColumn("avg_similarity", F.coalesce("avg_similarity", F.lit(0.0)))
        .withColumn("diversity_avg", F.when(F.col("unique_words") > 1, 1 - F.col("avg_similarity")))
    )
    figures = [
        "total_words",
        "unique_words",
        "avg_similarity",
        "min_positive_similarity",
        "diversity_avg",
        "diversity_max",
    ]
    # One row per run, written so that the baseline's figures are read and not computed again.
    report = materialise(report)
    base = report.filter(F.col(run) == baseline).first()
    if base is None:
        raise ValueError(f"no run named {baseline!r}")
    kinds = dict(report.dtypes)
    deltas = [
        (F.col(f) - F.lit(base[f]).cast(kinds[f])).alias(f + "_delta") for f in figures
    ]
    return report.select(run, F.lit(baseline).alias("baseline"), *figures, "missing_vectors", *deltas)

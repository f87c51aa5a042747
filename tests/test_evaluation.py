from __future__ import annotations

import numpy as np
import pytest

from pairmine.functions.text import EMPTY_MARK
from pairmine.operators import evaluation as ev
from pairmine.schemas import RUNS

VECTORS = "run string, word string, embedding array<double>"


def runs(spark):
    rows = [("a", w) for w in ("echo", "echo", "tree", EMPTY_MARK, "")] + [("b", w) for w in ("tree", "sea", "sea")]
    return spark.createDataFrame([(r, i, w) for i, (r, w) in enumerate(rows)], RUNS)


def test_vocabulary_summary(spark):
    got = {r.run: (r.total_words, r.unique_words) for r in ev.vocabulary_summary(runs(spark)).collect()}
    assert got == {"a": (5, 3), "b": (3, 2)}


def test_vocabulary_list(spark):
    got = [tuple(r) for r in ev.vocabulary_list(runs(spark)).collect()]
    assert got == [("a", "", 1), ("a", "echo", 2), ("a", "tree", 1), ("b", "sea", 2), ("b", "tree", 1)]


def test_vocabulary_compare(spark):
    got = {r.word: r.side for r in ev.vocabulary_compare(runs(spark), "a", "b").collect()}
    assert got == {"": "only_a", "echo": "only_a", "tree": "both", "sea": "only_b"}


def vectors(spark, **groups):
    return spark.createDataFrame(
        [(g, f"w{i}", [float(x) for x in v]) for g, rows in groups.items() for i, v in enumerate(rows)], VECTORS
    )


def test_average_equals_the_mean_over_all_pairs(spark):
    rng = np.random.default_rng(0)
    groups = {"p": rng.normal(size=(30, 5)), "q": rng.normal(size=(2, 5)), "zero": np.vstack([np.zeros(5), rng.normal(size=(3, 5))])}
    got = {r.run: r.avg_similarity for r in ev.avg_pairwise_similarity(vectors(spark, **groups)).collect()}
    for name, m in groups.items():
        u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        s = u @ u.T
        n = len(m)
        assert got[name] == pytest.approx((s.sum() - np.trace(s)) / (n * (n - 1)), abs=1e-12)


def test_below_two_rows(spark):
    one = vectors(spark, one=[[1, 0]])
    assert [r.avg_similarity for r in ev.avg_pairwise_similarity(one).collect()] == [0.0]
    for mode in ev.MODES:
        assert [r.diversity_score for r in ev.diversity_score(one, mode=mode).collect()] == [None]
    with pytest.raises(ValueError):
        ev.diversity_score(one, mode="sum")


def test_min_positive_similarity(spark):
    df = vectors(spark, none=[[1, 0], [0, 1], [-1, 0]], some=[[1, 0], [1, 1], [-1, 0]])
    got = {r.run: r.min_positive_similarity for r in ev.min_positive_similarity(df).collect()}
    assert got["none"] is None
    assert got["some"] == pytest.approx(2**-0.5)


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_max_mode_over_blocks(spark, block_rows):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(25, 4))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    (row,) = ev.diversity_score(vectors(spark, g=m), mode="max", block_rows=block_rows).collect()
    assert row.diversity_score == pytest.approx(1 - s.max())


def test_run_report(spark):
    words = spark.createDataFrame(
        [("echo", [1.0, 0.0]), ("tree", [1.0, 1.0]), ("sea", [0.0, 1.0]), ("", [-1.0, 0.0])],
        "word string, embedding array<double>",
    )
    got = {r.run: r for r in ev.run_report(runs(spark), words, "a").collect()}
    root = 2**-0.5
    assert got["a"].avg_similarity == pytest.approx((root - 1 - root) / 3)
    assert got["b"].avg_similarity == pytest.approx(root)
    assert got["b"].avg_similarity_delta == pytest.approx(root + 1 / 3)
    assert got["a"].missing_vectors == got["b"].missing_vectors == 0
    fewer = {r.run: r for r in ev.run_report(runs(spark), words.filter("word <> 'sea'"), "a").collect()}
    assert fewer["a"].missing_vectors + fewer["b"].missing_vectors > 0
    assert got["a"].unique_words_delta == 0 and got["b"].unique_words_delta == -1
    assert got["b"].diversity_max == pytest.approx(1 - root)

"""Operator 13: numbers of the table against a plain decomposition, difficult spectra, and rows out of the ordinary."""

from __future__ import annotations

import numpy as np
import pytest

from pairmine.llm import queries, whitening
from pairmine.llm.spectrum import Spectrum

FOLDER = "/root/testdata/sf0.01"


def check_spectrum(matrix, count):
    spectrum = Spectrum(matrix)
    values, vectors = spectrum.leading(count, 1e-12 * np.trace(matrix))
    want = np.sort(np.linalg.eigvalsh(matrix))[::-1]
    assert len(values) == min(count, (want > 1e-12 * np.trace(matrix)).sum())
    size = max(abs(want).max(), 1e-300)
    assert np.abs(values - want[: len(values)]).max(initial=0) <= 1e-13 * len(matrix) * size
    assert np.abs(matrix @ vectors.T - vectors.T * values).max(initial=0) <= 1e-13 * len(matrix) * size
    assert np.abs(vectors @ vectors.T - np.eye(len(values))).max(initial=0) <= 1e-10
    return values, vectors


def test_spectra():
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.standard_normal((48, 48)))[0]
    near = np.array([5.0] * 8 + [5 - 1e-9] * 3 + [5 - 1e-13] * 2 + [1] * 15 + [1e-3] * 12 + [0] * 8)
    graded = 10.0 ** -np.arange(0, 12, 0.25)
    for values in (near, graded, np.full(48, 3.0), 1 + np.arange(48.0), rng.random(48) * 1e20):
        matrix = (turn * values) @ turn.T
        check_spectrum((matrix + matrix.T) / 2, 32)
        check_spectrum(np.diag(values), 32)
    wilkinson = np.diag(np.abs(np.arange(21) - 10.0) + 2) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    check_spectrum(wilkinson, 21)
    check_spectrum(np.array([[2.0]]), 32)
    for zero in (np.zeros((4, 4)), np.zeros((1, 1))):
        assert len(Spectrum(zero).leading(3, 0.0)[0]) == 0


def test_counts_are_of_the_matrix():
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((30, 30))
    matrix = matrix + matrix.T
    shifts = np.linspace(-20, 20, 101)
    want = (np.linalg.eigvalsh(matrix)[:, None] < shifts).sum(axis=0)
    assert Spectrum(matrix).below(shifts).tolist() == want.tolist()


def plain(vectors):
    """n, deviation per vector, whitened up to sign, explained: by a full decomposition of exact sums."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = n * x - sums
    covariance = (centred / n).T @ (centred / n) / n
    values, turn = np.linalg.eigh(covariance)
    order = np.argsort(-values)[: whitening.COMPONENTS]
    values, turn = values[order], turn[:, order]
    return n, [sum(int(z) ** 2 for z in row) for row in centred], centred / n @ turn / np.sqrt(values), values / np.trace(covariance)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_whole_table(spark, folder):
    table = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    n, deviation, whitened, explained = plain(list(table.values()))
    place = {i: k for k, i in enumerate(table)}
    got = queries.op13_whitened_embeddings(spark, folder).toPandas()
    assert len(got) == 32 * len(table) and set(got.n) == {n} and got.identity_error.nunique() == 1
    assert got.identity_error[0] < 1e-9
    at, k = got.vec_id.map(place).to_numpy(), got.component.to_numpy() - 1
    assert (got.deviation.to_numpy() == np.array(deviation)[at]).all()
    assert np.allclose(got.explained, explained[k], rtol=1e-12)
    mine = np.zeros((len(table), 32))
    mine[at, k] = got.whitened
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * signs - whitened).max() < 1e-8


def test_offsets_do_not_cost_digits(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.standard_normal((300, 5)) * [4, 2, 1, 0.5, 0.25] * 64) / 64 + [1e6, -1e6, 0, 1e5, 3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    covariance = np.cov((vectors - vectors.mean(axis=0)).T * 64, bias=True)
    assert np.allclose(model.variances, np.linalg.eigvalsh(covariance)[::-1], rtol=1e-9)
    assert whitening.identity_error(df, model) < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (2, [3.0, 1.0], "b"), (2, [3.0, 1.0], "b"), (None, [0.0, 5.0], "c"), (3, None, "d"), (4, [], "d")]
    rows += [(5, [1.0, nan], "d"), (6, [inf, 1.0], "d"), (7, [None, 1.0], "d"), (8, [1.0], "d"), (9, [1.0, 2.0, 3.0], "d")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string")
    model = whitening.fit(df)
    assert (model.n, model.size) == (4, 2)
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "n", "deviation", "whitened"]
    want = plain([r[1] for r in rows[:4]])
    assert sorted(r.deviation for r in got.collect()) == sorted(want[1]) and whitening.identity_error(df, model) < 1e-12
    with pytest.raises(ValueError, match="whitened"):
        whitening.whiten(df.withColumnRenamed("n", "whitened"), model)
    for few in (df.limit(0), df.filter("vec_id = 2"), df.filter("vec_id = 3")):  # empty, copies of one vector, none usable
        model = whitening.fit(few)
        assert len(model.variances) == 0 and whitening.identity_error(few, model) is None
        assert whitening.whiten(few, model).count() == 0


def test_entries_out_of_range(spark):
    rows = [(1, [3.0e38, 1.0]), (2, [-3.0e38, 2.0]), (3, [0.0, 3.0]), (4, [4.0, 4.0]), (5, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    got = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    assert got[1].deviation is None and got[3].deviation == sum((5 * z - s) ** 2 for z, s in zip((0, 192), model.sums, strict=True))
    assert len(got) == 5 and all(np.isfinite(r.whitened).all() for r in got.values())

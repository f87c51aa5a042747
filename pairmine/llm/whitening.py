"""Operator 13: whitening of vectors by the leading components of their covariance, found by spectrum slicing.

Every entry c counts as the whole number floor(64 * c) + 1,000,000. One pass adds up the entries per dimension, in whole numbers;
one adds up products of entries less their rounded mean, which are small whole numbers, so that the covariance
comes out exact as long as the sums stay below 2**53. The matrix of the vectors' dimension goes to the driver, where
``spectrum`` isolates, refines and certifies its leading eigenvalues. A last pass over the table writes each vector's
projections; one in front of it adds up the covariance of these projections, to say how far from the identity it is.

Sums leave each task once, as one row per dimension, and rows of a dimension meet in one task that holds their
running sum only. No vector is shuffled and no sum grows with the table: what reaches the driver is the square of the dimension, and what reaches the
tasks the dimension times the number of components.

Defined results: vectors that are null or empty, or hold null or non-finite entries, are left out; so are vectors whose length is not the one
that most vectors have (of equally frequent lengths the longest). Entries beyond 2**40 after multiplying count as 2**40. Components
whose variance is below 1e-12 of the whole have no direction that can be told from rounding and are left out: fewer than two different vectors, or an empty table,
have no components at all. Repeated rows, and rows without an id, count and stay. A ``deviation`` beyond 2**63 - 1 is
null. Other columns of the input stay; one that has the name of a new column is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmine.llm.spectrum import Spectrum

COMPONENTS = 32
#: Entries per unit, and what is added to each.
SCALE, OFFSET = 64, 1_000_000
FLOOR = 1e-12
_MOST = 2.0**40


@dataclass(frozen=True)
class Whitening:
    """What is learned from the vectors; ``sums`` are of the whole numbers without the offset."""

    n: int
    size: int
    sums: np.ndarray  # whole numbers, one per dimension
    variances: np.ndarray  # of the components, falling
    components: np.ndarray  # one row per component
    total: float  # trace of the covariance

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if len(self.variances) else self.variances


def usable(vector: Column) -> Column:
    """A vector with at least one entry, and only finite ones."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def _block(column: pa.Array, size: int) -> np.ndarray:
    """Whole numbers of a column of usable vectors, without the offset."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -_MOST, _MOST).reshape(-1, size).astype(np.int64)


def _vectors(df: DataFrame, vector: str, size: int) -> DataFrame:
    return df.filter(usable(F.col(vector)) & (F.size(vector) == size))


def _add_rows(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays ``part`` that have the same number ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1) if numbers else []
            for at, row in zip(numbers, values, strict=True):
                sums[at] = sums[at] + row if at in sums else row.copy()
        made = [pa.array(list(sums), pa.int32()), pa.array([row.tolist() for row in sums.values()], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(made, names=["at", "part"])

    added = parts.repartition("at").mapInArrow(run, "at int, part array<double>")
    return {r["at"]: np.array(r["part"]) for r in added.collect()}


def _products(vectors: DataFrame, vector: str, size: int, change: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of products of each two columns of the changed vectors, and the sums of the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width + 1, width))
        for batch in batches:
            rows = change(_block(batch.column(0), size))
            sums[:width] += rows.T @ rows
            sums[width] += rows.sum(axis=0)
        made = [pa.array(np.arange(width + 1, dtype=np.int32)), pa.array(sums.tolist(), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(made, names=["at", "part"])

    found = _add_rows(vectors.select(vector).mapInArrow(run, "at int, part array<double>"))
    if not found:
        return np.zeros((width, width)), np.zeros(width)
    return np.stack([found[i] for i in range(width)]), found[width]


def _covariance(products: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    mean = sums / n
    return products / n - np.outer(mean, mean)


def _entry_sums(df: DataFrame, vector: str) -> tuple[int, int, np.ndarray]:
    """Length of the vectors, their number, and the sum per dimension in whole numbers."""
    usual = (
        df.filter(usable(F.col(vector)))
        .groupBy(F.size(vector).alias("size"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("size"))
        .first()
    )
    if usual is None:
        return 0, 0, np.zeros(0, dtype=object)
    size = usual["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = _block(batch.column(0), size).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(sums)], names=["at", "part"])

    parts = _vectors(df, vector, size).select(vector).mapInArrow(run, "at int, part long")
    added = parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(38, 0)")).alias("sum")).collect()
    sums = np.zeros(size, dtype=object)
    for row in added:
        sums[row["at"]] = int(row["sum"])
    return size, usual["n"], sums


def fit(df: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> Whitening:
    """The ``most`` leading components of all usable vectors of ``df``."""
    size, n, sums = _entry_sums(df, vector)
    if n == 0:
        return Whitening(0, 0, np.zeros(0, dtype=object), np.zeros(0), np.zeros((0, 0)), 0.0)
    middle = np.array([round(int(s) / n) for s in sums], dtype=np.int64)
    products, rest = _products(
        _vectors(df, vector, size), vector, size, lambda rows: (rows - middle).astype(np.float64), size
    )
    covariance = _covariance(products, rest, n)
    total = float(np.trace(covariance))
    variances, components = Spectrum(covariance).leading(min(most, size), FLOOR * total)
    return Whitening(n, size, sums, variances, components, total)


def _centred(rows: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """Rows less the mean, and n times that in whole numbers (right where it is below 2**63)."""
    wide = model.n * rows.astype(np.float64) - model.sums.astype(np.float64)
    if np.abs(wide).max(initial=0.0) < 2.0**62:
        exact = rows * model.n - model.sums.astype(np.int64)
        return exact / model.n, exact
    middle = np.array([round(int(s) / model.n) for s in model.sums], dtype=np.int64)
    rest = np.array([int(s) - int(m) * model.n for s, m in zip(model.sums, middle, strict=True)], dtype=np.float64)
    with np.errstate(over="ignore"):
        exact = rows * np.int64(model.n) - np.array([int(s) % 2**64 for s in model.sums], dtype=np.uint64).view(np.int64)
    return (rows - middle) - rest / model.n, np.where(np.abs(wide) < 2.0**40, exact, 2**40)


def _whitened(rows: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(rows, model)[0] @ (model.components.T / np.sqrt(model.variances))


def _deviation(rows: np.ndarray, model: Whitening) -> pa.Array:
    """Sum of squares of n times the centred entries, exact; null where it needs more than 63 bits."""
    exact = _centred(rows, model)[1]
    rough = (exact.astype(np.float64) ** 2).sum(axis=1)
    small = rough < 2.0**62
    with np.errstate(over="ignore"):
        found = (exact * exact).sum(axis=1).tolist()
    for i in np.flatnonzero(~small):
        whole = sum(int(z) ** 2 for z in exact[i]) if rough[i] < 2.0**64 else 2**63
        found[i] = whole if whole < 2**63 else None
    return pa.array(found, pa.int64())


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance less the identity; None without components."""
    width = len(model.variances)
    if width == 0:
        return None
    vectors = _vectors(df, vector, model.size)
    products, sums = _products(vectors, vector, model.size, lambda rows: _whitened(rows, model), width)
    return float(np.abs(_covariance(products, sums, model.n) - np.eye(width)).max())


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Usable rows of ``df`` without the vector, with ``deviation`` and ``whitened``: an entry per component."""
    if taken := {"deviation", "whitened"} & set(df.columns):
        raise ValueError(f"the input has columns named {sorted(taken)}")
    rows = _vectors(df, vector, model.size)
    kept = [c for c in df.columns if c != vector]
    schema = T.StructType(
        [*(df.schema[c] for c in kept), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    if len(model.variances) == 0:
        return rows.limit(0).select(
            *(F.col(f"`{c}`") for c in kept), F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")
        )
    at, places = df.columns.index(vector), [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = _block(batch.column(at), model.size)
            flat = _whitened(block, model)
            ends = np.arange(len(block) + 1, dtype=np.int32) * flat.shape[1]
            whitened = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))
            columns = [*(batch.column(i) for i in places), _deviation(block, model), whitened]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)

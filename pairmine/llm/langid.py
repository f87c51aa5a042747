"""Operator 7: language identification by nearest centroids.

A text becomes the counts of its character 1-, 2- and 3-grams (letters in lower case, anything else one blank), hashed into
``DIMS`` places, dampened by a logarithm, weighed by inverse document frequency and scaled to length one. Each
language has several centroids, found by spherical k-means. The nearest centroid by cosine gives the language.

The document frequencies are counted over all the labelled rows. The centroids are fitted, one language per task, on at most
``PER_LANGUAGE`` distinct labelled texts of each language, those with the smallest seeded hash. The model is one array of
(languages x CENTROIDS) x DIMS floats.

Rejection by distance: a text whose cosine is below ``REJECT`` times the lowest centile that the fitted rows of that centroid reach
is marked as rejected; for a short text, of n n-grams, this limit is n / (n + SHORT) as high. A text without any letter
is rejected too, and its language is ``und``.

Defined results: a null or letterless text, or a model without languages, gives ``und`` with score 0; a text of any length is
read whole; ties go to the first language in code-point order; rows that repeat others get equal predictions; an
empty table gives an empty table. ``predict`` keeps the columns of its input; its own names start with ``langid_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairmine.llm.common import unit
from pairmine.session import materialise

DIMS = 8192
CENTROIDS = 4
PER_LANGUAGE = 400
REJECT = 0.5
SHORT = 100
SEED = 5
UNKNOWN = "und"
_STEPS = 10
_PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]  # of each centroid
    centroids: np.ndarray
    weights: np.ndarray  # inverse document frequencies
    limits: np.ndarray  # the cosine below which a centroid rejects


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x30000)]))
    return _LETTERS[0]


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text, or None without a letter."""
    total, seen = np.zeros(DIMS), False
    for start in range(0, len(text), _PIECE):
        piece = text[start : start + _PIECE].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(piece, dtype=np.uint32).astype(np.uint64)
        letter = _letters()[np.minimum(points, 0x2FFFF)]
        seen = seen or bool(letter.any())
        points = np.where(letter, points, 32)
        blank = points == 32
        points = np.concatenate([[32], points[~(blank & np.concatenate([[True], blank[:-1]]))], [32]]).astype(np.uint64)
        code = np.zeros(len(points), dtype=np.uint64)
        for order in range(1, 4):
            code = code[: len(points) - order + 1] * np.uint64(0x1000003) + points[order - 1 :]
            mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
            total += np.bincount(mixed.astype(np.int64), minlength=DIMS)
    return total if seen else None


def vector(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    heavy = np.log1p(found) * weights
    length = np.linalg.norm(heavy)
    return heavy / length if length else heavy


def _k_means(vectors: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), size=min(k, len(vectors)), replace=False)]
    for _ in range(_STEPS):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.array([vectors[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, (vectors @ centres.T).argmax(axis=1)


def train(labelled: DataFrame, *, per_language: int = PER_LANGUAGE, reject: float = REJECT) -> Model:
    """Learns from (text, lang); rows where either is null say nothing."""
    rows = labelled.select("text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                found = counts(text.as_py())
                if found is not None:
                    total += found > 0
                    n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], names=["dim", "n"]
        )

    summed = rows.select("text").mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n"))
    seen = np.zeros(DIMS + 1, dtype=np.int64)
    for row in summed.collect():  # DIMS + 1 rows
        seen[row["dim"]] = row["n"]
    weights = np.log((1.0 + seen[DIMS]) / (1.0 + seen[:DIMS])) + 1.0

    # Copies of a text count once. A share of each language's texts by hash first, so that the window below sorts a few times
    # per_language rows.
    marked = rows.withColumn("mark", F.xxhash64(F.lit(SEED), "text"))
    marks = materialise(marked.select("lang", "mark").distinct())
    sizes = materialise(marks.groupBy("lang").count())
    chosen = materialise(
        marks.join(sizes, "lang")
        .filter(unit(F.col("mark")) < F.lit(4.0 * per_language) / F.col("count"))
        .withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("mark")))
        .filter(F.col("at") <= per_language)
        .select("lang", "mark")
    )
    drawn = marked.join(chosen, ["lang", "mark"]).groupBy("lang", "mark").agg(F.min("text").alias("text"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        found = [c for c in (counts(t) for t in group["text"]) if c is not None]
        if not found:
            return pd.DataFrame({"lang": [], "at": [], "limit": [], "centre": []})
        vectors = np.array([vector(c, weights) for c in found])
        centres, own = _k_means(vectors, CENTROIDS, SEED)
        close = (vectors @ centres.T).max(axis=1)
        limits = [float(np.quantile(close[own == i], 0.01)) if (own == i).any() else 1.0 for i in range(len(centres))]
        return pd.DataFrame(
            {
                "lang": group["lang"].iloc[0],
                "at": range(len(centres)),
                "limit": limits,
                "centre": [c.astype(np.float32).tolist() for c in centres],
            }
        )

    fitted = drawn.select("lang", "text").groupBy("lang").applyInPandas(
        fit, "lang string, at int, limit double, centre array<float>"
    )
    found = sorted(fitted.collect(), key=lambda r: (r["lang"], r["at"]))  # CENTROIDS rows per language
    return Model(
        tuple(r["lang"] for r in found),
        np.array([r["centre"] for r in found], dtype=np.float32).reshape(-1, DIMS),
        weights,
        np.array([reject * r["limit"] for r in found]),
    )


def predict(docs: DataFrame, model: Model, text: Column | str = "text") -> DataFrame:
    """``docs`` with langid_pred, langid_score (the cosine) and langid_rejected."""
    centroids, languages, weights, limits = model.centroids, model.languages, model.weights, model.limits

    def one(value: str | None) -> tuple[str, float, bool]:
        found = counts(value) if value is not None and languages else None
        if found is None:
            return UNKNOWN, 0.0, True
        cosines = centroids @ vector(found, weights).astype(np.float32)
        best = int(cosines.argmax())
        grams = found.sum()
        far = bool(cosines[best] < limits[best] * grams / (grams + SHORT))
        return languages[best], float(min(max(cosines[best], 0.0), 1.0)), far

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [one(t.as_py()) for t in batch.column(len(names))]
            more = [
                pa.array([x[0] for x in told], type=pa.string()),
                pa.array([x[1] for x in told], type=pa.float64()),
                pa.array([x[2] for x in told], type=pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *more], names=[*names, *added])

    added = ["langid_pred", "langid_score", "langid_rejected"]
    schema = docs.select("*", F.lit("").alias(added[0]), F.lit(0.0).alias(added[1]), F.lit(False).alias(added[2])).schema
    for field in schema.fields[len(names) :]:
        field.nullable = True
    whole = docs.select("*", (F.col(text) if isinstance(text, str) else text).cast("string").alias("langid_text"))
    return whole.mapInArrow(run, schema)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows that are rejected."""
    return predict(docs, model).filter(~F.col("langid_rejected")).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Operator 12: periodic runs of words in a text, by seed-and-extend along diagonals.

A run is a stretch of words with smallest period q and at least max(6, 4 * q) words that no neighbouring word extends. A run
of period q shows on the diagonal of lag q (word i beside word i + q) as a stretch of equal words of length max(6 - q, 3 * q) or
more: the guaranteed overlap. Lags are taken in classes a..b; the k-grams of a class are as long as its lag a
guarantees (5 words for lags 1 to 3, then 3 * a), and b is at most (3 * a + 1) / 2. So every run of a class holds a k-gram
that occurs again exactly q later, and not before: an occurrence in between would give the k-gram two periods that together are no
longer than it, and the run a shorter period. It is enough, then, to take each occurrence of a k-gram with the next one
in the same text, never all pairs: a text that repeats one word a million times has a million pairs in the first class and none in
the others. Each pair is a seed on its lag; a table holds how far each lag is covered already, and only seeds beyond that
are extended to both sides.

K-grams are numbered exactly (the number of a longer one comes from two shorter ones that overlap) and a position
whose k-gram does not come twice is dropped before longer ones are looked at. The words of many texts are worked on at once; a
text longer than ``PORTION`` words is a portion of its own, and takes about 100 bytes per word. Nothing is shuffled.

Defined results: a null text, or one without words, has no runs and an empty rest; words are told apart exactly (case counts); rows that repeat
stay; an empty table gives an empty table. All columns of the input stay; one that has the name of a new column is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import whole

#: Words that are worked on together, if texts are short.
PORTION = 200_000
LEAST, POWER = 6, 4
RUNS = "array<struct<start: int, length: int, period: int>>"


def lag_classes(most: int) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, words of a k-gram) up to lag ``most``."""
    first, last, size = 1, 3, LEAST - 1
    while first <= most:
        yield first, last, size
        first = last + 1
        last, size = (3 * first + 1) // 2, 3 * first


def _repeated(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of positions ``at`` with ``keys``: those whose key comes twice, ordered by key and position, and their key's number."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    fresh = np.ones(len(ranked), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    lone = fresh & np.append(fresh[1:], True)
    return at[order[~lone]], (np.cumsum(fresh) - 1)[~lone]


def _stretch(codes: np.ndarray, lag: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch around [low, high) in which each word equals the one ``lag`` later."""
    step = 64
    while high + lag < len(codes):
        stop = min(high + step, len(codes) - lag)
        other = np.flatnonzero(codes[high:stop] != codes[high + lag : stop + lag])
        if len(other):
            high += int(other[0])
            break
        high, step = stop, step * 2
    step = 64
    while low > 0:
        start = max(low - step, 0)
        other = np.flatnonzero(codes[start:low] != codes[start + lag : low + lag])
        if len(other):
            low = start + int(other[-1]) + 1
            break
        low, step = start, step * 2
    return low, high


def runs_of(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and period.

    ``codes``: the words of one or more texts as numbers, one text after the other; equal words of different texts have different
    numbers. ``longest``: words of the longest text.
    """
    found: list[tuple[int, int, int]] = []
    at, number = _repeated(codes, np.arange(len(codes), dtype=np.int64))
    have = 1
    for first, last, size in lag_classes(longest // POWER):
        while have < size and len(at):
            grown = min(2 * have, size)
            name = np.full(len(codes) + grown, -1, dtype=np.int64)
            name[at] = number
            at = at[name[at + grown - have] >= 0]
            at = np.sort(at)
            width = int(number.max()) + 1
            at, number = _repeated(name[at] * width + name[at + grown - have], at)
            have = grown
        if not len(at):
            break
        lags = at[1:] - at[:-1]
        seeds = np.flatnonzero((number[1:] == number[:-1]) & (lags >= first) & (lags <= last))
        seeds = seeds[np.lexsort((at[seeds], lags[seeds]))]
        covered: dict[int, int] = {}
        starts, own = at[seeds], lags[seeds]
        i = 0
        while i < len(seeds):
            lag = int(own[i])
            if starts[i] < covered.get(lag, 0):  # on to the first seed of this lag that is not covered, or the next lag
                stop = np.searchsorted(own, lag, "right")
                i += max(1, int(np.searchsorted(starts[i:stop], covered[lag])))
                continue
            low, high = _stretch(codes, lag, int(starts[i]), int(starts[i]) + size)
            covered[lag] = high
            length = high - low + lag
            if length >= max(LEAST, POWER * lag):
                found.append((low, length, lag))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _texts_at_once(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(place of the first, words of each) of as many texts as make a portion."""
    held: list[list[bytes]] = []
    first, words = 0, 0
    for place, text in enumerate(texts):
        # bytes.split() without an argument cuts at exactly the six white-space bytes
        held.append(text.as_py().encode("utf-8").split())
        words += len(held[-1])
        if words >= PORTION:
            yield first, held
            held, first, words = [], place + 1, 0
    if held:
        yield first, held


def _portion(texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs of each text, and each text's words that are kept."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode()
    words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = words + np.repeat(np.arange(len(texts)), sizes) * len(flat.dictionary)
    for start, length, period in runs_of(codes, int(sizes.max(initial=0))):
        own = int(np.searchsorted(begin, start, "right")) - 1
        runs[own].append((start - int(begin[own]), length, period))
    kept = []
    for text, mine in zip(texts, runs, strict=True):
        if mine:
            edge = np.zeros(len(text) + 1, dtype=np.int64)
            for start, length, period in mine:
                edge[start + period] += 1
                edge[start + length] -= 1
            text = [w for w, inside in zip(text, np.cumsum(edge)[:-1], strict=True) if not inside]
        kept.append(b" ".join(text).decode("utf-8"))
    return runs, kept


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (array of start, length, period, in word numbers from 0, by start and period) and collapsed.

    ``collapsed`` is the text's words joined by one space without those that lie in a run after its first period.
    """
    new = {"n_words": "int", "runs": RUNS, "collapsed": "string"}
    if taken := set(new) & set(docs.columns):
        raise ValueError(f"the input has columns named {sorted(taken)}")
    rows = docs.withColumn(text, whole(text))
    schema = rows.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in new.items())).schema
    column = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("period", pa.int32())]))
        for batch in batches:
            for first, texts in _texts_at_once(batch.column(column)):
                runs, kept = _portion(texts)
                part = batch.slice(first, len(texts))
                made = [
                    pa.array([len(t) for t in texts], pa.int32()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in runs], kind),
                    pa.array(kept, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *new])

    return rows.mapInArrow(run, schema)


def strongest(runs: str | Column = "runs") -> Column:
    """The run with the greatest length / period, of equal ones the first by start and period; null without runs.

    Quotients of numbers below 2**26 differ as doubles if they differ at all.
    """
    ranked = F.transform(
        runs,
        lambda r: F.struct(
            (-(r["length"].cast("double") / r["period"])).alias("order"),
            r["start"].alias("start"),
            r["period"].alias("period"),
            r["length"].alias("length"),
        ),
    )
    return F.array_min(ranked)

"""Operator 12: runs against comparing every word with the one each lag later, on texts and on the table."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairmine.llm import periodic, queries

FOLDER = "/root/testdata/sf0.01"


def plain_runs(words):
    """All lags, each diagonal in full; a stretch whose smallest period is shorter does not count."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.array([names[w] for w in words], dtype=np.int64)
    n, found = len(codes), []

    def smallest(part):
        return next(q for q in range(1, len(part) + 1) if np.array_equal(part[q:], part[: len(part) - q]))

    for q in range(1, n // 4 + 1):
        same = np.flatnonzero(np.diff(np.concatenate([[0], codes[q:] == codes[: n - q], [0]])))
        for low, high in zip(same[::2], same[1::2], strict=True):
            length = int(high - low) + q
            if length >= max(6, 4 * q) and smallest(codes[low : low + length]) == q:
                found.append((int(low), length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_rest(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fast_runs(*texts):
    return periodic._portion([[w.encode() for w in t] for t in texts])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=1), max_size=70), st.integers(1, 9), st.integers(1, 8))
def test_small_alphabet(words, period, times):
    text = words + words[-period:] * times + words[:3]
    runs, kept = fast_runs(text, words, text)
    assert runs[0] == runs[2] == plain_runs(text) and runs[1] == plain_runs(words)
    assert kept[0] == plain_rest(text, runs[0])


def test_longer_periods():
    rng = random.Random(5)
    for _ in range(60):
        period = rng.randint(1, 70)
        part = [rng.choice("abc") for _ in range(period)]
        # a period in which every k-gram comes more than once, with one word changed
        part = part * rng.randint(1, 3) + [rng.choice("abcd")]
        text = [rng.choice("abc") for _ in range(rng.randint(0, 30))] + part * rng.randint(3, 6) + part[: rng.randint(0, len(part))]
        text += [rng.choice("abc") for _ in range(rng.randint(0, 30))]
        assert fast_runs(text)[0][0] == plain_runs(text)


def test_lag_classes_cover_all_lags():
    after = 1
    for first, last, size in periodic.lag_classes(100_000):
        assert first == after and 2 * last - 1 <= size  # two periods of a k-gram are no longer than it
        assert all(size <= max(6 - q, 3 * q) for q in (first, last))
        after = last + 1
    assert after > 100_000


def test_extensions_are_not_repeated(monkeypatch):
    calls = []
    stretch = periodic._stretch
    monkeypatch.setattr(periodic, "_stretch", lambda *a: calls.append(a[1]) or stretch(*a))
    assert fast_runs(["x"] * 50_000)[0][0] == [(0, 50_000, 1)] and calls == [1]
    calls.clear()
    part = [str(i) for i in range(900)]
    assert fast_runs(part * 40 + ["end"])[0][0] == [(0, 36_000, 900)] and calls == [900]


def edited(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op12_periodic_runs(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    with_runs = 0
    for r in rows:
        words = edited(r.doc_id, texts[r.doc_id])
        runs = plain_runs(words)
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join("%d,%d,%d\n" % x for x in runs))
        assert r.collapsed_sha256 == sha(plain_rest(words, runs))
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        with_runs += bool(runs)
    assert with_runs > 20


def test_odd_rows(spark):
    rows = [(1, None, "k"), (None, "a " * 7, "k"), (2, "", None), (2, " \n", None), (3, "A a " * 4 + "\n" + "y " * 5, "k"), (3, "b " * 300_000, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").coalesce(1)
    got = periodic.find_runs(docs)
    assert got.columns == ["doc_id", "text", "kept", "n_words", "runs", "collapsed"]
    found = sorted(((r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    assert found == sorted(
        [(0, [], "")] * 3 + [(7, [(0, 7, 1)], "a"), (13, [(0, 8, 2)], "A a y y y y y"), (300_000, [(0, 300_000, 1)], "b")], key=repr
    )
    assert periodic.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic.find_runs(docs.withColumnRenamed("kept", "runs"))

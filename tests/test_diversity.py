from __future__ import annotations

import numpy as np
import pytest

from pairmine.operators import diversity as dv

SCHEMA = "prompt_id bigint, sample_idx int, embedding array<float>"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def diversities(df, **options):
    return {(r.prompt_id, r.sample_idx): r.diversity for r in dv.max_sim_diversity(df, **options).collect()}


def brute(rows):
    """Highest and smallest positive similarity per row, the slow way."""
    groups, out = {}, {}
    for g, i, v in rows:
        groups.setdefault(g, []).append((i, v))
    for g, members in groups.items():
        if any(v is None for _, v in members):
            out.update({(g, i): (None, None) for i, _ in members})
            continue
        units = {i: np.array(v, dtype=np.float32).astype(float) for i, v in members}
        units = {i: v / max(np.linalg.norm(v), 1e-12) for i, v in units.items()}
        for i in units:
            sims = [float(units[i] @ units[j]) for j in units if j != i]
            positive = [s for s in sims if s > 0]
            out[g, i] = (max(sims) if sims else None, min(positive) if positive else None)
    return out


def assert_profile(df, rows, **options):
    got = {(r.prompt_id, r.sample_idx): (r.max_sim, r.min_positive_sim) for r in dv.similarity_profile(df, **options).collect()}
    expected = brute(rows)
    assert got.keys() == expected.keys()
    for key, pair in expected.items():
        for mine, theirs in zip(got[key], pair):
            assert (mine is None) == (theirs is None), key
            assert mine is None or mine == pytest.approx(theirs, abs=1e-9), key


def test_special_groups(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    rows = [
        (1, 0, v),                                              # only candidate
        (2, 0, v), (2, 1, v),                                   # the same vector twice
        (3, 0, v), (3, 1, [-1.0, 0.0]),                         # opposite vectors
        (4, 0, [0.0, 0.0]), (4, 1, v),                          # zero vector
        (5, 0, v), (5, 1, w), (5, 2, None),                     # one vector missing
    ]
    got = diversities(table(spark, rows))
    assert got == {
        (1, 0): 0.0, (2, 0): 0.0, (2, 1): 0.0, (3, 0): 2.0, (3, 1): 2.0, (4, 0): 1.0, (4, 1): 1.0,
        (5, 0): 0.0, (5, 1): 0.0, (5, 2): 0.0,
    }
    assert_profile(table(spark, rows), rows)


def random_rows(seed, sizes, dim=6, missing=()):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        pool = rng.normal(size=(max(n // 2, 1), dim)).round(1)
        for i in range(n):
            vector = pool[rng.integers(len(pool))] if i % 3 == 0 else rng.normal(size=dim)
            if i % 11 == 5:
                vector = np.zeros(dim)
            rows.append((g, i, None if (g, i) in missing else [float(x) for x in vector]))
    return rows


@pytest.mark.parametrize("block_rows", [4, 7, 1000])
def test_large_groups_match_brute_force(spark, block_rows):
    """Blocks far smaller than the groups: same result as with one block per group."""
    rows = random_rows(1, [1, 2, 40, 5, 90, 3], missing={(3, 2)})
    assert_profile(table(spark, rows).repartition(6), rows, block_rows=block_rows)


def test_a_missing_vector_in_a_large_group(spark):
    rows = random_rows(2, [30, 30], missing={(1, 7)})
    assert_profile(table(spark, rows), rows, block_rows=8)
    got = diversities(table(spark, rows), block_rows=8)
    assert all(got[1, i] == 0.0 for i in range(30))


def test_copies_of_one_vector_fill_a_large_group(spark):
    rows = [(1, i, [1.0, 2.0]) for i in range(50)] + [(1, 50, [2.0, -1.0]), (1, 51, [0.0, 0.0]), (1, 52, [0.0, 0.0])]
    assert_profile(table(spark, rows), rows, block_rows=10)
    got = diversities(table(spark, rows), block_rows=10)
    assert {got[1, i] for i in range(50)} == {0.0}
    assert (got[1, 50], got[1, 51], got[1, 52]) == (1.0, 1.0, 1.0)


def test_many_large_groups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dv, "_BROADCAST_GROUPS", 1)
    rows = random_rows(3, [20, 25, 3])
    assert_profile(table(spark, rows), rows, block_rows=6)


def test_rows_of_a_group_in_several_arrow_batches(spark):
    rows = random_rows(4, [50, 1, 33])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert_profile(table(spark, rows), rows)
        assert_profile(table(spark, rows), rows, block_rows=10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_group_is_a_group(spark):
    rows = [(None, 0, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (1, 0, [1.0, 0.0])]
    assert diversities(table(spark, rows)) == {(None, 0): 0.0, (None, 1): 0.0, (1, 0): 0.0}
    rows = [(None, i, [1.0, float(i)]) for i in range(12)]
    assert_profile(table(spark, rows), rows, block_rows=3)


def test_several_group_columns_and_other_columns_are_kept(spark):
    df = spark.createDataFrame(
        [("a", 1, 0, "x", [1.0, 0.0]), ("a", 1, 1, "y", [0.0, 1.0]), ("b", 1, 0, "x", [1.0, 0.0])],
        "run string, prompt_id int, sample_idx int, word string, embedding array<double>",
    )
    got = dv.max_sim_diversity(df, ["run", "prompt_id"])
    assert got.columns == ["run", "prompt_id", "sample_idx", "word", "diversity"]
    assert sorted((r.run, r.word, r.diversity) for r in got.collect()) == [("a", "x", 1.0), ("a", "y", 1.0), ("b", "x", 0.0)]


def test_own_similarity_and_score(spark):
    rows = [(1, 0, [1.0]), (1, 1, [4.0]), (1, 2, [6.0])]
    closeness = lambda a, b: 1.0 / (1.0 + abs(a - b.T))
    for block_rows in (1000, 2):
        got = diversities(
            table(spark, rows), similarity=closeness, score=lambda high, low: 10 * high, block_rows=block_rows
        )
        assert got == {(1, 0): 2.5, (1, 1): 3.333333, (1, 2): 3.333333}


def test_attach_embeddings(spark):
    words = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "prompt_id int, word string")
    vectors = spark.createDataFrame([("a", [1.0]), ("c", [2.0])], "word string, embedding array<float>")
    got = dv.attach_embeddings(words, vectors).collect()
    assert sorted((r.prompt_id, r.word, r.embedding) for r in got if r.embedding) == [(1, "a", [1.0]), (2, "a", [1.0])]
    assert [r.word for r in got if r.embedding is None] == ["b"]


def test_empty_table(spark):
    assert dv.max_sim_diversity(table(spark, [])).collect() == []


def test_no_pair_rows_in_the_plan(spark):
    """Neither a cross join nor a join of the vectors with themselves."""
    rows = random_rows(5, [5, 5])
    plan = dv.max_sim_diversity(table(spark, rows))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("block_rows", [3, 5])
def test_a_similarity_that_is_not_symmetric_gives_the_same_in_blocks(spark, block_rows):
    df = table(spark, [(1, i, [float(i), 1.0]) for i in range(12)])
    results = []
    for options in ({}, {"block_rows": block_rows}):
        rows = dv.similarity_profile(df, similarity=lambda a, b: 2 * a[:, :1] - b[:, :1].T, **options).collect()
        results.append({r.sample_idx: (r.max_sim, r.min_positive_sim) for r in rows})
    assert results[0] == results[1]
    assert results[0][3] == (6.0, 1.0), "2 * 3 less the smallest, and less the largest that leaves more than 0"


def test_not_a_number_stays_so_in_blocks(spark):
    df = table(spark, [(1, i, [float(i + 1), 1.0]) for i in range(7)] + [(1, 7, [float("nan"), 1.0])])
    for options in ({}, {"block_rows": 3}):
        for r in dv.similarity_profile(df, **options).collect():
            assert np.isnan(r.max_sim) and np.isnan(r.min_positive_sim), (options, r)


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_vectors_of_another_length_leave_only_their_group_without_scores(spark, block_rows):
    mixed = [(1, 0, [1.0]), (1, 1, [1.0, 0.0, 0.0]), (1, 2, [1.0, 0.0])]
    short, empty = [(2, i, [1.0, float(i)]) for i in range(3)], [(3, i, []) for i in range(3)]
    long = [(4, i, [1.0, 0.0, float(i)]) for i in range(3)]
    got = diversities(table(spark, mixed + short + empty + long).coalesce(1), block_rows=block_rows)
    assert {k[0] for k, v in got.items() if v == 0.0} == {1, 3}
    for group in (2, 4):
        assert got[group, 1] == pytest.approx(1 - 3 / 10**0.5, abs=1e-6)


@pytest.mark.parametrize("lowest", [False, True])
def test_pairs_of_blocks_that_cannot_matter_are_skipped(spark, monkeypatch, lowest):
    """Forty clusters: only few pairs of blocks are compared, and no result changes."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    rows = [(1, i, [float(x) for x in centres[i % 40] + 0.02 * rng.normal(size=24)]) for i in range(2000)]
    df, counts = table(spark, rows), []
    planned = dv.cells.block_pairs

    def counted(parts, *args):
        pairs = planned(parts, *args)
        counts.append((parts.select("_block").distinct().count(), pairs.count()))
        return pairs

    monkeypatch.setattr(dv.cells, "block_pairs", counted)
    got = {r.sample_idx: r for r in dv.similarity_profile(df, block_rows=40, lowest=lowest).collect()}
    units = np.array([v for _, _, v in rows], dtype=np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    sims = units @ units.T
    np.fill_diagonal(sims, -2)
    assert all(got[i].max_sim == pytest.approx(sims[i].max(), abs=1e-9) for i in range(2000))
    if lowest:
        assert all(got[i].min_positive_sim == pytest.approx(sims[i][sims[i] > 0].min(), abs=1e-9) for i in range(2000))
    blocks = counts[0][0]
    compared, everything = sum(n for _, n in counts), blocks * (blocks - 1) // 2
    # what is nearly at a right angle to many clusters has to be compared with all of these for its lowest similarity
    assert blocks >= 40 and compared < everything * (0.9 if lowest else 0.5), (blocks, compared, everything)


def test_directions_that_are_hard_to_bound(spark):
    """Zero vectors, opposite ones, and angles near the bounds: blocks give what one block gives."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 3))
    vectors = [base[i % 6] * (1 if i % 2 else -1) + 1e-7 * rng.normal(size=3) * (i % 5) for i in range(120)]
    rows = [(1, i, [0.0] * 3 if i % 17 == 0 else [float(x) for x in v]) for i, v in enumerate(vectors)]
    assert_profile(table(spark, rows), rows, block_rows=10)


@pytest.mark.parametrize("block_rows", [8, 4096])
def test_spread_of_groups(spark, block_rows):
    rows = random_rows(6, [1, 2, 60, 9], missing={(3, 2)})
    got = {r.prompt_id: r for r in dv.group_spread(table(spark, rows), "prompt_id", "sample_idx", block_rows=block_rows).collect()}
    present = [r for r in rows if r[2] is not None]
    profiles = brute(present)
    for g in range(4):
        units = [np.array(v, dtype=np.float32).astype(float) for k, _, v in present if k == g]
        units = np.array([v / max(np.linalg.norm(v), 1e-12) for v in units])
        sims = units @ units.T
        n = len(units)
        want = (sims.sum() - np.trace(sims)) / (n * (n - 1)) if n > 1 else 0.0
        highs = [h for (k, _), (h, _) in profiles.items() if k == g and h is not None]
        lows = [x for (k, _), (_, x) in profiles.items() if k == g and x is not None]
        assert got[g].n == n and got[g].avg_similarity == pytest.approx(want, abs=1e-12)
        assert got[g].max_sim == pytest.approx(max(highs, default=None) if highs else None, abs=1e-9)
        assert got[g].min_positive_sim == (pytest.approx(min(lows), abs=1e-9) if lows else None)


def test_a_word_with_two_vectors_is_an_error(spark):
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    vectors = spark.createDataFrame([("a", [1.0]), ("a", [2.0])], "word string, embedding array<double>")
    for given in (vectors, lambda words: vectors):
        with pytest.raises(ValueError, match="'a'"):
            dv.attach_embeddings(words, given)
    assert dv.attach_embeddings(words, vectors.limit(1)).count() == 2


@pytest.mark.parametrize("similarity", [None, lambda a, b: a @ b.T])
def test_vectors_are_sent_no_more_often_as_a_group_grows(spark, monkeypatch, similarity):
    """Blocks grow with the group and not their number, whatever ``block_rows`` is."""
    run, sent = dv._run_tasks, []

    def counted(df, keys, *args, **options):
        if "_lo" in keys:
            sent.append(df.count())
        return run(df, keys, *args, **options)

    monkeypatch.setattr(dv, "_run_tasks", counted)
    rng = np.random.default_rng(10)
    units = rng.normal(size=(1200, 24))
    units /= np.linalg.norm(units, axis=1)[:, None]
    df = table(spark, [(1, i, v.tolist()) for i, v in enumerate(units)], "prompt_id bigint, sample_idx int, embedding array<double>")
    got = {r.sample_idx: r for r in dv.similarity_profile(df, block_rows=1, similarity=similarity).collect()}
    sims = units @ units.T
    np.fill_diagonal(sims, -2)
    assert all(got[i].max_sim == pytest.approx(sims[i].max(), abs=1e-9) for i in range(1200))
    assert all(got[i].min_positive_sim == pytest.approx(sims[i][sims[i] > 0].min(), abs=1e-9) for i in range(1200))
    assert sum(sent) <= 65 * 1200, sum(sent) / 1200


def test_blocks_of_long_vectors_stay_small(spark, monkeypatch):
    """No block is larger than memory allows: there are more of them then."""
    monkeypatch.setattr(dv, "_MOST_BYTES", 1)
    run, blocks = dv._run_tasks, []

    def counted(df, keys, *args, **options):
        if "_lo" in keys:
            blocks.append(df.agg({"_hi": "max"}).first()[0])
        return run(df, keys, *args, **options)

    monkeypatch.setattr(dv, "_run_tasks", counted)
    rows = random_rows(11, [900], dim=24)
    assert_profile(table(spark, rows), rows, block_rows=1)
    assert max(b for b in blocks if b is not None) >= 70, blocks

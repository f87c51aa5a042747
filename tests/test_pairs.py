from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairmine.operators import pairs as pr

SCHEMA = "prompt_id bigint, sample_idx int, word string, quality double, diversity double"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [
    (1, 0, "a", 1.0, 0.5), (1, 1, "b", 1.0, 0.7), (1, 2, "c", 0.0, 0.2), (1, 3, "d", 0.0, 0.9),
    (2, 0, "e", 1.0, 0.5), (2, 1, "f", 1.0, 0.1),       # all good
    (3, 0, "g", 0.0, 0.5), (3, 1, "h", None, 0.1),      # all bad
    (4, 0, "i", 1.0, 0.0),                              # one candidate
    (5, 2, "j", 1.0, 0.5), (5, 1, "k", 1.0, 0.5), (5, 3, "l", 0.5, 0.3), (5, 0, "m", 0.5, 0.3),  # ties
]


def test_mine_pairs(spark):
    got = {r.prompt_id: (r.chosen, r.rejected) for r in pr.mine_pairs(table(spark, ROWS)).collect()}
    assert got == {1: ("b", "c"), 5: ("k", "m")}


def test_picks_alone(spark):
    df = table(spark, ROWS)
    chosen = {r.prompt_id: (r.chosen, r.chosen_idx, r.chosen_diversity) for r in pr.pick_chosen(df).collect()}
    assert chosen == {1: ("b", 1, 0.7), 2: ("e", 0, 0.5), 4: ("i", 0, 0.0), 5: ("k", 1, 0.5)}
    rejected = {r.prompt_id: r.rejected for r in pr.pick_rejected(df).collect()}
    assert rejected == {1: "c", 3: "h", 5: "m"}


def test_split_quality_is_disjoint(spark):
    got = {r.word: r.is_good for r in pr.split_quality(table(spark, ROWS)).collect()}
    assert got["a"] and not got["h"] and not got["l"]


def test_seeded_ties_do_not_depend_on_the_spread_of_rows(spark):
    rows = [(p, i, f"w{i}", float(i % 2), 0.5) for p in range(20) for i in range(8)]
    picks = [
        sorted(map(tuple, pr.mine_pairs(table(spark, rows).repartition(n), tie="seeded", seed=7).collect()))
        for n in (1, 3, 6)
    ]
    assert picks[0] == picks[1] == picks[2]
    assert len({r[1] for r in picks[0]}) > 1
    with pytest.raises(ValueError):
        pr.mine_pairs(table(spark, rows), tie="random")


def test_max_target_filter(spark):
    pairs = spark.createDataFrame([("short", "also"), ("much too long", "x"), ("x", "much too long")], "chosen string, rejected string")
    tokens = [F.size(F.split(side, " ")) for side in ("chosen", "rejected")]
    assert [r.chosen for r in pr.max_target_filter(pairs, 2, *tokens).collect()] == ["short"]
    assert pr.max_target_filter(pairs, 3, F.lit(3), F.lit(3)).count() == 3
    with pytest.raises(Exception, match="no token count"):
        pr.max_target_filter(pairs, 3, F.lit(None).cast("int"), F.lit(3)).collect()


def test_missing_diversity_does_not_win(spark):
    rows = [(1, 0, "a", 1.0, None), (1, 1, "b", 1.0, 0.9), (1, 2, "c", 0.0, 0.3), (1, 3, "d", 0.0, None)]
    df = spark.createDataFrame(rows, "prompt_id long, sample_idx int, word string, quality double, diversity double")
    got = pr.mine_pairs(df).first()
    assert (got.chosen, got.rejected, got.rejected_diversity) == ("b", "d", 0.0)


def test_pair_audit(spark):
    got = {r.prompt_id: tuple(r)[1:] for r in pr.pair_audit(table(spark, ROWS)).collect()}
    assert got == {2: (2, 2, 0, "no bad"), 3: (2, 0, 2, "no good"), 4: (1, 1, 0, "no bad")}


def test_audit_lines(spark):
    lines = {(r.prompt_id, r.word): (r.quality_text, r.diversity_text) for r in pr.audit_lines(table(spark, ROWS)).collect()}
    assert lines == {
        (2, "e"): ("e(1.0)", "e(0.500)"), (2, "f"): ("f(1.0)", "f(0.100)"), (3, "g"): ("g(0.0)", "g(0.500)"),
        (3, "h"): ("h(0.0)", "h(0.100)"), (4, "i"): ("i(1.0)", "N/A"),
    }


rows_strategy = st.lists(
    st.tuples(st.integers(0, 3), st.sampled_from([0.0, 1.0, None]), st.integers(0, 4)), min_size=1, max_size=30
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows_strategy)
def test_pair_properties(spark, given_rows):
    rows = [(p, i, f"w{i}", q, d / 4) for i, (p, q, d) in enumerate(given_rows)]
    by_prompt = {}
    for p, i, w, q, d in rows:
        by_prompt.setdefault(p, {})[w] = ((q or 0.0) >= 1, d)
    pairs = pr.mine_pairs(table(spark, rows)).collect()
    audited = {r.prompt_id for r in pr.pair_audit(table(spark, rows)).collect()}
    assert {r.prompt_id for r in pairs} | audited == set(by_prompt)
    assert not {r.prompt_id for r in pairs} & audited
    for r in pairs:
        members = by_prompt[r.prompt_id]
        assert members[r.chosen][0] and not members[r.rejected][0]
        assert r.chosen_diversity == max(d for good, d in members.values() if good)
        assert r.rejected_diversity == min(d for good, d in members.values() if not good)

from __future__ import annotations

import math

import pytest

from pairmine.operators import metrics as mt
from pairmine.schemas import BATCHES, PAIR_LOGPS

ROWS = [
    (0, 1, -1.0, -2.0, -1.5, -1.5),
    (0, 2, -3.0, -3.0, -2.0, -2.0),      # chosen = rejected
    (0, 3, -1.0, -2.0, None, -1.5),      # log-probability missing
    (50, 1, -1.0, -5.0, -1.0, -1.0),
    (50, 2, -2.0, -1.0, -1.0, -1.0),
    (50, 3, -2.0, -1.0, -1.0, -1.0),
    (50, 4, -2.0, -1.0, -1.0, -1.0),
    (51, 1, -2.0, -1.0, -1.0, -1.0),
]


def pairs(spark, rows=ROWS):
    return spark.createDataFrame(rows, PAIR_LOGPS)


def batches(spark):
    return spark.createDataFrame([(0, 4), (50, 4), (51, 2), (99, 8)], BATCHES)


def test_batch_metrics(spark):
    got = {r.batch_id: r for r in mt.batch_metrics(pairs(spark), batches(spark)).collect()}
    assert set(got) == {0, 50, 51, 99}
    first = got[0]
    losses = [math.log1p(math.exp(-0.1 * x)) for x in (1.0, 0.0)]
    assert first.loss == pytest.approx(sum(losses) / 2)
    assert first.logits == pytest.approx(0.5)
    assert first.rewards_chosen == pytest.approx(0.1 * (0.5 - 1.0) / 2)
    assert first.rewards_rejected == pytest.approx(0.1 * (-0.5 - 1.0) / 2)
    assert first.rewards_margins == pytest.approx(0.05)
    assert first.rewards_accuracy == 0.5, "equal rewards are not accurate"
    assert first.logps_chosen == -2.0 and first.logps_rejected == -2.5
    assert first.valid_pairs_frac == 0.5, "the missing log-probability lowers it"
    assert tuple(got[99])[1:] == (0.0,) * 9, "a batch without pairs is still there"


def test_hinge(spark):
    got = {r.batch_id: r.loss for r in mt.batch_metrics(pairs(spark), batches(spark), loss="hinge", beta=1.0).collect()}
    assert got[0] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        mt.batch_metrics(pairs(spark), batches(spark), loss="ipo")


def test_metrics_do_not_depend_on_order_or_partitions(spark):
    results = []
    for rows, n in ((ROWS, 1), (ROWS[::-1], 5)):
        df = mt.batch_metrics(pairs(spark, rows).repartition(n), batches(spark)).orderBy("batch_id")
        results.append([tuple(round(x, 9) for x in r) for r in df.collect()])
    assert results[0] == results[1]


def test_group_metrics_equal_batch_metrics(spark):
    from pyspark.sql import functions as F

    got = {r.batch_id: r for r in mt.group_metrics(pairs(spark), F.col("batch_id")).collect()}
    whole = {r.batch_id: r for r in mt.batch_metrics(pairs(spark), batches(spark)).collect()}
    for name in mt.METRICS[:-1]:
        assert got[0][name] == pytest.approx(whole[0][name]), name
    assert got[0].valid_pairs_frac == pytest.approx(2 / 3)


def test_sample_pairs_log(spark):
    got = mt.sample_pairs_log(pairs(spark), ["prompt_id"], step="batch_id").orderBy("batch_id", "rank").collect()
    assert [(r.batch_id, r.prompt_id, r["rank"]) for r in got] == [(0, 1, 1), (0, 2, 2), (50, 1, 1), (50, 2, 2), (50, 3, 3)]
    assert got[-1].accuracy == 0.25, "over all pairs of the step, not only the shown ones"


def test_sample_pairs_are_limited_before_the_shuffle(spark):
    plan = mt.sample_pairs_log(pairs(spark), ["prompt_id"], step="batch_id")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_sequence_logps(spark):
    df = spark.createDataFrame([(1, -1.0, 0), (1, -2.0, 1), (2, -4.0, 0)], "s int, logp double, mask int")
    assert {r.s: r.sequence_logp for r in mt.sequence_logps(df, "s").collect()} == {1: -2.0, 2: 0.0}


def test_step_windows(spark):
    df = pairs(spark).withColumnRenamed("batch_id", "step")
    got = {r.first_step: r for r in mt.step_window_metrics(df).collect()}
    assert set(got) == {0, 50}
    assert got[50].rewards_accuracy == 0.125, "the mean of the steps' own values, 1/4 and 0"
    assert got[0].valid_pairs_frac == pytest.approx(2 / 3)


def test_step_windows_over_batches(spark):
    from pyspark.sql import functions as F

    df = pairs(spark).withColumn("step", F.floor(F.col("batch_id") / 50))
    one = {r.first_step: r for r in mt.step_window_metrics(df, every=1).collect()}
    each = {r.first_step: r for r in mt.step_window_metrics(df, every=1, batch="batch_id").collect()}
    assert one[1].rewards_accuracy == 0.2 and each[1].rewards_accuracy == 0.125, "batches 50 and 51 weigh alike"

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pairmine.operators import diversity as dv
from pairmine.operators import metrics as mt
from pairmine.operators import pairs as pr
from pairmine.streaming import metrics as sm
from pairmine.streaming import pairs as sp

START = datetime(2024, 1, 1)
SCHEMA = "ts timestamp, prompt_id bigint, sample_idx int, text string"


def score(candidates):
    vector = F.array(F.length("word").cast("double"), F.ascii("word").cast("double"))
    scored = candidates.withColumn("quality", (F.length("word") % 2).cast("double")).withColumn("embedding", vector)
    return dv.max_sim_diversity(scored, sp.GROUP)


def samples(hours, per_hour=12, prompts=3):
    words = ["a", "bb", "ccc", "dddd", "Echo!", "sea.", "tree"]
    return [
        (START + timedelta(hours=h, minutes=i), i % prompts, i, f"the answer is {words[(i * 5 + h) % len(words)]}")
        for h in range(hours)
        for i in range(per_hour)
    ]


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    sp.stream_pairs(stream, score, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/out/pairs").drop("epoch_id")


def batch(spark, rows):
    closed = sp.closed_candidates(spark.createDataFrame(rows, SCHEMA), "1 hour", None)
    return pr.mine_pairs(score(closed), sp.GROUP)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_stream_equals_batch_over_several_runs(spark, tmp_path):
    folder, first, second = str(tmp_path), samples(3), samples(6)[36:]
    closing = [(START + timedelta(hours=9), 0, 0, "end")]
    for part in (first, second, closing):
        write(spark, part, f"{folder}/in")
        streamed = run(spark, folder)
    assert rows_of(streamed) == rows_of(batch(spark, first + second))


def test_open_windows_are_mined_at_the_end_of_the_input(spark, tmp_path):
    folder, rows = str(tmp_path), samples(4)
    write(spark, rows, f"{folder}/in")
    assert run(spark, folder).count() < batch(spark, rows).count()
    more = [(START + timedelta(hours=h, minutes=1), 5, i, f"word{'x' * i}") for h in (1, 5) for i in range(3)]
    write(spark, more, f"{folder}/in")  # three samples of a closed window, three of a new one
    stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
    sp.stream_pairs_to_end(stream, score, f"{folder}/out", f"{folder}/state")
    pairs = spark.read.parquet(f"{folder}/out/pairs").drop("epoch_id")
    assert rows_of(pairs) == rows_of(batch(spark, rows + more[3:])), "closed by the stream, without its input once more"
    assert [r.late_rows for r in spark.read.parquet(f"{folder}/out/late").collect()] == [3]
    assert not list((tmp_path / "out" / "candidates").glob("*")), "candidates go when their pairs are written"


def test_late_samples_are_dropped(spark, tmp_path):
    folder, rows = str(tmp_path), samples(2)
    write(spark, rows + [(START + timedelta(hours=5), 9, 0, "end")], f"{folder}/in")
    before = rows_of(run(spark, folder))
    late = [(START + timedelta(minutes=1), 0, 99, "zzzzz"), (START + timedelta(minutes=1), 77, 0, "zz"),
            (START + timedelta(minutes=1), 77, 1, "zzz"), (START + timedelta(hours=9), 9, 0, "end")]
    write(spark, late, f"{folder}/in")
    assert rows_of(run(spark, folder)) == before == rows_of(batch(spark, rows))


def test_replayed_micro_batch_leaves_each_pair_once(spark, tmp_path):
    closed = sp.closed_candidates(spark.createDataFrame(samples(2), SCHEMA), "1 hour", None)
    for _ in range(2):
        sp.write_epoch(closed, 3, score, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "pairs"))
    assert rows_of(got.drop("epoch_id")) == rows_of(batch(spark, samples(2)))
    assert {r.epoch_id for r in got.collect()} == {3}


def test_step_metrics_stream_equals_batch(spark, tmp_path):
    schema = "ts timestamp, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double"
    rows = [(START + timedelta(minutes=7 * i), -i / 3, -2.0, -1.0, None if i % 4 == 0 else -i / 5) for i in range(40)]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    metrics = sm.stream_step_metrics(stream)
    query = (
        metrics.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = max(r[0] for r in rows) - timedelta(minutes=10)
    expected = [
        r for r in sm.stream_step_metrics(df, delay=None).collect() if r.window_start + timedelta(hours=1) <= last
    ]
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == len(expected) > 2
    for a, b in zip(sorted(got), sorted(expected)):
        assert a.window_start == b.window_start
        for name in mt.METRICS:
            assert a[name] == pytest.approx(b[name])


def test_stream_means_over_batches(spark, tmp_path):
    schema = "ts timestamp, batch string, policy_chosen double, policy_rejected double, ref_chosen double, ref_rejected double"
    rows = [
        (START + timedelta(minutes=7 * i), f"b{i * i % 3}", -i / 3, -2.0, -1.0, None if i % 4 == 0 or i % 3 == 0 else -i / 5)
        for i in range(40)
    ]
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        sm.stream_step_metrics(stream, batch="batch").writeStream.outputMode("append").format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = max(r[0] for r in rows) - timedelta(minutes=10)
    pooled = {r.window_start: r for r in sm.stream_step_metrics(df, delay=None).collect()}
    want = {r.window_start: r for r in sm.stream_step_metrics(df, delay=None, batch="batch").collect()}
    got = {r.window_start: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {w for w in want if w + timedelta(hours=1) <= last} and len(got) > 2
    for start, row in got.items():
        assert all(row[m] == pytest.approx(want[start][m]) for m in mt.METRICS)
    assert any(abs(pooled[w].loss - want[w].loss) > 1e-3 for w in want), "a batch without pairs lowers the mean"
    first = df.filter(F.col("ts") < START + timedelta(hours=1))
    per_batch = mt.group_metrics(first, F.col("batch")).collect()
    assert len(per_batch) == 2 and 0.0 in [r.loss for r in per_batch]
    assert want[START].loss == pytest.approx(sum(r.loss for r in per_batch) / 2)

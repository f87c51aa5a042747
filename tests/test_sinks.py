from __future__ import annotations

from pathlib import Path

import pytest

from pairmine.operators import prep
from pairmine.session import materialise, shared_folder
from pairmine.sources import sinks


def pairs(spark):
    return spark.createDataFrame(
        [("p", "c", "r", 0), ("q", "d", "s", 1), ("q", "e", "s", 1)],
        "prompt string, chosen string, rejected string, step bigint",
    )


@pytest.mark.parametrize("fmt", sinks.FORMATS)
def test_pairs_round_trip(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    sinks.write_pairs(pairs(spark), path, fmt=fmt)
    back = sinks.read_pairs(spark, path, fmt, pairs(spark).schema)
    routed = prep.route_by_schema(back, mine=lambda df: None)
    columns = ["prompt", "chosen", "rejected", "step"]
    assert sorted(map(tuple, routed.select(*columns).collect())) == sorted(map(tuple, pairs(spark).collect()))
    assert (tmp_path / fmt / "step=1").is_dir()


def test_one_step_is_not_spread_over_all_tasks(spark, tmp_path):
    rows = spark.range(800).selectExpr("cast(id as string) prompt", "'c' chosen", "'r' rejected", "id % 4 step")
    sinks.write_pairs(rows.repartition(8), str(tmp_path / "p"))
    assert len(list((tmp_path / "p").glob("step=*/*.parquet"))) == 4
    assert sinks.read_pairs(spark, str(tmp_path / "p")).count() == 800


def test_unknown_format_and_missing_schema(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_pairs(pairs(spark), str(tmp_path / "x"), fmt="csv")
    with pytest.raises(ValueError):
        sinks.read_pairs(spark, str(tmp_path), "json")


def test_metrics_round_trip(spark, tmp_path):
    metrics = spark.createDataFrame([(1, 0.25), (2, 0.0)], "batch_id bigint, loss double")
    sinks.write_metrics(metrics, str(tmp_path / "m"))
    back = sinks.read_metrics(spark, str(tmp_path / "m"), metrics.schema)
    assert sorted(map(tuple, back.collect())) == [(1, 0.25), (2, 0.0)]


def test_shared_folder_follows_the_session(spark):
    assert shared_folder(spark)
    assert materialise(pairs(spark)).count() == 3


def test_a_step_that_is_run_again_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "pairs")
    first = spark.createDataFrame([("p", "a", "b", 1), ("q", "c", "d", 2)], "prompt string, chosen string, rejected string, step int")
    sinks.write_pairs(first, path)
    again = spark.createDataFrame([("p", "x", "y", 1), ("r", "e", "f", 3)], first.schema)
    for _ in range(2):
        sinks.write_pairs(again, path, mode="replace_steps")
        got = sorted((r.step, r.prompt, r.chosen) for r in sinks.read_pairs(spark, path).collect())
        assert got == [(1, "p", "x"), (2, "q", "c"), (3, "r", "e")]


def test_tables_go_with_their_owner(spark, tmp_path):
    from pyspark.sql import functions as F

    from pairmine.operators import prep
    from pairmine.session import materialise, remove_folder, shared_folder, temporary_tables

    def tables():
        return set(Path(shared_folder(spark).removeprefix("file:")).glob("table-*"))

    before = tables()
    df = spark.createDataFrame([("b a c",), ("C a, b d",)], "text string")
    with temporary_tables(spark):
        assert prep.top_n_vocab(df, 2).count() == 2
        with temporary_tables(spark):
            inner = materialise(df.withColumn("n", F.lit(1)))
            assert inner.count() == 2
        assert len(tables() - before) == 1, "the inner block's table is gone, the outer one's is not"
    assert tables() == before
    remove_folder(spark, str(tmp_path / "none"))

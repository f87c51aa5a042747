"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from pairmine.llm import mixing, simhash
from tests.llm.test_native import check_shards
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_texts import plain_leaks

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert len(stages) == 5 and list(stages) == [name for name, _ in corpus_pipeline.STAGES]
    rows = {r.doc_id: r for r in docs.collect()}

    known = stages["language_id"](spark, docs, FOLDER)
    assert known.columns == columns
    ids = {r.doc_id for r in known.collect()}
    assert ids <= set(rows) and len(ids) >= 0.99 * len(rows)

    single = stages["simhash_near_dedup"](spark, known, FOLDER)
    want = set(plain_components({i: plain_fingerprint(rows[i].text) for i in ids}).values())
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(want)

    clean = stages["decontamination"](spark, single, FOLDER)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {i for i, _ in plain_leaks([(i, rows[i].text) for i in want], items)}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == want - leaks

    mixed = stages["mixing"](spark, clean, FOLDER)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns
    for r in mixing.mix(clean).collect():
        assert abs(copies[r.doc_id] * r.mix_size - r.mix_taken) <= r.mix_size / 2

    sharded = stages["sharding"](spark, mixed, FOLDER).withColumnsRenamed({"shard": "shard_no", "slot": "shard_slot"})
    check_shards(sharded.collect(), 24)
    assert Counter(r.doc_id for r in sharded.collect()) == copies


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert rows and {r.doc_id for r in rows} <= docs
    assert max(r["shard"] for r in rows) == 23


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_rows_that_tie(spark):
    """Rows without doc_id, and rows that repeat doc_id and text: the order in which they come does not matter."""
    texts = [f"{' '.join(f'w{i}x{j}' for j in range(10))}" for i in range(20)]
    schema = "doc_id long, text string, source string"
    rows = [(None, t, "ab"[i % 2]) for i, t in enumerate(texts)]
    taken = [
        sorted((r.text, r.mix_taken) for r in mixing.mix(spark.createDataFrame(given, schema), total=90.0).collect())
        for given in (rows, rows[::-1], rows[7:] + rows[:7])
    ]
    assert taken[0] == taken[1] == taken[2] and 0 < sum(n for _, n in taken[0]) < 100
    twice = [(1, "one two three four", "b"), (1, "one two three four", "a"), (1, "one two three four", None)]
    kept = {tuple(map(tuple, simhash.one_of_each(spark.createDataFrame(given, schema)).collect())) for given in (twice, twice[::-1], twice[1:] + twice[:1])}
    assert len(kept) == 1 and len(kept.pop()) == 1


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1)], "doc_id long, text string, simhash_id string, simhash_rest int")
    assert list(map(tuple, simhash.one_of_each(docs).collect())) == [(1, "a b", "x", 1)]

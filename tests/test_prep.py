from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairmine.operators import prep
from pairmine.schemas import PROMPTS, require


def test_repeat_prompts(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], PROMPTS)
    rows = prep.repeat_prompts(df, 3).collect()
    assert sorted((r.prompt_id, r["copy"]) for r in rows) == [(p, c) for p in (1, 2) for c in range(3)]
    assert prep.repeat_prompts(df, 0).count() == 0


def test_repeat_prompts_very_often_is_spread(spark, monkeypatch):
    monkeypatch.setattr(prep, "_COPIES_PER_ROW", 10)
    df = spark.createDataFrame([(1, "a")], PROMPTS)
    rows = prep.repeat_prompts(df, 57).collect()
    assert sorted(r["copy"] for r in rows) == list(range(57))


@pytest.mark.parametrize("base, count", [(3, 8), (20, 16), (512, 512), (0, 8)])
def test_aligned_count(base, count):
    assert prep.aligned_count(base, 1, 8) == count


@pytest.mark.parametrize("rows, base, count", [(100, 20, 16), (100, 3, 8), (100, None, 96), (5, 20, 16), (5, None, 8)])
def test_align_to_batch(spark, rows, base, count):
    df = spark.range(rows).select((F.col("id") * 7 % 101).alias("key")).repartition(5)
    got = prep.align_to_batch(df, "key", base, 2, 4).orderBy("idx").collect()
    keys = sorted(r.key for r in df.collect())
    assert [r.idx for r in got] == list(range(count))
    assert [r.key for r in got] == [keys[i % rows] for i in range(count)]
    assert [r.batch_id for r in got] == [i // 2 for i in range(count)]
    assert [r.step for r in got] == [i // 8 for i in range(count)]


def test_align_to_batch_repeats_a_single_prompt(spark, monkeypatch):
    monkeypatch.setattr(prep, "_COPIES_PER_ROW", 10)
    df = spark.createDataFrame([(1,)], "key bigint")
    got = prep.align_to_batch(df, "key", 100, 1, 8).collect()
    assert sorted(r.idx for r in got) == list(range(96))


def test_align_to_batch_takes_any_key_that_has_an_order(spark, monkeypatch):
    monkeypatch.setattr(prep, "_RANGE_ROWS", 7)
    df = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) AS key FROM range(20)").repartition(3)
    got = prep.align_to_batch(df, "key", 8, 1, 8).orderBy("idx").collect()
    assert [r.key.day for r in got] == list(range(1, 9))
    words = [f"{w}{i}" for w in ("b", "é", "", "aa", "Z") for i in range(9)]
    text = spark.createDataFrame([(w,) for w in words], "key string").repartition(4)
    got = prep.align_to_batch(text, "key", None, 1, 8).orderBy("idx").collect()
    assert [r.key for r in got] == sorted(words, key=lambda w: w.encode())[:40]
    both = text.select(F.length("key").alias("a"), F.col("key").alias("b"))
    got = prep.align_to_batch(both, ["a", "b"], 100, 2, 8).orderBy("idx").collect()
    want = sorted(words, key=lambda w: (len(w), w.encode()))
    assert [(r.idx, r.b, r.step) for r in got] == [(i, want[i % 45], i // 16) for i in range(96)]
    with pytest.raises(TypeError):
        prep.align_to_batch(df.select(F.create_map("key", "key").alias("key")), "key", 8, 1, 8)


@pytest.mark.parametrize("rows, kind", [([(1.0,), (None,)], "double"), ([(1.0,), (float("nan"),)], "double"), ([("a",), (None,)], "string"), ([(None,)], "date")])
def test_align_to_batch_needs_all_keys(spark, rows, kind):
    with pytest.raises(ValueError, match="missing values"):
        prep.align_to_batch(spark.createDataFrame(rows, f"key {kind}"), "key", 8, 1, 8)


def test_align_to_batch_of_an_empty_table(spark):
    assert prep.align_to_batch(spark.createDataFrame([], "key string"), "key", 8, 1, 8).count() == 0


def test_route_by_schema(spark):
    mine, ready = (lambda df: "mine"), (lambda df: "ready")
    assert prep.route_by_schema(spark.range(1).select(F.lit("p").alias("prompt")), mine, ready) == "mine"
    pairs = spark.createDataFrame([("p", "c", "r")], "prompt string, chosen string, rejected string")
    assert prep.route_by_schema(pairs, mine, ready) == "ready"
    assert prep.route_by_schema(pairs, mine).collect() == pairs.collect()
    assert prep.route_by_schema(spark.range(1), mine, ready) == "ready"
    with pytest.raises(ValueError):
        prep.route_by_schema(spark.range(1).select(), mine, ready)


def test_collate_to_longest(spark):
    df = spark.createDataFrame([(1, [1]), (1, [1, 2, 3]), (2, [5]), (None, [7, 8]), (None, [])], "b int, ids array<bigint>")
    got = prep.collate_to_longest(df, "b", "ids", 9).collect()
    assert sorted((r.ids, r.mask) for r in got) == sorted(
        [([1, 9, 9], [1, 0, 0]), ([1, 2, 3], [1, 1, 1]), ([5], [1]), ([7, 8], [1, 1]), ([9, 9], [0, 0])]
    )


def test_collate_keeps_a_given_mask(spark):
    df = spark.createDataFrame([(1, [1, 0], [1, 0]), (1, [1, 2, 3], [1, 1, 1])], "b int, ids array<bigint>, mask array<int>")
    got = prep.collate_to_longest(df, "b", "ids", 9).collect()
    assert sorted(r.mask for r in got) == [[1, 0, 0], [1, 1, 1]]


def test_gazetteer(spark):
    a = spark.createDataFrame([("Ann",), ("Bob",)], "word string")
    b = spark.createDataFrame([("bob",)], "word string")
    empty = a.limit(0)
    assert sorted(r.word for r in prep.gazetteer(a, b).collect()) == ["ann", "bob"]
    with pytest.raises(ValueError):
        prep.gazetteer(empty)
    assert prep.gazetteer(empty, allow_empty=True).count() == 0
    assert prep.gazetteer(empty, b).count() == 1


def test_top_n_vocab_breaks_ties_by_word(spark):
    df = spark.createDataFrame([("b a c",), ("C a, b d",)], "text string")
    got = [(r.word, r.n) for r in prep.top_n_vocab(df, 3).collect()]
    assert got == [("a", 2), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 120, 121, 200])
def test_top_n_vocab_finds_the_cut_by_beginnings(spark, monkeypatch, n):
    monkeypatch.setattr(prep, "_SORT_ROWS", 3)
    words = sorted({"a" * i for i in range(1, 30)} | {f"{x}{y}" for x in "abcé" for y in ("", "a", "bb", "bbb", "éa", "z")} | {"b" + "c" * 20 + x for x in "pqrs"}, key=str.encode)
    df = spark.createDataFrame([(" ".join(words[i::3]),) for i in range(3)] + [("zz zz",)], "text string")
    got = [(r.word, r.n) for r in prep.top_n_vocab(df, n).collect()]
    assert got == ([("zz", 2)] + [(w, 1) for w in words])[:n]


def test_top_n_vocab_of_a_million_words_that_occur_once(spark):
    letters = F.translate(F.lpad(F.conv(F.col("id"), 10, 16), 8, "0"), "0123456789", "ghijklmnop")
    df = spark.range(1_000_000).select(F.lower(letters).alias("text"))
    words = prep.top_n_vocab(df, 400_000, ordered=False)
    assert words.count() == 400_000
    digits = "abcdefghijklmnop"
    want = sorted("".join("ghijklmnopabcdef"[int(c, 16)] for c in f"{i:08x}") for i in range(1_000_000))[399_999]
    assert words.agg(F.max("word")).first()[0] == want and set(want) <= set(digits)
    plan = words._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan or "limit=400000" not in plan


def test_require(spark):
    with pytest.raises(ValueError, match="missing"):
        require(spark.range(1), "word")

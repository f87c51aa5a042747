from __future__ import annotations

from pyspark.sql import functions as F

from pairmine.plans import mining
from pairmine.schemas import COMPLETIONS, LEXICON


def test_completions_to_pairs(spark):
    samples = {
        1: ["A tree.", "the Sea", "running", "tree!", "", "Rose"],
        2: ["tree", "sea"],
        3: ["", "..."],
    }
    completions = spark.createDataFrame([(p, i, t) for p, ts in samples.items() for i, t in enumerate(ts)], COMPLETIONS)
    lexicon = spark.createDataFrame([("tree", "n"), ("sea", "n"), ("running", "v"), ("rose", "n")], LEXICON)
    names = spark.createDataFrame([("rose",)], "word string")
    vectors = spark.createDataFrame(
        [("tree", [1.0, 0.0]), ("sea", [0.0, 1.0]), ("running", [1.0, 1.0]), ("rose", [1.0, 0.2])],
        "word string, embedding array<float>",
    )
    got = mining.pairs_from_completions(completions, vectors, lexicon=lexicon, gazetteer=names)
    assert [(r.prompt_id, r.chosen, r.chosen_idx, r.rejected, r.rejected_idx) for r in got.collect()] == [
        (1, "sea", 1, "rose", 5)
    ]
    short = mining.pairs_from_completions(
        completions, vectors, 3, F.length, lexicon=lexicon, gazetteer=names
    )
    assert short.count() == 0
    custom = mining.pairs_from_completions(
        completions, vectors, rules=lambda w: F.when(w == "tree", 1.0).otherwise(0.0)
    )
    assert {r.prompt_id: r.chosen for r in custom.collect()} == {1: "tree", 2: "tree"}


def test_a_prompt_with_a_third_of_all_samples(spark):
    """Split into blocks or not, the pairs are the same, and the large prompt has its own."""
    completions = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200 + 1).alias("prompt_id"),
        F.col("id").cast("int").alias("sample_idx"),
        F.concat(F.lit("say word"), F.col("id") % 1500).alias("text"),
    )

    def embed(words):
        parts = [(F.xxhash64("word", F.lit(i)) % 1000 / 1000).cast("float") for i in range(8)]
        return words.withColumn("embedding", F.array(*parts))

    def rule(word):
        return (F.xxhash64(word) % 2 == 0).cast("double")

    found = [
        sorted(map(tuple, mining.pairs_from_completions(completions, embed, rules=rule, block_rows=n).collect()))
        for n in (100, 4096)
    ]
    assert found[0] == found[1]
    assert found[0][0][0] == 0
    assert len(found[0]) > 100

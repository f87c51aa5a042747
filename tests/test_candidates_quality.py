from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairmine.functions.text import EMPTY_MARK
from pairmine.operators import candidates as cd
from pairmine.operators import quality as ql
from pairmine.schemas import COMPLETIONS, LEXICON


def completions(spark, *texts, prompt=1):
    return spark.createDataFrame([(prompt, i, t) for i, t in enumerate(texts)], COMPLETIONS)


def words(spark, *given):
    return spark.createDataFrame([(1, w) for w in given], "prompt_id bigint, word string")


def test_expand_samples(spark):
    df = cd.expand_samples(spark.createDataFrame([(7,)], "prompt_id bigint"), 4)
    assert sorted((r.prompt_id, r.sample_idx) for r in df.collect()) == [(7, i) for i in range(4)]
    with pytest.raises(ValueError):
        cd.expand_samples(df, 0)


def test_normalise_train_and_dedupe(spark):
    got = cd.dedupe_keep_first(cd.normalise(completions(spark, "Echo", "", "an echo"))).collect()
    assert [(r.word, r.sample_idx) for r in got] == [("echo", 0)]


def test_normalise_eval(spark):
    got = cd.normalise(completions(spark, "", "...", "An ECHO!"), "eval").orderBy("sample_idx").collect()
    assert [r.word for r in got] == [EMPTY_MARK, "", "echo"]
    with pytest.raises(ValueError):
        cd.normalise(completions(spark, ""), "other")


def test_candidate_census(spark):
    prompts = spark.createDataFrame([(1,), (2,), (3,)], "prompt_id bigint")
    samples = completions(spark, "a", "A", "b!", "", "...").unionByName(completions(spark, "", "!", prompt=2))
    got = {r.prompt_id: r for r in cd.candidate_census(prompts, samples).collect()}
    assert tuple(got[1])[1:] == (5, 3, 2, "ok")
    assert tuple(got[2])[1:] == (2, 0, 0, "no words")
    assert tuple(got[3])[1:] == (0, 0, 0, "no completions")


def lists(spark):
    lexicon = spark.createDataFrame([("tree", "n"), ("run", "v"), ("rose", "n")], LEXICON)
    names = spark.createDataFrame([("rose",), ("ann",)], "word string")
    return lexicon, names


def test_lexicon_rules(spark):
    lexicon, names = lists(spark)
    df = words(spark, "tree", " Tree ", "run", "rose", "ann", "oak", "ice cream", "well-being", "")
    got = {r.word: (r.quality, r.reason) for r in ql.quality_score(df, lexicon=lexicon, gazetteer=names).collect()}
    assert got == {
        "tree": (1.0, "ok"), " Tree ": (1.0, "ok"), "run": (0.0, "not noun"), "rose": (0.0, "known name"),
        "ann": (0.0, "not noun"), "oak": (0.0, "not noun"), "ice cream": (0.0, "format"),
        "well-being": (0.0, "format"), "": (0.0, "format"),
    }


def test_single_rules_keep_every_row(spark):
    lexicon, names = lists(spark)
    df = words(spark, "tree", "rose", "oak", "oak")
    assert {r.word: r.is_noun for r in ql.lexicon_noun(df, lexicon).collect()} == {"tree": True, "rose": True, "oak": False}
    assert {r.word: r.not_a_name for r in ql.not_in_gazetteer(df, names).collect()} == {"tree": True, "rose": False, "oak": True}
    assert ql.in_common_vocab(df, names).count() == 4


def test_a_word_listed_twice_is_an_error(spark):
    lexicon, names = lists(spark)
    twice = lexicon.unionByName(lexicon)
    with pytest.raises(Exception, match="twice"):
        ql.lexicon_noun(words(spark, "tree"), twice).collect()
    with pytest.raises(Exception, match="twice"):
        ql.quality_score(words(spark, "tree"), lexicon=twice, gazetteer=names).collect()


def test_tag_rule(spark):
    tags = spark.createDataFrame(
        [("Table", "NN"), ("table", "NN"), ("London", "NNP"), ("tables", "NNS"), ("I", "NN")], "word string, tag string"
    )
    df = words(spark, "Table", "table", "London", "tables", "I", "unknown")
    got = {r.word: r.tag_ok for r in ql.tag_rule(df, tags).collect()}
    assert got == {"Table": False, "table": True, "London": False, "tables": False, "I": True, "unknown": False}


def test_common_rules(spark):
    tags = spark.createDataFrame([("tree", "NN"), ("Tree", "NN"), ("trees", "NNS")], "word string, tag string")
    common = spark.createDataFrame([("tree",), ("trees",)], "word string")
    got = ql.quality_score(words(spark, "tree", "Tree", "trees", "oak", "a-b"), "common", common=common, tags=tags)
    assert {r.word: r.reason for r in got.collect()} == {
        "tree": "ok", "Tree": "tag", "trees": "tag", "oak": "not common", "a-b": "format"
    }


def test_custom_rule_and_reasons(spark):
    scored = ql.quality_score(words(spark, "aa", "b", "cc"), lambda w: (F.length(w) > 1).cast("double"))
    assert {r.reason: r.n for r in ql.quality_reasons(scored).collect()} == {"ok": 2, "custom rule": 1}


def test_unknown_rules_and_missing_lists(spark):
    with pytest.raises(ValueError):
        ql.quality_score(words(spark, "a"), "other")
    with pytest.raises(ValueError):
        ql.quality_score(words(spark, "a"), "lexicon")
    with pytest.raises(ValueError):
        ql.quality_score(words(spark, "a"), "common")


def test_pandas_udf_as_rule(spark):
    @F.pandas_udf("double")
    def rule(w: pd.Series) -> pd.Series:
        return (w.str.len() > 1).astype("float64")

    got = ql.quality_score(words(spark, "aa", "b"), rule).collect()
    assert {r.word: r.quality for r in got} == {"aa": 1.0, "b": 0.0}


def test_popular_word_is_split(spark):
    """95 % of the rows have one word; without broadcasts the join must be a skewed one."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        word = F.when(F.col("id") % 20 != 0, "rose").otherwise(F.concat(F.lit("w"), F.col("id") % 500))
        df = spark.range(0, 400_000, 1, 8).select(F.col("id").alias("sample_idx"), word.alias("word"))
        lexicon = df.select("word").distinct().withColumn("first_pos", F.lit("n"))
        flagged = ql.lexicon_noun(df, lexicon)
        flagged.write.format("noop").mode("overwrite").save()
        flagged.collect()
        assert "skew=true" in flagged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lists_may_be_written_in_capitals(spark):
    df = spark.createDataFrame([("rose",), ("Tulip",)], "word string")
    names = spark.createDataFrame([("Rose",)], "word string")
    assert [r.not_a_name for r in ql.not_in_gazetteer(df, names).orderBy("word").collect()] == [True, False]

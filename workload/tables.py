"""The logical tables, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairmine.functions import text as tx
from pairmine.operators import prep
from pairmine.plans import mining
from pairmine.sources.tables import table

# Tokens of a word in the length limit: its vowel groups and one more.
VOWELS = "[aeiouyàâäéèêëîïôöùûü]+"
MAX_TOKENS = 4


def prompts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(
        F.col("item_id").alias("prompt_id"), F.col("text").alias("prompt")
    )


def completions(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as the samples of a prompt."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return docs.select(
        F.col("doc_id").alias("prompt_id"),
        "lang",
        F.posexplode(F.split("text", "\n")).alias("sample_idx", "text"),
    )


def written_words(spark: SparkSession, d: str) -> DataFrame:
    """Unique candidate words as written, per prompt."""
    words = completions(spark, d).select("prompt_id", tx.last_word(F.col("text")).alias("word"))
    return words.filter(F.col("word") != "").distinct()


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return mining.unique_candidates(completions(spark, d).drop("lang"))


def lexicon(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "benchmark", "text").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")
    )
    unique = words.select(F.lower("word").alias("word")).distinct()
    pos = F.when(F.length("word") % 2 == 0, "n").otherwise("v")
    return unique.withColumn("first_pos", pos)


def name_lists(spark: SparkSession, d: str) -> list[DataFrame]:
    """Capitalised words of the benchmark, and the nation names."""
    capitals = table(spark, d, "benchmark", "text").select(
        F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Za-z]*"), F.lit(0))).alias("word")
    )
    nations = table(spark, d, "nation").select(F.col("n_name").alias("word"))
    return [capitals, nations]


def names(spark: SparkSession, d: str) -> DataFrame:
    return prep.gazetteer(*name_lists(spark, d))


def tags(spark: SparkSession, d: str) -> DataFrame:
    return tags_of(written_words(spark, d))


def tags_of(written: DataFrame) -> DataFrame:
    """A tag per written word, by its length."""
    words = written.select("word").distinct()
    rest = F.length("word") % 4
    tag = F.when(rest == 1, "NNP").when(rest == 2, "NNS").otherwise("NN")
    return words.withColumn("tag", tag)


def word_vectors(spark: SparkSession, d: str):
    """Stands for an embedding model: from distinct words to their vectors.

    A word's vector is picked among all there are, whose ids count from 0, by a hash of the word.
    """
    vectors = table(spark, d, "embeddings", "vec_id", "embedding")
    number = F.conv(F.left(F.md5("word"), F.lit(8)), 16, 10).cast("bigint") % vectors.count()

    def embed(words: DataFrame) -> DataFrame:
        return words.withColumn("vec_id", number).join(vectors, "vec_id").select("word", "embedding")

    return embed


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors grouped by label; the vector id is candidate, index and word."""
    return table(spark, d, "embeddings").select(
        F.col("label").alias("prompt_id"), F.col("vec_id").alias("sample_idx"),
        F.col("vec_id").cast("string").alias("word"), "embedding",
    )


def vector_quality(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels", "doc_id", "quality")
    return vectors(spark, d).join(
        labels.select(F.col("doc_id").alias("sample_idx"), F.col("quality").cast("double").alias("quality")),
        "sample_idx",
        "left",
    )


def token_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", word_lengths("text").alias("ids"))


def word_lengths(text: str):
    return F.transform(F.split(text, " "), lambda w: F.length(w).cast("bigint"))


def pair_logps(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as the pairs of a batch; a line without discount lacks a log-probability."""
    lines = table(
        spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return lines.select(
        F.col("l_orderkey").alias("batch_id"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (-F.ln(1 + F.col("l_quantity"))).alias("policy_chosen"),
        (-F.ln("l_extendedprice") / 3).alias("policy_rejected"),
        F.when(F.col("l_discount") > 0, F.ln("l_discount")).alias("ref_chosen"),
        (-F.ln(2 + 100 * F.col("l_tax"))).alias("ref_rejected"),
    )


def batches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("batch_id"), F.lit(14).alias("batch_size")
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Words generated per language, cleaned as in evaluation."""
    from pairmine.operators.candidates import normalise

    cleaned = normalise(completions(spark, d), "eval")
    return cleaned.select(F.col("lang").alias("run"), "sample_idx", "word")


def vector_runs(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select(
        F.col("prompt_id").cast("string").alias("run"), "sample_idx", "word", "embedding"
    )


def events(spark: SparkSession, d: str, stream: bool = False) -> DataFrame:
    """Events with their time as an instant, as a table or as a stream."""
    path = f"{d}/events.parquet"
    table_now = spark.read.parquet(path)
    fields = [
        T.StructField("ts", T.TimestampType()) if f.name == "ts" else f
        for f in table_now.schema.fields
    ]
    schema = T.StructType(fields)
    if not stream:
        return spark.read.schema(schema).parquet(path)
    reader = spark.readStream.schema(schema)
    if table_now.inputFiles()[0].endswith("/events.parquet"):
        # a stream reads folders: the one file is picked out of its folder
        return reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return reader.parquet(path)


def event_completions(events: DataFrame) -> DataFrame:
    """Events as samples: the user is the prompt, the number in ``props`` the last word."""
    number = F.regexp_extract("props", r"(\d+)", 1)
    return events.select(
        "ts",
        F.col("user_id").alias("prompt_id"),
        F.col("event_id").alias("sample_idx"),
        F.concat(F.col("event_type"), F.lit(' "'), number, F.lit('".')).alias("text"),
    )


def event_prompts(events: DataFrame, *more: str) -> DataFrame:
    """Events as prompts of a step, with ``more`` of their columns; an ``error`` event has no pair."""
    found = F.col("event_type") != "error"
    return events.select(
        "ts",
        *more,
        F.when(found, -F.ln(1 + F.abs("value"))).alias("policy_chosen"),
        F.when(found, -F.ln(3 + F.col("user_id"))).alias("policy_rejected"),
        F.when(found, -F.ln(F.length("event_type"))).alias("ref_chosen"),
        F.when(found, -F.ln(F.length("props"))).alias("ref_rejected"),
    )

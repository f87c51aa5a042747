"""A corpus pipeline: five stages from raw documents to shards.

Each stage takes (spark, docs, sf_dir) and gives the documents that it keeps; ``run`` writes each stage's documents as
Parquet to the shared folder and reads them again for the next, so that a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.llm import decontam, langid, mixing, sharding, simhash
from pairmine.llm.common import held_out
from pairmine.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language identifier rejects go: without a letter, or far from all it has learned."""
    model = langid.train(docs.filter(~held_out("doc_id", 4)))
    return langid.keep_known(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by SimHash, the one with the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights; a document comes as often as it is taken."""
    return mixing.repeat_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot; every shard has the mixture of the whole."""
    return sharding.interleave(docs).withColumnsRenamed({"shard_no": "shard", "shard_slot": "slot"})


STAGES = [
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Language identification and SimHash have no SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).select(
        "doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"), "shard", "slot"
    )

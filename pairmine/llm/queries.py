"""One query per operator over the test tables, with production parameters and whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.llm import decontam, html, imatch, langid, lines, mixing, ngram, periodic, quality, secrets, sharding, simhash, whitening
from pairmine.llm.common import held_out, whole, word_count, words
from pairmine.session import materialise, shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = whole("text")
    slim = materialise(docs.select("doc_id", "source", word_count(text).alias("size"), F.xxhash64(text).alias("mark")))
    return mixing.mix(slim, size=F.col("size"), mark=F.col("mark")).select(
        "doc_id",
        "size",
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        F.col("mix_taken").alias("taken"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_extract_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("mark")


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4))
    model = langid.train(docs.filter(~F.col("held_out")))
    told = langid.predict(docs.select("doc_id", "text", "held_out"), model)
    return told.select(
        "doc_id",
        "held_out",
        F.col("langid_pred").alias("lang_pred"),
        F.col("langid_score").alias("score"),
        F.col("langid_rejected").alias("rejected"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").filter(~held_out("doc_id", 4))
    rated = quality.rate(
        _table(spark, sf_dir, "documents"), labels.select("doc_id", F.col("quality").alias("label"))
    )
    return rated.select(
        "doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sized(_table(spark, sf_dir, "documents"))
    slim = materialise(docs.select("doc_id", "source", "size", "text_crc32"))
    return sharding.interleave(slim, key=("doc_id", "text_crc32")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard_no").alias("shard"),
        F.col("shard_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_trie_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ngram.train(docs.filter(~held_out("doc_id", 7)), min_count=1)
    return ngram.score(docs, model).select(
        "doc_id",
        held_out("doc_id", 7).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def _listed(spans: Column) -> Column:
    """Findings as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    found = secrets.scan(_table(spark, sf_dir, "documents"), folder)
    kinds = F.transform("findings", lambda s: s["rule"])
    counts = [
        (F.size("findings") - F.size(F.array_remove(kinds, rule.name))).cast("long").alias(f"n_{rule.name}")
        for rule in secrets.RULES
    ]
    listed = _listed(F.col("findings"))
    return found.select("doc_id", *counts, F.sha2(listed, 256).alias("base_sha256"), listed.alias("spans"))


def _periodic_edit(docs: DataFrame) -> DataFrame:
    """One document of ten, by its doc_id, repeats a part of its words up to its end; none without doc_id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    edited = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(whole("text"))).alias("ws"))
    n = F.size("ws")
    at = (F.col("g") % F.greatest(n, F.lit(1))).cast("int")
    period = (1 + F.floor((n - at) / (3 + F.col("g") % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice("ws", at + 1, period), F.ceil((n - at) / period).cast("int")))
    text = F.array_join(F.concat(F.slice("ws", 1, at), F.slice(again, 1, n - at)), " ")
    return edited.select("doc_id", F.when(F.col("ws").isNull(), F.col("text")).otherwise(text).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_periodic_edit(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = found.select("doc_id", "runs", "collapsed", periodic.strongest().alias("best"))
    start, length, period = (F.col(f"best.{c}").cast("long") for c in ("start", "length", "period"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model)
    explained = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    long = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, "at").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_imatch_fingerprints,
        op2_mix_sources,
        op3_line_dedup,
        op4_extract_main_text,
        op5_decontaminate,
        op6_simhash_near_duplicates,
        op7_language_id,
        op8_quality_rules,
        op9_interleaved_shards,
        op10_trie_language_model,
        op11_secret_ledger,
        op12_periodic_runs,
        op13_whitened_embeddings,
    )
    return {f.__name__: f for f in found}

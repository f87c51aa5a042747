"""One query per operator, each over whole test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.functions import arrays as ar
from pairmine.functions import chat
from pairmine.functions import preference as pf
from pairmine.functions import text as tx
from pairmine.functions import vectors as vc
from pairmine.functions.vectors import round6
from pairmine.operators import candidates as cd
from pairmine.operators import diversity as dv
from pairmine.operators import evaluation as ev
from pairmine.operators import metrics as mt
from pairmine.operators import pairs as pr
from pairmine.operators import prep
from pairmine.operators import quality as ql
from pairmine.plans import comparison, mining, steps
from pairmine.session import materialise, shared_folder
from pairmine.settings import DEFAULTS
from pairmine.sources import sinks
from pairmine.sources.tables import table
from pairmine.streaming import metrics as sm
from pairmine.streaming import pairs as sp
from workload import tables as tb

Query = Callable[[SparkSession, str], DataFrame]

BASE_PROMPTS, DEVICE_BATCH = DEFAULTS.base_prompts, DEFAULTS.device_batch
ACCUMULATION = DEFAULTS.accumulation
COMMON_WORDS = DEFAULTS.common_words
PROMPT_LENGTH = DEFAULTS.max_prompt_length


def _joined(column):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round6(F.col(c)) for c in columns})


# --- A: prompts and batches


def a1_repeat_prompts(spark, d):
    return prep.repeat_prompts(tb.prompts(spark, d), 8)


def _aligned(spark, d, base, device_batch):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return prep.align_to_batch(orders, "o_orderkey", base, device_batch, ACCUMULATION)


def a2_align_to_batch(spark, d):
    return _aligned(spark, d, BASE_PROMPTS, DEVICE_BATCH)


def a2_align_small_base(spark, d):
    return _aligned(spark, d, 3, DEVICE_BATCH)


def a2_align_whole_table(spark, d):
    return _aligned(spark, d, None, 2)


def a2_align_repeating(spark, d):
    items = tb.prompts(spark, d).select("prompt_id")
    return prep.align_to_batch(items, "prompt_id", BASE_PROMPTS, DEVICE_BATCH, ACCUMULATION)


def a2_align_string_key(spark, d):
    names = table(spark, d, "customer", "c_name", "c_custkey")
    return prep.align_to_batch(names, "c_name", None, 2, ACCUMULATION)


def a2_align_composite_key(spark, d):
    orders = table(spark, d, "orders", "o_orderpriority", "o_orderkey")
    return prep.align_to_batch(orders, ["o_orderpriority", "o_orderkey"], None, 2, ACCUMULATION)


def _rendered(prompts: DataFrame) -> DataFrame:
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("text"))
    text = chat.render_chat(F.array(message), F.col("prompt"))
    return prompts.select("prompt_id", F.lit("mine").alias("route"), text.alias("text"))


def _ready(pairs: DataFrame) -> DataFrame:
    text = F.concat_ws("|", "chosen", "rejected")
    return pairs.select("prompt_id", F.lit("ready").alias("route"), text.alias("text"))


def a3_route_prompts(spark, d):
    return prep.route_by_schema(tb.prompts(spark, d), _rendered, _ready)


def a3_route_pairs(spark, d):
    pairs = e4_mine_pairs(spark, d).withColumn("prompt", F.col("prompt_id").cast("string"))
    return prep.route_by_schema(pairs, _rendered, _ready)


def _with_previous(spark, d):
    turns = table(spark, d, "conversations")
    before = turns.select(
        "conv_id", (F.col("turn") + 1).alias("turn"),
        F.col("role").alias("role_before"), F.col("text").alias("text_before"),
    )
    return turns.join(before, ["conv_id", "turn"], "left")


def a4_render_chat(spark, d):
    """Each turn after the one before it; a chat with a system turn falls back to the raw text."""
    now = F.struct("role", "text")
    before = F.struct(F.col("role_before").alias("role"), F.col("text_before").alias("text"))
    messages = F.when(F.col("role_before").isNull(), F.array(now)).otherwise(F.array(before, now))
    template = chat.ChatTemplate(roles=("user", "assistant"))
    rendered = chat.render_chat(messages, F.col("text"), template)
    return _with_previous(spark, d).select("conv_id", "turn", rendered.alias("prompt"))


def a5_fixed_length_ids(spark, d):
    ids = F.col("ids")
    return tb.token_rows(spark, d).select(
        "doc_id",
        _joined(ar.fixed_length_ids(ids, PROMPT_LENGTH, 0, "left")).alias("ids_left"),
        _joined(ar.fixed_length_mask(ids, PROMPT_LENGTH, "left")).alias("mask_left"),
        _joined(ar.fixed_length_ids(ids, PROMPT_LENGTH, 0, "right")).alias("ids_right"),
        _joined(ar.fixed_length_mask(ids, PROMPT_LENGTH, "right")).alias("mask_right"),
    )


def a6_prompt_length(spark, d):
    """Pad id 2 also occurs as an id, so that the two sides differ."""
    rows = tb.token_rows(spark, d)
    padded = rows.select(
        "doc_id",
        *[ar.fixed_length_ids(F.col("ids"), PROMPT_LENGTH, 2, s).alias("ids_" + s) for s in ar.SIDES],
        *[ar.fixed_length_mask(F.col("ids"), PROMPT_LENGTH, s).alias("mask_" + s) for s in ar.SIDES],
    )
    return padded.select(
        "doc_id",
        *[
            ar.prompt_length(F.col("ids_" + s), F.col("mask_" + s), 2, s).alias("length_" + s)
            for s in ar.SIDES
        ],
    )


def a7_collate_to_longest(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", tb.word_lengths("text").alias("ids"))
    collated = prep.collate_to_longest(rows, "conv_id", "ids", 0)
    return collated.select(
        "conv_id", "turn", _joined(F.col("ids")).alias("ids"), _joined(F.col("mask")).alias("mask")
    )


def a8_gazetteer(spark, d):
    return tb.names(spark, d)


def a9_top_n_vocab(spark, d):
    return prep.top_n_vocab(table(spark, d, "documents", "text"), COMMON_WORDS)


# --- B: candidates


def b1_expand_samples(spark, d):
    return cd.expand_samples(tb.prompts(spark, d), DEFAULTS.samples_per_prompt)


def _echoed(spark, d):
    turns = _with_previous(spark, d).filter(F.col("text_before").isNotNull())
    kind = F.col("conv_id") % 3
    output = (
        F.when(kind == 0, F.concat_ws(" ", "text_before", "text"))
        .when(kind == 1, F.concat_ws(" ", "text", "text_before"))
        .otherwise(F.col("text"))
    )
    return turns.withColumn("output", output)


def b2_strip_prompt_echo(spark, d):
    """Outputs that begin with the prompt, end with it, or do not hold it."""
    answer = tx.strip_prompt_echo(F.col("output"), F.col("text_before"))
    return _echoed(spark, d).select("conv_id", "turn", answer.alias("answer"))


def b3_last_word(spark, d):
    return tb.completions(spark, d).select(
        "prompt_id", "sample_idx", tx.last_word(F.col("text")).alias("word")
    )


def b4_normalise_train(spark, d):
    words = cd.normalise(tb.completions(spark, d), "train")
    return words.select("prompt_id", "sample_idx", "word")


def b4_normalise_eval(spark, d):
    words = cd.normalise(tb.completions(spark, d), "eval")
    return words.select("prompt_id", "sample_idx", "word")


def b5_dedupe_keep_first(spark, d):
    return tb.candidates(spark, d)


def b6_candidate_census(spark, d):
    prompts = table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").alias("prompt_id"))
    return cd.candidate_census(prompts, tb.completions(spark, d))


# --- C: quality


def c1_format_ok(spark, d):
    part = table(spark, d, "part", "p_name", "p_brand")
    orders = table(spark, d, "orders", "o_orderpriority")
    words = (
        part.select(F.explode(F.array("p_name", "p_brand")).alias("word"))
        .unionByName(orders.select(F.col("o_orderpriority").alias("word")))
    )
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("format_ok", tx.format_ok(F.col("word")))


def c2_lexicon_noun(spark, d):
    words = tb.candidates(spark, d)
    return ql.lexicon_noun(words, tb.lexicon(spark, d)).select("prompt_id", "word", "is_noun")


def c3_not_in_gazetteer(spark, d):
    words = tb.candidates(spark, d)
    return ql.not_in_gazetteer(words, tb.names(spark, d)).select("prompt_id", "word", "not_a_name")


def _common(spark, d):
    return prep.top_n_vocab(table(spark, d, "documents", "text"), COMMON_WORDS, ordered=False).select("word")


def c4_in_common_vocab(spark, d):
    words = tb.candidates(spark, d)
    return ql.in_common_vocab(words, _common(spark, d)).select("prompt_id", "word", "is_common")


def c5_tag_rule(spark, d):
    return ql.tag_rule(tb.written_words(spark, d), tb.tags(spark, d))


def _scored(spark, d):
    return ql.quality_score(
        tb.candidates(spark, d), "lexicon", lexicon=tb.lexicon(spark, d), gazetteer=tb.names(spark, d)
    )


def c6_quality_lexicon(spark, d):
    return _scored(spark, d).select("prompt_id", "word", "quality", "reason")


def c6_quality_common(spark, d):
    words = materialise(tb.written_words(spark, d))  # the tags are of the same words
    return ql.quality_score(words, "common", common=_common(spark, d), tags=tb.tags_of(words)).select(
        "prompt_id", "word", "quality", "reason"
    )


def c6_quality_custom(spark, d):
    """A rule given as a function: words with a vowel at the end are good."""
    rule = lambda word: F.when(F.right(word, F.lit(1)).isin(*"aeiou"), 1.0).otherwise(0.5)
    return ql.quality_score(tb.candidates(spark, d), rule).select("prompt_id", "word", "quality", "reason")


def c7_quality_reasons(spark, d):
    return ql.quality_reasons(_scored(spark, d))


# --- D: embeddings and diversity


def d1_attach_embeddings(spark, d):
    """Labelled documents as candidates; those without a vector stay, with size -1."""
    labelled = table(spark, d, "labels", "doc_id").select(F.col("doc_id").cast("string").alias("word"))
    vectors = tb.vectors(spark, d).select("word", "embedding")
    joined = dv.attach_embeddings(labelled, vectors)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return joined.select(
        "word",
        F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"),
        round6(F.coalesce(total, F.lit(0.0))).alias("total"),
    )


def d2_l2_normalise(spark, d):
    unit = tb.vectors(spark, d).select("sample_idx", F.posexplode(vc.l2_normalise(F.col("embedding"))).alias("dim", "x"))
    return _rounded(unit, "x")


def d3_similarity_profile(spark, d):
    profile = dv.similarity_profile(tb.vectors(spark, d)).drop("word")
    return _rounded(profile, "max_sim", "min_positive_sim")


def d3_blocks(spark, d):
    """All vectors as one group, in several blocks."""
    vectors = tb.vectors(spark, d).withColumn("prompt_id", F.lit(0))
    profile = dv.similarity_profile(vectors, block_rows=64).drop("word", "prompt_id")
    return _rounded(profile, "max_sim", "min_positive_sim")


def d4_max_sim_diversity(spark, d):
    return dv.max_sim_diversity(tb.vectors(spark, d)).drop("word")


def d4_blocks(spark, d):
    """All vectors as one group, in several blocks."""
    return dv.max_sim_diversity(tb.vectors(spark, d).withColumn("prompt_id", F.lit(0)), block_rows=64).drop("word", "prompt_id")


def d4_word_diversity(spark, d):
    words = materialise(tb.candidates(spark, d))
    vectors = dv.attach_embeddings(words, tb.word_vectors(spark, d))
    return dv.max_sim_diversity(vectors, group_sizes=words)


def d5_diversity_fallback(spark, d):
    """Seven documents are a group; one without a vector sets its whole group to 0."""
    labelled = table(spark, d, "labels", "doc_id").select(
        F.col("doc_id").alias("sample_idx"), F.floor(F.col("doc_id") / 7).alias("prompt_id")
    )
    vectors = tb.vectors(spark, d).select("sample_idx", "embedding")
    return dv.max_sim_diversity(labelled.join(vectors, "sample_idx", "left"))


# --- E: pairs


def _diverse(spark, d):
    return dv.max_sim_diversity(
        tb.vector_quality(spark, d), group_sizes=table(spark, d, "embeddings").select(F.col("label").alias("prompt_id"))
    )


def e1_split_quality(spark, d):
    return pr.split_quality(tb.vector_quality(spark, d)).select("prompt_id", "sample_idx", "is_good")


def e2_pick_chosen(spark, d):
    return pr.pick_chosen(_diverse(spark, d))


def e3_pick_rejected(spark, d):
    return pr.pick_rejected(_diverse(spark, d))


def e4_mine_pairs(spark, d):
    return pr.mine_pairs(_diverse(spark, d))


def e5_max_target_filter(spark, d):
    """Token counts: length of the last word of the document with the candidate's id, or of the word if there is none."""
    length = table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.length(tx.last_word(F.col("text"))).alias("tokens")
    )
    pairs = e4_mine_pairs(spark, d)
    for side in ("chosen", "rejected"):
        side_length = length.select(
            F.col("doc_id").alias(side + "_idx"), F.col("tokens").alias(side + "_tokens")
        )
        pairs = pairs.join(side_length, side + "_idx", "left")
        pairs = pairs.withColumn(side + "_tokens", F.coalesce(side + "_tokens", F.length(side)))
    kept = pr.max_target_filter(pairs, 7, F.col("chosen_tokens"), F.col("rejected_tokens"))
    return kept.select("prompt_id", "chosen", "rejected", "chosen_tokens", "rejected_tokens")


def _scored_words(spark, d):
    return mining.score_candidates(
        materialise(tb.candidates(spark, d)), tb.word_vectors(spark, d), lexicon=tb.lexicon(spark, d), gazetteer=tb.names(spark, d)
    )


def e6_pair_audit(spark, d):
    scored = ql.quality_score(tb.candidates(spark, d), "lexicon", lexicon=tb.lexicon(spark, d), gazetteer=tb.names(spark, d))
    return pr.pair_audit(scored)


def e6_audit_lines(spark, d):
    return pr.audit_lines(_scored_words(spark, d)).select(
        "prompt_id", "sample_idx", "no_pair_reason", "candidates", "quality_text", "diversity_text"
    )


def text_to_pairs(spark, d):
    """The whole way from completions to pairs within the length limit."""
    completions = tb.completions(spark, d).drop("lang")
    return mining.pairs_from_completions(
        completions, tb.word_vectors(spark, d), max_target_length=tb.MAX_TOKENS,
        token_count=lambda word: F.regexp_count(word, F.lit(tb.VOWELS)) + 1,
        lexicon=tb.lexicon(spark, d), gazetteer=tb.names(spark, d),
    )


# --- F: loss and metrics


def f1_sequence_logp(spark, d):
    tokens = table(spark, d, "lineitem", "l_orderkey", "l_discount", "l_returnflag").select(
        "l_orderkey", (-F.col("l_discount")).alias("logp"), (F.col("l_returnflag") != "R").alias("mask")
    )
    return _rounded(mt.sequence_logps(tokens, "l_orderkey"), "sequence_logp")


def f1_sequence_logp_arrays(spark, d):
    rows = tb.token_rows(spark, d).select(
        "doc_id",
        F.transform("ids", lambda n: -n / 10).alias("logps"),
        F.transform("ids", lambda n: (n > 3).cast("int")).alias("mask"),
    )
    return rows.select("doc_id", round6(pf.sequence_logp(F.col("logps"), F.col("mask"))).alias("sequence_logp"))


_PAIR_KEY = ["batch_id", "l_linenumber", "l_partkey", "l_suppkey"]


def _terms(spark, d, loss, *columns):
    terms = mt.pair_terms(tb.pair_logps(spark, d), loss)
    return terms.select(*_PAIR_KEY, *columns)


def f2_dpo_logits(spark, d):
    return _rounded(_terms(spark, d, "sigmoid", "logits"), "logits")


def f3_dpo_loss_sigmoid(spark, d):
    return _rounded(_terms(spark, d, "sigmoid", "loss"), "loss")


def f4_dpo_loss_hinge(spark, d):
    return _rounded(_terms(spark, d, "hinge", "loss"), "loss")


def f5_rewards(spark, d):
    terms = _terms(spark, d, "sigmoid", "reward_chosen", "reward_rejected", "margin", "accurate")
    return _rounded(terms, "reward_chosen", "reward_rejected", "margin")


def f6_batch_metrics(spark, d):
    return _rounded(mt.batch_metrics(tb.pair_logps(spark, d), tb.batches(spark, d)), *mt.METRICS)


def f6_batch_metrics_hinge(spark, d):
    metrics = mt.batch_metrics(tb.pair_logps(spark, d), tb.batches(spark, d), loss="hinge", beta=0.5)
    return _rounded(metrics, *mt.METRICS)


def f6_step_metrics(spark, d):
    """Documents as prompts in batches of four; log-probabilities only where a label exists."""
    ids = table(spark, d, "documents", "doc_id").withColumnRenamed("doc_id", "prompt_id")
    prompts = prep.align_to_batch(ids, "prompt_id", None, 4, 2)
    pairs = materialise(text_to_pairs(spark, d))
    labelled = table(spark, d, "labels", "doc_id", "quality", "toxic").withColumnRenamed("doc_id", "prompt_id")
    logps = pairs.join(labelled, "prompt_id").select(
        "prompt_id",
        (-F.ln(2 + F.length("chosen"))).alias("policy_chosen"),
        (-F.ln(3 + F.length("rejected"))).alias("policy_rejected"),
        (-F.ln(4 + F.col("quality"))).alias("ref_chosen"),
        (-F.ln(5 + F.col("toxic"))).alias("ref_rejected"),
    )
    return _rounded(steps.step_metrics(prompts, pairs, logps), *mt.METRICS)


def f7_zero_pair_batches(spark, d):
    return f6_batch_metrics(spark, d).filter(F.col("valid_pairs_frac") == 0)


def f8_sample_pairs_log(spark, d):
    log = mt.sample_pairs_log(tb.pair_logps(spark, d), _PAIR_KEY[1:], step="batch_id")
    return _rounded(log.select(*_PAIR_KEY, "rank", "accuracy", "margin"), "accuracy", "margin")


# --- G: evaluation


def g1_vocabulary_summary(spark, d):
    return ev.vocabulary_summary(tb.runs(spark, d))


def g1_vocabulary_list(spark, d):
    return ev.vocabulary_list(tb.runs(spark, d))


def g2_avg_pairwise_similarity(spark, d):
    return _rounded(ev.avg_pairwise_similarity(tb.vector_runs(spark, d)), "avg_similarity")


def g3_min_positive_similarity(spark, d):
    lowest = ev.min_positive_similarity(tb.vector_runs(spark, d)).drop("missing_vectors")
    return _rounded(lowest, "min_positive_similarity")


def g3_blocks(spark, d):
    """All vectors as one run, in several blocks; documents without a vector are counted."""
    vectors = tb.vector_runs(spark, d).select("word", "embedding")
    words = table(spark, d, "documents", "doc_id").select(F.lit("all").alias("run"), F.col("doc_id").cast("string").alias("word"))
    joined = words.join(vectors, "word", "left")
    return _rounded(ev.min_positive_similarity(joined, block_rows=64), "min_positive_similarity")


def g4_diversity_score_avg(spark, d):
    return _rounded(ev.diversity_score(tb.vector_runs(spark, d)).drop("missing_vectors"), "diversity_score")


def g4_diversity_score_max(spark, d):
    return _rounded(ev.diversity_score(tb.vector_runs(spark, d), mode="max").drop("missing_vectors"), "diversity_score")


def g5_vocabulary_compare(spark, d):
    return ev.vocabulary_compare(tb.runs(spark, d), "en", "fr")


_FIGURES = ("avg_similarity", "min_positive_similarity", "diversity_avg", "diversity_max")


def _report(runs, vectors, baseline):
    report = ev.run_report(runs, vectors, baseline)
    return _rounded(report, *_FIGURES, *[f + "_delta" for f in _FIGURES])


def g6_run_report(spark, d):
    runs = tb.vector_runs(spark, d)
    return _report(runs.drop("embedding"), runs.select("word", "embedding"), "0")


def g6_run_report_words(spark, d):
    return _report(tb.runs(spark, d), tb.word_vectors(spark, d), "en")


def g6_report_on_outputs(spark, d):
    """Raw outputs with echoed prompts; the role is the run."""
    outputs = _echoed(spark, d).select(
        F.col("role").alias("run"), F.col("turn").alias("sample_idx"),
        F.col("text_before").alias("prompt"), F.col("output").alias("text"),
    )
    report = comparison.report_on_outputs(outputs, tb.word_vectors(spark, d), "user")
    return _rounded(report, *_FIGURES, *[f + "_delta" for f in _FIGURES])


# --- H: streams


def _event_score(spark, d):
    labels = table(spark, d, "labels").select(
        F.col("doc_id").cast("string").alias("word"), F.col("quality").cast("double").alias("quality")
    )
    vectors = tb.vectors(spark, d).select("word", "embedding")

    def score(candidates: DataFrame) -> DataFrame:
        joined = dv.attach_embeddings(candidates.join(labels, "word", "left"), vectors)
        return dv.max_sim_diversity(joined, sp.GROUP, group_sizes=candidates)

    return score


def _seconds():
    return F.unix_seconds("window_start").alias("window_start")


def _new_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def h1_stream_pairs(spark, d):
    """The events as a stream, run until all input is read and every window closed."""
    folder = _new_folder(spark, "stream-pairs")
    sp.stream_pairs_to_end(
        tb.event_completions(tb.events(spark, d, stream=True)), _event_score(spark, d),
        f"{folder}/out", f"{folder}/state", window="7 days", delay="1 day",
    )
    pairs = spark.read.parquet(f"{folder}/out/pairs")
    return pairs.select(_seconds(), "prompt_id", "chosen", "rejected")


def h1_window_pairs(spark, d):
    """The same plan over the table: all windows."""
    events = tb.event_completions(tb.events(spark, d))
    closed = sp.closed_candidates(events, "7 days", None)
    pairs = pr.mine_pairs(_event_score(spark, d)(closed), sp.GROUP)
    return pairs.select(_seconds(), "prompt_id", "chosen", "rejected")


def h2_step_metrics(spark, d):
    metrics = sm.stream_step_metrics(tb.event_prompts(tb.events(spark, d)), "1 hour", None)
    return _rounded(metrics.select(_seconds(), *mt.METRICS), *mt.METRICS)


def h2_stream_windows(spark, d):
    """The events as a stream; the mean over users, each a batch, of every window that the watermark closes."""
    folder = _new_folder(spark, "stream-metrics")
    prompts = tb.event_prompts(tb.events(spark, d, stream=True), "user_id")
    metrics = sm.stream_step_metrics(prompts, "1 day", "1 hour", batch="user_id")
    query = (
        metrics.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    windows = spark.read.schema(metrics.schema).parquet(f"{folder}/out")
    return _rounded(windows.select(_seconds(), *mt.METRICS), *mt.METRICS)


def h2_batch_windows(spark, d):
    """Seven order keys to a step, each order a batch; the mean over batches of ten steps."""
    prompts = tb.pair_logps(spark, d).withColumn("step", F.floor(F.col("batch_id") / 7))
    return _rounded(mt.step_window_metrics(prompts, batch="batch_id"), *mt.METRICS)


def h2_step_windows(spark, d):
    """Orders as steps, ten to a window."""
    prompts = tb.pair_logps(spark, d).withColumnRenamed("batch_id", "step")
    return _rounded(mt.step_window_metrics(prompts), *mt.METRICS)


# --- I: sinks


def i1_write_pairs(spark, d):
    """Pairs written by step, read back, and passed through the route for ready-made pairs."""
    folder = _new_folder(spark, "pairs")
    pairs = e4_mine_pairs(spark, d).select(
        F.col("prompt_id").cast("string").alias("prompt"), "chosen", "rejected",
        F.floor(F.col("prompt_id") / 4).alias("step"),
    )
    sinks.write_pairs(pairs, folder)
    back = sinks.read_pairs(spark, folder)
    return prep.route_by_schema(back, mine=lambda p: p.limit(0)).select(
        "prompt", "chosen", "rejected", F.col("step").cast("bigint").alias("step")
    )


def i1_rewrite_step(spark, d):
    """All steps are written, then those below 2 once more with the sides exchanged: only their folders are replaced."""
    folder = _new_folder(spark, "pairs")
    pairs = materialise(
        e4_mine_pairs(spark, d).select(
            F.col("prompt_id").cast("string").alias("prompt"), "chosen", "rejected",
            F.floor(F.col("prompt_id") / 4).alias("step"),
        )
    )
    sinks.write_pairs(pairs, folder)
    exchanged = F.col("rejected").alias("chosen"), F.col("chosen").alias("rejected")
    again = pairs.filter("step < 2").select("prompt", *exchanged, "step")
    sinks.write_pairs(again, folder, mode="replace_steps")
    back = sinks.read_pairs(spark, folder)
    return back.select("prompt", "chosen", "rejected", F.col("step").cast("bigint").alias("step"))


def i2_write_metrics(spark, d):
    folder = _new_folder(spark, "metrics")
    metrics = f6_batch_metrics(spark, d)
    sinks.write_metrics(metrics, folder)
    return sinks.read_metrics(spark, folder, metrics.schema)


def queries() -> dict[str, Query]:
    found = {}
    for name, value in globals().items():
        if callable(value) and (name == "text_to_pairs" or name[:1] in "abcdefghi" and name[1:2].isdigit()):
            found[name] = value
    return found

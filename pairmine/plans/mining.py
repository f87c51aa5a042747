"""From completions to preference pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from pairmine.operators import candidates as cd
from pairmine.operators import diversity as dv
from pairmine.operators import pairs as pr
from pairmine.operators import quality as ql
from pairmine.session import materialise


def unique_candidates(completions: DataFrame) -> DataFrame:
    """Cleaned unique words per prompt: ``prompt_id, word, sample_idx``."""
    return cd.dedupe_keep_first(cd.normalise(completions, "train"))


def score_candidates(
    candidates: DataFrame,
    embeddings: DataFrame | Callable[[DataFrame], DataFrame],
    group: str | list[str] = "prompt_id",
    rules: str | Callable[[Column], Column] = "lexicon",
    lexicon: DataFrame | None = None,
    gazetteer: DataFrame | None = None,
    common: DataFrame | None = None,
    tags: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Quality, reason and diversity of each unique candidate."""
    scored = ql.quality_score(
        candidates, rules, lexicon=lexicon, gazetteer=gazetteer, common=common, tags=tags
    )
    vectors = dv.attach_embeddings(scored, embeddings)
    options.setdefault("group_sizes", candidates)
    return dv.max_sim_diversity(vectors, group, "sample_idx", **options)


def pairs_from_completions(
    completions: DataFrame,
    embeddings: DataFrame | Callable[[DataFrame], DataFrame],
    max_target_length: int | None = None,
    token_count: Callable[[Column], Column] | None = None,
    tie: str = "first",
    seed: int = 0,
    **scoring,
) -> DataFrame:
    """Completions in, at most one pair per prompt out.

    The unique candidates are written to the shared folder once: they are far smaller than the
    completions, and counting large groups and scoring both start from them, so the text is read
    only one time. A length limit counts tokens: ``token_count`` gives the number for a word, from the
    tokenizer that is trained with.
    """
    if max_target_length is not None and token_count is None:
        raise ValueError("max_target_length counts tokens and needs token_count")
    candidates = materialise(unique_candidates(completions))
    scored = score_candidates(candidates, embeddings, **scoring)
    pairs = pr.mine_pairs(scored, tie=tie, seed=seed)
    if max_target_length is None:
        return pairs
    return pr.max_target_filter(pairs, max_target_length, token_count(pairs["chosen"]), token_count(pairs["rejected"]))

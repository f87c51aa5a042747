"""Logical tables, checked at the API boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_ID, _IDX, _TEXT, _NUM = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()

PROMPTS = _table(prompt_id=_ID, prompt=_TEXT)
TOKEN_ROWS = _table(
    prompt_id=_ID, batch_id=_ID, ids=T.ArrayType(T.LongType()), mask=T.ArrayType(T.IntegerType())
)
COMPLETIONS = _table(prompt_id=_ID, sample_idx=_IDX, text=_TEXT)
CANDIDATES = _table(prompt_id=_ID, sample_idx=_IDX, word=_TEXT)
LEXICON = _table(word=_TEXT, first_pos=_TEXT)
GAZETTEER = _table(word=_TEXT)
TAGS = _table(word=_TEXT, tag=_TEXT)
PAIRS = _table(
    prompt_id=_ID, chosen=_TEXT, rejected=_TEXT, chosen_diversity=_NUM, rejected_diversity=_NUM
)
PAIR_LOGPS = _table(
    batch_id=_ID,
    prompt_id=_ID,
    policy_chosen=_NUM,
    policy_rejected=_NUM,
    ref_chosen=_NUM,
    ref_rejected=_NUM,
)
BATCHES = _table(batch_id=_ID, batch_size=_IDX)
RUNS = _table(run=_TEXT, sample_idx=_IDX, word=_TEXT)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Raise when a needed column is absent; hand ``df`` back otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; got {df.columns}")
    return df

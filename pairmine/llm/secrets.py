"""Operator 11: secret scans over all historical versions of texts, by an incremental ledger of blobs.

A version is a text at a path; its blob is the SHA-256 of the text, so that equal texts are one blob wherever and
whenever they occur. The ledger, a Parquet table in a folder of the caller's, says which blob has been scanned by which rule
in which version and what was found. A run

1. writes the address of every version (path and blob),
2. takes the blobs whose pairs with the rules' versions are not all in the ledger,
3. scans one text of each such blob, with the rules still missing for it, and appends one row per blob to the ledger,
4. joins what the ledger knows of the blobs back to all paths.

Rows of the ledger stand for themselves: a run that was cut off leaves either whole rows, which the next run need not
scan again, or nothing; two runs at once repeat work but not findings. Copies of a text are dropped by each
task before texts are shuffled, so a blob that a third of all versions share sends one text per task. Findings go back by a
join that adaptive execution may split, one small row per blob that has any.

Defined results: a null text is the empty text; rows that repeat a path keep a row each; a null path is a path; an empty table gives an empty
table; other input columns are ignored, and a path column named as one of the output's is an error. Every text is scanned
whole. Offsets are code points, the end is exclusive; overlapping findings of different rules all stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairmine.llm.common import whole
from pairmine.session import materialise


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost non-overlapping matches are secrets if ``group`` has ``least`` characters.

    Whoever changes anything else of a rule gives it a new ``version``: the ledger knows a rule by name and version.
    """

    name: str
    version: int
    pattern: str
    least: int
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The three kinds of secrets, in the order in which they are reported.
RULES = (
    Rule(
        "assign",
        1,
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
        r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        6,
        2,
    ),
    # a run shorter than this holds no longer one, so the length may stand in the pattern
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
)

SPANS = "array<struct<start: int, rule: string, end: int>>"
LEDGER = "blob binary, scanned array<string>, found array<struct<rule: string, start: int, end: int>>"


def matches(text: str, rule: Rule) -> list[tuple[int, int]]:
    """(start, end) of what ``rule`` finds in a text."""
    found = re.finditer(rule.pattern, text)
    return [m.span() for m in found if m.end(rule.group) - m.start(rule.group) >= rule.least]


def open_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger in ``folder``, begun there if there is none. One row per blob and run that scanned it."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, rules): of each blob the keys of those ``rules`` that the ledger has not seen with it, if any."""
    known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("known"))
    keys = F.array(*(F.lit(r.key) for r in rules))
    missing = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
    return blobs.distinct().join(known, "blob", "left").select("blob", missing.alias("rules")).filter(F.size("rules") > 0)


def scan(versions: DataFrame, folder: str, *, rules: Sequence[Rule] = RULES, path: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each row of ``versions`` as its ``path`` columns, blob and findings: array of (start, rule, end) in this order.

    ``rules`` are ordered: findings with one start come in the order of their rules. Only what the ledger in ``folder``
    lacks is scanned, and is added to it at once.
    """
    if {"blob", "findings"} & set(path) or len({r.key for r in rules}) < len(rules):
        raise ValueError("path columns must not be named blob or findings, and a rule must come once")
    spark, by_key = versions.sparkSession, {r.key: r for r in rules}
    address = F.unhex(F.sha2(whole("text"), 256)).alias("blob")
    addressed = materialise(versions.select(*path, address))
    ledger = open_ledger(spark, folder)
    todo = materialise(unseen(addressed.select("blob"), ledger, rules))
    texts = versions.select(address, whole("text").alias("text"))
    if not ledger.isEmpty():  # texts that the ledger knows go early where the rest is small enough to broadcast
        texts = texts.join(todo.select("blob"), "blob", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("blob", pa.binary()),
                ("scanned", pa.list_(pa.string())),
                ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
            ]
        )
        for batch in batches:
            found = []
            for text, keys in zip(batch.column("text"), batch.column("rules").to_pylist(), strict=True):
                plain = text.as_py()
                spans = ((k, s, e) for k in keys for s, e in matches(plain, by_key[k]))
                found.append([{"rule": k, "start": s, "end": e} for k, s, e in spans])
            columns = [batch.column("blob").to_pylist(), batch.column("rules").to_pylist(), found]
            made = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    pieces = texts.dropDuplicates(["blob"]).join(todo, "blob").select("blob", "text", "rules")
    pieces.mapInArrow(run, LEDGER).write.mode("append").parquet(folder)
    return addressed.join(findings(spark, folder, rules), "blob", "left").select(
        *path, "blob", F.coalesce("findings", F.array().cast(SPANS)).alias("findings")
    )


def findings(spark: SparkSession, folder: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(blob, findings) of those blobs of the ledger in which ``rules`` have found something."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    found = open_ledger(spark, folder).select("blob", F.explode("found").alias("f"))
    ranked = found.select("blob", "f.start", F.array_position(keys, F.col("f.rule")).alias("rank"), "f.end").filter("rank > 0")
    # what two runs found at once is the same span and counts once
    spans = ranked.groupBy("blob").agg(F.sort_array(F.collect_set(F.struct("start", "rank", "end"))).alias("spans"))
    names = F.array(*(F.lit(r.name) for r in rules))
    span = F.transform(
        "spans",
        lambda s: F.struct(s["start"].alias("start"), F.get(names, s["rank"].cast("int") - 1).alias("rule"), s["end"].alias("end")),
    )
    return spans.select("blob", span.alias("findings"))

"""Operator 8: a quality classifier as a sparse ensemble of rules.

Statistics of the whole text are DataFrame columns. A random forest of shallow trees is grown on the labelled rows; each
path from a root to a node is a conjunctive rule over the statistics. A logistic regression with an L1 penalty
weighs the rules and drops most of them. What is left is compiled into one column expression: the score of a document is
the logistic function of the weights of the rules that hold for it. Forest and regression are fitted by Spark over
all the labelled rows.

Defined results: a null or empty text has statistics 0 and is scored like any other; a text of any length is measured whole;
labels that are null say nothing, and a doc_id that is labelled twice counts twice; without labels, or with labels of one
kind, there are no rules and the score is the share of label 1 (one half without any); rows that repeat others
get equal scores; an empty table gives an empty table. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairmine.llm.common import SPACE_RUN, whole, words
from pairmine.session import materialise

TREES = 12
DEPTH = 3
PENALTY = 0.0005
STEPS = 80
SEED = 3

#: One condition: (statistic, True for "at most", threshold). A rule is a set of them that must all hold.
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class Rules:
    intercept: float
    weights: tuple[tuple[tuple[Condition, ...], float], ...]


def _share(kept: str, text: Column, total: Column) -> Column:
    """Share of the characters that are of a kind; ``kept`` is a regular expression for all the others."""
    return F.char_length(F.regexp_replace(text, kept, "")) / F.greatest(total, F.lit(1))


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and one column of doubles per statistic."""
    text, n = F.col("text"), F.col("n")
    rows = docs.select("doc_id", whole("text").alias("text")).withColumn("n", F.char_length("text"))
    rows = rows.withColumn("w", words(text)).withColumn("k", F.size("w"))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    per_word = F.greatest(F.col("k"), F.lit(1))
    found = {
        "chars": F.log1p(n),
        "words": F.log1p("k"),
        "word_length": (n - F.char_length(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", ""))) / per_word,
        "distinct_words": F.size(F.array_distinct("w")) / per_word,
        "spread_words": F.size(F.array_distinct("w")) / F.sqrt(per_word),
        "short_words": F.size(F.filter("w", lambda x: F.char_length(x) <= 3)) / per_word,
        "upper": _share(r"\P{Lu}+", text, n),
        "letters": _share(r"\P{L}+", text, n),
        "digits": _share(r"[^0-9]+", text, n),
        "symbols": _share(r"[^#$%&*+/<=>@\\^_{|}~\[\]]+", text, n),
        "bars": _share(r"[^|]+", text, n),
        "shouts": _share(r"[^!?]+", text, n),
        "stops": _share(r"[^.,;:]+", text, n),
        "line_length": F.log1p(n / F.greatest(F.size(lines), F.lit(1))),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }
    return rows.select("doc_id", *(c.cast("double").alias(name) for name, c in found.items()))


STATISTICS = (
    "chars words word_length distinct_words spread_words short_words upper letters digits symbols bars shouts stops "
    "line_length distinct_lines"
).split()


def _paths(node, above: tuple[Condition, ...]) -> list[tuple[Condition, ...]]:
    """Every path of a fitted tree from below the root to a node."""
    if node.subtreeDepth() == 0:
        return []
    split = node.split()
    name, at = STATISTICS[split.featureIndex()], split.threshold()
    found = []
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        path = tuple(sorted({*above, (name, low, at)}))
        found += [path, *_paths(child, path)]
    return found


def holds(rule: tuple[Condition, ...]) -> Column:
    every = F.lit(True)
    for name, low, at in rule:
        every = every & (F.col(name) <= at if low else F.col(name) > at)
    return every


def learn(labelled: DataFrame) -> Rules:
    """Learns from the statistics and ``label`` (0 or 1) of the labelled rows."""
    rows = materialise(labelled.filter(F.col("label").isin(0, 1)).select("label", *STATISTICS))
    n, ones = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        share = ones / n if n else 0.5
        return Rules(math.log((share + 1e-3) / (1 - share + 1e-3)) if n else 0.0, ())
    points = rows.select(F.col("label").cast("double"), array_to_vector(F.array(*STATISTICS)).alias("features"))
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="onethird", cacheNodeIds=False
    ).fit(points)
    rules = sorted({rule for tree in forest.trees for rule in _paths(tree._call_java("rootNode"), ())})
    marks = F.array(*(F.when(holds(rule), 1.0).otherwise(0.0) for rule in rules))
    marked = materialise(rows.select(F.col("label").cast("double"), marks.alias("marks")))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=STEPS, standardization=False).fit(
        marked.select("label", array_to_vector("marks").alias("features"))
    )
    weights = zip(rules, (float(w) for w in fitted.coefficients), strict=True)
    return Rules(float(fitted.intercept), tuple((rule, w) for rule, w in weights if w != 0.0))


def score(rules: Rules) -> Column:
    """The score, 0 to 1, as a column expression over the statistics."""
    total = F.lit(rules.intercept)
    for rule, weight in rules.weights:
        total = total + F.when(holds(rule), weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of ``docs``, learned from ``labels`` (doc_id, label) of rows of ``docs``."""
    measured = materialise(statistics(docs))
    told = labels.select(F.col("doc_id").alias("told_id"), "label")
    rules = learn(measured.join(told, F.col("doc_id") == F.col("told_id")))
    return measured.select("doc_id", score(rules).alias("score"))

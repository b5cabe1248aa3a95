"""Quality classifier: a sparse ensemble of rules over text statistics.

A random forest is grown over the statistics of labelled documents. Each path from a root
to a node is a rule, a conjunction of bounds on statistics. A logistic regression with an
L1 penalty weighs the rules and leaves most of them out; the rest become one column
expression, so that scoring is a single pass of built-in functions over the texts.
"""

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, and_

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mastline.llm.runtime import stored

#: Labelled rows a model is fitted on, at most; those whose hashed id is smallest.
MAX_LABELS = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[ \t\n\x0B\f\r]+"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Columns ``row``, a struct of all columns of ``docs``, and ``stats``, one of doubles.

    A null text counts as an empty one.
    """
    text, words, lines = F.col("text"), F.col("words"), F.col("lines")
    n, m = F.length(text), F.size("words")
    statistics = {
        "words": m.cast("double"),
        "word_length": _share(F.length(F.translate(text, " \t\n\x0b\f\r", "")), m),
        "distinct_words": _share(F.size(F.array_distinct(words)), m),
        "repeated_lines": _share(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": _share(m, F.size(lines)),
        "symbols": _share(_count(text, "#*$%&|<>"), n),
        "bars": _share(_count(text, "|"), n),
        "exclamations": _share(_count(text, "!"), n),
        "capitals": _share(_count(text, _UPPER), n),
        "digits": _share(_count(text, "0123456789"), n),
        "stops": _share(_count(text, ".,;:"), m),
        "quotes": _share(_count(text, "\"'()[]{}=/\\_@"), n),
    }
    return (
        docs.select(
            F.struct(*(docs[c] for c in docs.columns)).alias("row"),
            F.coalesce(docs[text_column], F.lit("")).alias("text"),
        )
        .withColumns(
            {
                "words": F.array_remove(F.split("text", _SPACE), ""),
                "lines": F.array_remove(F.split("text", "\n"), ""),
            }
        )
        .select("row", F.struct(*(v.alias(k) for k, v in statistics.items())).alias("stats"))
    )


@dataclass(frozen=True)
class Rule:
    """Bounds ``lower < statistic <= upper`` that hold together."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        parts = []
        for name, lower, upper in self.bounds:
            value = F.col("stats")[name]
            parts += [value > lower] if lower > -math.inf else []
            parts += [value <= upper] if upper < math.inf else []
        return reduce(and_, parts)


def _paths(node, names: list[str], bounds: dict) -> set[Rule]:
    """The rules of all nodes below one of Spark's tree nodes."""
    found = set()
    if bounds:
        found.add(Rule(tuple((n, *b) for n, b in sorted(bounds.items()))))
    if node.subtreeDepth():
        split = node.split()
        name, at = names[split.featureIndex()], split.threshold()
        lower, upper = bounds.get(name, (-math.inf, math.inf))
        found |= _paths(node.leftChild(), names, {**bounds, name: (lower, min(upper, at))})
        found |= _paths(node.rightChild(), names, {**bounds, name: (max(lower, at), upper)})
    return found


@dataclass(frozen=True)
class RuleModel:
    """Weighted rules; without labels of both kinds, only an intercept."""

    weights: tuple[tuple[Rule, float], ...]
    intercept: float

    def score(self, docs: DataFrame, text_column: str = "text", name: str = "score") -> DataFrame:
        """``docs`` and a score from 0 to 1; higher means better. Defined for every text."""
        total = reduce(
            add,
            (F.when(rule.column(), weight).otherwise(0.0) for rule, weight in self.weights),
            F.lit(self.intercept),
        )
        kept = [F.col("row")[c].alias(c) for c in docs.columns if c != name]
        return with_statistics(docs, text_column).select(
            *kept, (1 / (1 + F.exp(-total))).alias(name)
        )


def training_labels(labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``(doc_id, quality)`` of the labels that may be learnt from, ``max_labels`` at most.

    Every fifth document by crc32 of its id is held out. Null ids and labels other than 0
    and 1 are left out; of differing labels of a document the larger counts.
    """
    return (
        labels.where(
            "doc_id IS NOT NULL AND quality IN (0, 1) AND crc32(CAST(doc_id AS STRING)) % 5 <> 0"
        )
        .groupBy("doc_id")
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_labels)
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    max_labels: int = MAX_LABELS,
    trees: int = 30,
    depth: int = 3,
    penalty: float = 0.001,
) -> RuleModel:
    """A model of ``labels.quality`` from the texts of ``docs``; text alone is looked at.

    Reruns agree: the sample is fixed by hashes and the forest by its seed.
    """
    known = training_labels(labels, max_labels).withColumnRenamed("doc_id", "known_id")
    texts = docs.select("doc_id", "text").join(
        F.broadcast(known), F.col("doc_id") == F.col("known_id")  # max_labels small rows
    )
    sample = with_statistics(texts).select(
        F.col("row.quality").cast("double").alias("label"), "stats"
    )
    names = sample.schema["stats"].dataType.names
    sample = stored(sample, "quality").coalesce(4)  # max_labels rows of a few numbers
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return RuleModel((), math.copysign(2.0, next(iter(counts), 0) - 0.5) if counts else 0.0)
    flat = VectorAssembler(inputCols=names, outputCol="features").transform(
        sample.select("label", "stats.*")
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="onethird", minInstancesPerNode=5
    ).fit(flat.select("label", "features"))
    rules = set()
    for tree in forest.trees:
        rules |= _paths(tree._java_obj.rootNode(), names, {})
    ordered = sorted(rules, key=lambda r: r.bounds)
    held = sample.select(
        "label", F.array(*(r.column().cast("double") for r in ordered)).alias("rules")
    ).select("label", array_to_vector("rules").alias("features"))
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, tol=1e-6
    ).fit(held)
    weights = zip(ordered, lasso.coefficients.toArray().tolist(), strict=True)
    return RuleModel(tuple((r, w) for r, w in weights if w), float(lasso.intercept))


def accepted(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold; columns as they were."""
    name = "_score"
    while name in docs.columns:
        name = f"_{name}"
    # observed rows are where a filter stays: pushed below, it would work out the statistics
    # anew for every rule
    scored = model.score(docs, name=name).observe("quality_scored", F.count(F.lit(1)).alias("rows"))
    return scored.where(F.col(name) >= threshold).drop(name)

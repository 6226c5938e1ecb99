"""Quality classifier: a sparse ensemble of rules.

Text statistics of labelled documents grow a forest of shallow trees; every path from a root
is a rule, a conjunction of thresholds.  A logistic regression with lasso penalty weighs the
rules, most get weight zero, and the rest compile into one Spark column expression.

Training uses at most about ``sample`` labelled rows, chosen by hash; scoring covers every
row and runs inside the scan.

Defined cases: null and empty texts have all statistics 0 and get a score; labels that are null
or contradict each other for a ``doc_id`` are not used; if only one label (or none) is left, the
score is the smoothed share of label 1; labels of unknown documents are ignored; rows that
share a ``doc_id`` are scored each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.common import fresh, only, sized_join
from ledgerlake.llm.statistics import ratios, with_statistics
from ledgerlake.sources.shared import materialize

# Bound on the labelled rows a model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.7
_PARTS = 4

Condition = tuple[str, bool, float]  # statistic, at most (else above), threshold


@dataclass
class RuleEnsemble:
    """score = 1 / (1 + exp(-(intercept + sum of the weights of the rules that hold)))."""

    intercept: float
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def score(self, statistics: dict[str, Column]) -> Column:
        terms = [
            F.when(rule_column(rule, statistics), F.lit(weight)).otherwise(F.lit(0.0))
            for rule, weight in self.rules
        ]
        margin = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))

    def describe(self) -> list[str]:
        return [
            f"{weight:+.3f} if " + " and ".join(f"{n} {'<=' if low else '>'} {t:.4g}" for n, low, t in rule)
            for rule, weight in self.rules
        ]


def rule_column(rule: tuple[Condition, ...], statistics: dict[str, Column]) -> Column:
    tests = [
        statistics[name] <= F.lit(limit) if low else statistics[name] > F.lit(limit)
        for name, low, limit in rule
    ]
    return reduce(lambda a, b: a & b, tests)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, sample: int, seed: int = 5) -> DataFrame:
    """(doc_id, label) of at most about ``sample`` documents outside the held-out part."""
    clear = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_high"))
        .where("label = _high")
        .drop("_high")
    )
    count = clear.count()
    share = min(1.0, sample / max(1, count))
    return clear.where(
        F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))
    )


def _paths(node, names: list[str], rule: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    found = [rule] if rule else []
    if node.subtreeDepth() == 0:
        return found
    name, limit = names[node.split().featureIndex()], node.split().threshold()
    for child, low in ((node.leftChild(), True), (node.rightChild(), False)):
        found += _paths(child, names, (*rule, (name, low, float(limit))))
    return found


def _simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound per statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, low, limit in rule:
        old = bounds.get((name, low), limit)
        bounds[name, low] = min(old, limit) if low else max(old, limit)
    return tuple(sorted((name, low, limit) for (name, low), limit in bounds.items()))


def fit(
    rows: DataFrame, names: list[str], trees: int = 20, depth: int = 3, penalty: float = 1e-3,
    seed: int = 11,
) -> RuleEnsemble:
    """Fit on (label, statistics by ``names``); label is 0 or 1."""
    # A fixed partitioning, so that bagging does not depend on the cluster.
    order = [F.hash(*names, "label"), *names]
    dealt = materialize(
        rows.repartition(_PARTS, *names).sortWithinPartitions(*order), "training"
    )
    counts = {r["label"]: r["count"] for r in dealt.groupBy("label").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((good + 1) / (bad + 1))
    if not good or not bad:
        return RuleEnsemble(prior)
    vector = array_to_vector(F.array(*[F.col(n).cast("double") for n in names]))
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, maxBins=64,
        subsamplingRate=0.6, featureSubsetStrategy="onethird", minInstancesPerNode=5, seed=seed,
    ).fit(dealt.select("label", vector.alias("x")).coalesce(_PARTS))
    rules = sorted(
        {
            _simplified(path)
            for tree in forest.trees
            for path in _paths(tree._java_obj.rootNode(), names)
        }
    )
    if not rules:
        return RuleEnsemble(prior)
    columns = {n: F.col(n) for n in names}
    holds = F.array(*[rule_column(r, columns).cast("double") for r in rules])
    model = LogisticRegression(
        labelCol="label", featuresCol="x", elasticNetParam=1.0, regParam=penalty, maxIter=60
    ).fit(dealt.select("label", array_to_vector(holds).alias("x")).coalesce(_PARTS))
    weights = [(rule, float(w)) for rule, w in zip(rules, model.coefficients, strict=True) if w]
    return RuleEnsemble(float(model.intercept), weights)


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words) per row of ``docs``."""
    names = sorted(ratios(repeats=False))
    measured = with_statistics(only(docs, "doc_id", "text"), "doc_id", repeats=False)
    measured = materialize(
        measured.select("doc_id", "n_words", *[c.alias(n) for n, c in ratios(repeats=False).items()]),
        "statistics",
    )
    chosen = materialize(labelled_sample(labels, label, sample), "labels")
    model = fit(sized_join(measured, chosen, ["doc_id"]).select("label", *names), names)
    score = model.score({n: F.col(n) for n in names})
    return measured.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        score.alias("score"),
        (score >= threshold).cast("int").alias("predicted"),
        "n_words",
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts."""
    names = sorted(ratios(repeats=False))
    chosen = materialize(labelled_sample(labels, label, sample), "labels")
    known = sized_join(only(docs, "doc_id", "text"), chosen, ["doc_id"])
    measured = with_statistics(known, "label", repeats=False)
    model = fit(
        measured.select("label", *[c.alias(n) for n, c in ratios(repeats=False).items()]), names
    )
    kept = fresh(docs, {"_row": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}).select("_row")
    kept = kept.withColumn("text", F.col("_row.text"))
    scored = with_statistics(kept, "_row", repeats=False).select(
        "_row", *[c.alias(n) for n, c in ratios(repeats=False).items()]
    )
    return scored.where(model.score({n: F.col(n) for n in names}) >= threshold).select("_row.*")

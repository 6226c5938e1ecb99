"""Quality rules: a learned decision list over text statistics.

Sequential covering: a rule grows by the threshold condition with the largest information
gain on two thirds of the labelled rows, is pruned on the rest by dropping trailing
conditions, and is kept while it is precise; rows that it covers are set aside and the next rule
starts.  The list compiles to one ordered Spark conditional expression.

Everything is DataFrame functions.  Statistics are cut into at most ``BINS`` bins, so that a
growth step is one aggregation whose result (bins per statistic) does not depend on the
number of rows.  Learning uses at most about ``SAMPLE`` labelled rows; statistics, base rules
and verdicts cover every row and are computed within the scan.

Defined cases: null and empty texts have all counts 0 and fail the base rules; labels
that are null or contradict each other are left out; without rows of both labels the list is empty and
only the base rules decide; rows that share a ``doc_id`` are judged each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.common import only, sized_join
from ledgerlake.llm.quality_classifier import labelled_sample
from ledgerlake.llm.statistics import ratios, with_statistics
from ledgerlake.sources.shared import materialize

SAMPLE = 20_000
BINS = 32
MAX_RULES = 12
MAX_CONDITIONS = 4
PRECISION = 0.9
SUPPORT = 4
# Fixed values of the base rules.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

_PARTS = 4


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    limit: float
    bin: int

    def holds(self, statistics: dict[str, Column]) -> Column:
        value = statistics[self.statistic]
        return value > F.lit(self.limit) if self.above else value <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.limit:.4g}"


Rule = tuple[Condition, ...]


def _all(conditions: Rule, column) -> Column:
    return reduce(lambda a, b: a & b, map(column, conditions), F.lit(True))


def verdict(rules: list[Rule], statistics: dict[str, Column]) -> Column:
    """Number of the first rule that rejects a row (from 1), else 0."""
    branches = F
    for number, rule in enumerate(rules, 1):
        branches = branches.when(_all(rule, lambda c: c.holds(statistics)), F.lit(number))
    return branches.otherwise(F.lit(0)) if rules else F.lit(0)


def describe(rules: list[Rule]) -> list[str]:
    return [f"{n}. reject if " + " and ".join(map(str, rule)) for n, rule in enumerate(rules, 1)]


def _precision(hit: int, miss: int) -> float:
    return hit / (hit + miss) if hit + miss else 0.0


class _Learner:
    def __init__(self, rows: DataFrame, names: list[str]):
        self.names = names
        levels = [(i + 1) / (BINS + 1) for i in range(BINS)]
        stored = materialize(
            rows.select("label", *names).repartition(_PARTS, *names), "training"
        )
        found = stored.agg(*[F.percentile(n, F.array(*map(F.lit, levels))).alias(n) for n in names])
        limits = found.first()
        self.limits = {n: sorted(set(limits[n] or [])) for n in names}
        bins = [
            reduce(
                lambda a, b: a + b,
                [(F.col(n) > F.lit(x)).cast("int") for x in self.limits[n]],
                F.lit(0),
            ).alias(n)
            for n in names
        ]
        pruning = (F.pmod(F.xxhash64(*names), F.lit(3)) == 0).alias("pruning")
        bad = (F.col("label") == 0).cast("int").alias("bad")
        self.rows = materialize(stored.select(bad, pruning, *bins), "bins").coalesce(_PARTS)

    def _binned(self, condition: Condition) -> Column:
        value = F.col(condition.statistic)
        return value > condition.bin if condition.above else value <= condition.bin

    def counts(self, rows: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        """Bad and good rows by statistic and bin."""
        stacked = F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("bin")) for n in self.names])
        ).alias("at")
        grouped = rows.select("bad", stacked).groupBy("at.name", "at.bin").agg(
            F.sum("bad").alias("bad"), F.count("*").alias("all")
        )
        table: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in self.names}
        for r in grouped.collect():
            table[r["name"]][r["bin"]] = (r["bad"], r["all"] - r["bad"])
        return table

    def grow(self, rows: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            table = self.counts(rows.where(_all(rule, self._binned)))
            first = table[self.names[0]].values()
            hit, miss = sum(b for b, _ in first), sum(g for _, g in first)
            if not hit or not miss:
                break
            base = math.log2(_precision(hit, miss))
            best: tuple[float, Condition] | None = None
            for name in self.names:
                low_hit = low_miss = 0
                for at, limit in enumerate(self.limits[name]):
                    bad, good = table[name].get(at, (0, 0))
                    low_hit, low_miss = low_hit + bad, low_miss + good
                    for above, p, n in ((False, low_hit, low_miss), (True, hit - low_hit, miss - low_miss)):
                        if p >= SUPPORT:
                            gain = p * (math.log2(_precision(p, n)) - base)
                            if gain > (best[0] if best else 1e-9):
                                best = (gain, Condition(name, above, limit, at))
            if best is None:
                break
            rule = (*rule, best[1])
        return rule

    def totals(self, rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
        """Bad and good rows that each rule covers."""
        sums = []
        for i, rule in enumerate(rules):
            holds = _all(rule, self._binned)
            sums += [
                F.sum(F.when(holds, F.col("bad"))).alias(f"b{i}"),
                F.sum(F.when(holds, 1 - F.col("bad"))).alias(f"g{i}"),
            ]
        row = rows.agg(*sums).first()
        return [(row[f"b{i}"] or 0, row[f"g{i}"] or 0) for i in range(len(rules))]

    def learn(self) -> list[Rule]:
        rules: list[Rule] = []
        left = self.rows
        while len(rules) < MAX_RULES:
            rule = self.grow(left.where("not pruning"))
            if not rule:
                break
            shorter = [rule[:k] for k in range(1, len(rule) + 1)]
            on_rest = self.totals(left.where("pruning"), shorter)
            worth = [((b - g) / (b + g) if b + g else -1.0, -k) for k, (b, g) in enumerate(on_rest)]
            rule = shorter[-max(worth)[1]]
            ((hit, miss),) = self.totals(left, [rule])
            if hit < SUPPORT or _precision(hit, miss) < PRECISION:
                break
            rules.append(rule)
            left = left.where(~_all(rule, self._binned))
        return rules


def learn_rules(rows: DataFrame, names: list[str]) -> list[Rule]:
    """Ordered rules for label 0 from rows of (label, statistics by ``names``)."""
    return _Learner(rows, names).learn()


def base_failed() -> Column:
    few = F.col("n_words") < MIN_WORDS
    return few | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Statistics and verdicts per row: ``doc_id``, counts, ``base_failed``, ``rule``, ``kept``."""
    names = sorted(ratios())
    measured = materialize(with_statistics(only(docs, "doc_id", "text"), "doc_id"), "statistics")
    columns = ratios()
    chosen = materialize(labelled_sample(labels, label, sample), "labels")
    known = sized_join(measured, chosen, ["doc_id"])
    rules = learn_rules(known.select("label", *[columns[n].alias(n) for n in names]), names)
    return measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), verdict(rules, columns).alias("rule"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

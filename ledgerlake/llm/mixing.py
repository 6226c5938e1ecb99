"""Mixing sources to target weights that change over the training run.

A source's schedule gives its weight at moments of the training run (0 to 1), linear
in between.  Its integral is the source's overall weight; targets share the budget by
these weights, limited by how often a source may be repeated.  The running integral says
which part of its target a source has delivered at any moment.  Every document holds an
interval of its source's word stream, in a random but repeatable order, once per epoch;
inverting the integral at the middle of the interval gives the document's training position.
Rows are then range-sorted by position.

Everything is DataFrame functions.  Sources may be many, and one may hold most rows: ranks
and running totals go over ranges of rows (``running_totals``), never over a whole source
in one task.

Defined cases: a null text has no words; a null source is a source of its own and comes
last; documents without words are taken zero times; identical rows are taken one after the
other; ties in the order are broken by the content of the row; an empty table gives an empty
result.  In ``mix`` columns named like an output column give way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.common import fresh, only, running_totals, sized_join, word_count
from ledgerlake.sources.shared import materialize

# Weights by class of source: (moment, weight) knots, with integrals 5, 2 and 1.
CLASSES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 6.0), (1.0, 4.0)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)
BUDGET = 1.5
EPOCHS = 2.0
_KNOTS = "array<struct<at: double, weight: double>>"


def source_key(source: Column) -> Column:
    """Text that orders by code point with null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source))


def cyclic_schedules(sources: DataFrame, classes=CLASSES) -> DataFrame:
    """(source_key, knots): the classes in turn over the sources in code-point order."""
    ranked = running_totals(
        sources.select("source_key", F.lit(1).alias("one"), F.lit(0).alias("all")),
        ["all"], [F.col("source_key")], ["one"],
    )
    tables = F.array(
        *[
            F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in knots])
            for knots in classes
        ]
    )
    turn = (F.col("one_before") % len(classes)).cast("int")
    return ranked.select("source_key", tables[turn].cast(_KNOTS).alias("knots"))


def _segments(knots: Column) -> Column:
    """Pieces of the schedule, each with the integral before it."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(knots) - 2),
        lambda i: F.struct(
            knots[i]["at"].alias("t"),
            (knots[i + 1]["at"] - knots[i]["at"]).alias("dt"),
            knots[i]["weight"].alias("w"),
            (knots[i + 1]["weight"] - knots[i]["weight"]).alias("dw"),
        ),
    )
    area = lambda p: p["dt"] * (p["w"] + p["dw"] / 2)
    start = F.array().cast(
        "array<struct<t: double, dt: double, w: double, dw: double, before: double, area: double>>"
    )

    def extend(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)
        before = F.when(F.size(done) == 0, F.lit(0.0)).otherwise(last["before"] + last["area"])
        return F.concat(
            done,
            F.array(
                F.struct(
                    p["t"].alias("t"), p["dt"].alias("dt"), p["w"].alias("w"), p["dw"].alias("dw"),
                    before.alias("before"), area(p).alias("area"),
                )
            ),
        )

    return F.aggregate(pieces, start, extend)


def _moment(segments: Column, demand: Column) -> Column:
    """The moment at which the running integral reaches ``demand``."""
    here = F.coalesce(
        F.filter(segments, lambda s: (s["before"] + s["area"] >= demand) & (s["area"] > 0))[0],
        F.element_at(segments, -1),
    )
    rest = F.greatest(F.lit(0.0), F.least(demand - here["before"], here["area"]))
    # w x + dw x^2 / 2 = rest / dt, in the form that also holds for dw = 0.
    y = rest / here["dt"]
    root = F.sqrt(F.greatest(F.lit(0.0), here["w"] * here["w"] + 2 * here["dw"] * y))
    below = here["w"] + root
    x = F.when(below > 0, 2 * y / below).otherwise(F.lit(0.0))
    return here["t"] + here["dt"] * F.least(F.lit(1.0), x)


def source_targets(
    sizes: DataFrame, schedules: DataFrame, budget: float = BUDGET, epochs: float = EPOCHS
) -> DataFrame:
    """(source_key, source_size, weight, segments, target) from (source_key, source_size).

    Targets are min(limit, level * weight); sorted by limit / weight, the sources at
    their limit come first, so running totals give the level.
    """
    known = sizes.join(schedules, "source_key").withColumn("segments", _segments(F.col("knots")))
    last = F.element_at(F.col("segments"), -1)
    known = known.select(
        "source_key", "source_size", "segments", (last["before"] + last["area"]).alias("weight"),
        (F.col("source_size") * F.lit(float(epochs))).alias("limit"), F.lit(0).alias("all"),
    )
    ratio = F.when(F.col("weight") > 0, F.col("limit") / F.col("weight"))
    ranked = materialize(
        running_totals(known, ["all"], [ratio.asc_nulls_last(), F.col("source_key")], ["limit", "weight"]),
        "targets",
    )
    totals = ranked.agg(
        (F.sum("source_size") * F.lit(float(budget))).alias("words"), F.sum("weight").alias("weights")
    ).first()
    words, weights = totals["words"] or 0.0, totals["weights"] or 0.0
    level = (words - F.col("limit_before")) / (weights - F.col("weight_before"))
    # The first source that its limit does not stop sets the level; later ones give less.
    cut = ranked.where("weight > 0").select(level.alias("level"), ratio.alias("ratio"))
    rise = cut.where("level <= ratio").agg(F.max("level")).first()[0]
    share = F.col("weight") * F.lit(float("inf") if rise is None else rise)
    return ranked.select(
        "source_key", "source_size", "weight", "segments",
        F.when(F.col("weight") > 0, F.least("limit", share)).otherwise(F.lit(0.0)).alias("target"),
    )


def plan_mix(
    docs: DataFrame, schedules: DataFrame | None = None, budget: float = BUDGET,
    epochs: float = EPOCHS, whole_documents: bool = False, seed: int = 17,
) -> DataFrame:
    """One row per document: what the mix takes of it, and when.

    Columns ``doc_id``, ``row_hash``, ``copy``, ``size``, ``source_size``, ``target``,
    ``taken`` and ``occurrences`` (epoch, words, position).  With ``whole_documents`` an
    occurrence counts in full or not at all, by whether its middle lies within the target;
    otherwise the last one is cut so that a source delivers its target to the word.
    ``schedules`` (source, knots) defaults to ``CLASSES`` in turn.
    """
    read = only(docs, "doc_id", "text", "source")
    text = F.col("text")
    sized = read.select(
        "doc_id",
        row_hash(docs),
        source_key(F.col("source").cast("string")).alias("source_key"),
        word_count(text).alias("size"),
    )
    units = materialize(
        sized.groupBy("doc_id", "row_hash", "source_key", "size").agg(F.count("*").alias("copies")),
        "sizes",
    ).withColumn("words", F.col("size") * F.col("copies"))
    sources = units.groupBy("source_key").agg(F.sum("words").alias("source_size"))
    if schedules is None:
        schedules = cyclic_schedules(sources)
    else:
        schedules = schedules.select(
            source_key(F.col("source")).alias("source_key"), F.col("knots").cast(_KNOTS).alias("knots")
        )
    targets = materialize(source_targets(sources, schedules, budget, epochs), "targets")
    placed = running_totals(
        units,
        ["source_key"],
        [F.xxhash64("doc_id", "row_hash", F.lit(seed)), F.col("row_hash"), F.col("doc_id")],
        ["words"],
    )
    copies = F.posexplode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy", "_")
    each = sized_join(placed, targets, ["source_key"]).select("*", copies)
    start = F.col("words_before") + F.col("copy") * F.col("size")
    last_epoch = F.when(
        F.col("source_size") > 0, F.ceil(F.col("target") / F.col("source_size")) - 1
    ).otherwise(F.lit(0))

    def occurrence(epoch: Column) -> Column:
        begin = start + epoch * F.col("source_size")
        if whole_documents:
            words = F.when(begin + F.col("size") / 2 < F.col("target"), F.col("size")).otherwise(0)
        else:
            room = F.floor(F.col("target")) - begin
            words = F.greatest(F.lit(0), F.least(room, F.col("size")))
        whole = F.element_at(F.col("segments"), -1)
        share = F.least(F.lit(1.0), (begin + words / 2) / F.greatest(F.col("target"), F.lit(1.0)))
        demand = share * (whole["before"] + whole["area"])
        return F.struct(
            epoch.cast("int").alias("epoch"),
            words.cast("long").alias("words"),
            _moment(F.col("segments"), demand).alias("position"),
        )

    found = F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last_epoch.cast("int"))), occurrence),
        lambda o: o["words"] > 0,
    )
    return each.select(
        "doc_id", "row_hash", "copy", "size", "source_size", "target", found.alias("occurrences")
    ).withColumn(
        "taken",
        F.aggregate("occurrences", F.lit(0).cast("long"), lambda total, o: total + o["words"]),
    )


def row_hash(docs: DataFrame) -> Column:
    """Tells rows of one ``doc_id`` apart by their content."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in ("text", "source")]).alias("row_hash")


def mix(
    docs: DataFrame, schedules: DataFrame | None = None, budget: float = BUDGET,
    epochs: float = EPOCHS, whole_documents: bool = True, seed: int = 17,
) -> DataFrame:
    """The documents as often as the mix takes them, range-sorted by training position.

    Returns the columns of ``docs`` and ``epoch``, ``words`` and ``position``.  Rows equal
    in ``doc_id``, ``text`` and ``source`` count as repeats of one row.  The plan is made without
    texts; a text then travels once to its position, and once more to meet the plan where that is
    too large to be copied.
    """
    plan = plan_mix(docs, schedules, budget, epochs, whole_documents, seed)
    key = F.struct(F.col("doc_id").alias("i"), F.col("row_hash").alias("h")).alias("_mix_key")
    taken = materialize(
        plan.where("taken > 0").select(key, F.explode("occurrences").alias("_mix_at"), "copy"), "taken"
    )
    repeated = materialize(
        taken.where("copy > 1").select(F.col("_mix_key").alias("_mix_twice")).distinct(), "repeated"
    )
    rows = docs.select("*", F.struct(F.col("`doc_id`").alias("i"), row_hash(docs).alias("h")).alias("_mix_key"))
    twice = F.col("_mix_key").eqNullSafe(F.col("_mix_twice"))
    # Only rows that occur more than once are reduced to one; the others are not shuffled for it.
    single = sized_join(rows, repeated, twice, "left_anti")
    firsts = (
        sized_join(rows, repeated, twice, "left_semi")
        .groupBy("_mix_key")
        .agg(*[F.first(f"`{c}`").alias(c) for c in docs.columns])
        .select(*single.columns)
    )
    taken = taken.select(F.col("_mix_key").alias("_mix_planned"), "_mix_at")
    found = sized_join(
        single.unionByName(firsts), taken, F.col("_mix_key").eqNullSafe(F.col("_mix_planned"))
    ).select(*[F.col(f"`{c}`") for c in docs.columns], "_mix_at")
    at = F.col("_mix_at")
    found = fresh(found, {"epoch": at["epoch"], "words": at["words"], "position": at["position"]})
    return found.drop("_mix_at").repartitionByRange("position", "doc_id", "epoch").sortWithinPartitions(
        "position", "doc_id", "epoch"
    )

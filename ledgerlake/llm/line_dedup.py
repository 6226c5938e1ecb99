"""Removal of boilerplate lines by the number of distinct sites that carry them.

One aggregation over lines merges a HyperLogLog sketch of sites per line hash, with the
line's first place.  Estimates well above the threshold decide; lines near it are counted
exactly.  Lines of at least ``min_sites`` sites are boilerplate: their first occurrence
(smallest ``doc_id``, then place) stays, all others go.

On a table with fewer than ``min_sites`` sources no line is boilerplate and nothing is removed.

Sketches have a fixed size and are merged before the shuffle, so a line of a third of all
rows costs no more than any other; the removal joins occurrences with the boilerplate
lines, which are broadcast only where their measured size allows it.

A line is the text between line feeds without surrounding ASCII white space; lines without
a word are never boilerplate.  Defined cases: a null text stays null; a null site is
a site of its own; rows with equal ``doc_id`` and ``text`` are one document; a null
``doc_id`` comes last; a document that loses all its words stays with the text it has left;
an empty table gives an empty result; further columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlake.llm.common import WORD, only, sized_join
from ledgerlake.sources.shared import materialize

MIN_SITES = 3
# 2^10 registers: estimates err by about 2 %; four times that counts as near.
LG_K = 10
NEAR = 0.1


def text_key(doc_id: Column, text: Column) -> Column:
    return F.struct(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"))


def trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc, place, line, site) of every line with a word; line is its 64-bit hash."""
    read = only(docs, "doc_id", "text", "source")
    text = F.col("text")
    # Null sites count as one more; names cannot clash with it because of the prefix.
    site = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return read.select(
        text_key(F.col("doc_id"), text).alias("doc"),
        site.alias("site"),
        F.posexplode(F.split(text, "\n")).alias("place", "content"),
    ).where(F.col("content").rlike(WORD)).select(
        "doc", "place", F.xxhash64(trimmed(F.col("content"))).alias("line"), "site"
    )


def boilerplate_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, first_doc, first_place) of the lines that at least ``min_sites`` sites carry."""
    null_last = F.struct(
        F.col("doc.doc_id").isNull().alias("unknown"), F.col("doc").alias("doc"),
        F.col("place").alias("place"),
    )
    estimated = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"),
        F.min(null_last).alias("first"),
    )
    slack = max(1, round(min_sites * NEAR))
    likely = materialize(estimated.where(F.col("sites") >= min_sites - slack), "lines")
    sure = likely.where(F.col("sites") > min_sites + slack)
    near = materialize(likely.where(F.col("sites") <= min_sites + slack), "lines")
    exact = (
        sized_join(lines.select("line", "site"), near.select("line"), ["line"])
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("exact"))
        .where(F.col("exact") >= min_sites)
    )
    spread = sure.select("line", "first").unionByName(near.join(exact, "line").select("line", "first"))
    return spread.select(
        "line", F.col("first.doc").alias("first_doc"), F.col("first.place").alias("first_place")
    )


def removals(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(doc, places): the lines that each document loses."""
    lines = occurrences(docs)
    spread = materialize(boilerplate_lines(lines, min_sites), "boilerplate")
    found = sized_join(lines.select("doc", "place", "line"), spread, ["line"])
    later = ~(F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("place") == F.col("first_place")))
    return found.where(later).groupBy("doc").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` without repeated boilerplate; adds ``n_lines`` and ``n_removed``."""
    gone = materialize(removals(docs, min_sites), "removals").select(
        F.col("doc").alias("_gone_doc"), F.col("places").alias("_gone_places")
    )
    key = text_key(F.col("`doc_id`"), F.col("`text`"))
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], key.alias("_doc_key"))
    joined = sized_join(rows, gone, F.col("_doc_key").eqNullSafe(F.col("_gone_doc")), "left")
    lines, places = F.split("text", "\n"), F.col("_gone_places")
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places)
    cleaned = F.array_join(F.transform(rest, lambda i: F.get(lines, i)), "\n")
    kept = F.when(places.isNull(), F.col("text")).otherwise(cleaned)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(
        *[kept.alias(c) if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).alias("n_removed"),
    )

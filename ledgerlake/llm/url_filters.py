"""URL filters as a temporal list join.

Lists change over time: dated entries add a pattern to a list or remove it.  The entries of a
(list, pattern) become validity intervals; a capture is evaluated against the entries active
at its fetch time.  Patterns are domains (which cover their subdomains) or URL prefixes of
the form ``host/path``, whose host is in any case and whose path is matched as written but for
empty steps; a capture is looked up by every parent domain of its host and every
parent path of its URL.

The as-of join is one merge in time order: per (list, pattern), interval bounds and lookups
are sorted together, and each lookup takes the last bound before it.  However long the
history of a pattern is, a lookup is one row of that merge and not one per interval.  Lookups are made
once per (URL, time) and meet only listed patterns.  A pattern with many lookups is
dealt over as many parts as its counted lookups ask for, each with a copy of its bounds.  Matches
are reduced to one row per lookup before they meet the captures again; tables are broadcast only
where their measured size allows it.

Defined cases: a URL without a host (or null) matches nothing; a null fetch time matches
nothing; entries with null pattern, list, date or action are ignored; of entries of one
(list, pattern) at one moment a removal wins; an entry that repeats the state changes nothing;
repeated captures are judged each; empty tables give no matches; further columns of the
captures are passed through, those named like an output column give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.common import fresh, sized_join
from ledgerlake.sources.shared import materialize

# Lookups of a pattern that one task sorts with the pattern's bounds.
PART_ROWS = 100_000

# Host, then path up to query and fragment.
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)(?::\d*)?([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def steps_of(url: Column) -> Column:
    """The steps of the URL's path without empty ones."""
    return F.filter(F.split(F.regexp_extract(url, _URL, 2), "/"), lambda s: s != "")


def patterns_of(url: Column) -> Column:
    """Every pattern that would cover the URL: its host's parents, then its path's parents."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    steps = steps_of(url)
    prefixes = F.when(F.size(steps) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps))),
            lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(host != "", F.array_distinct(F.concat(domains, prefixes))).otherwise(none)


def pattern_of(entry: Column) -> Column:
    """A list entry in the form of ``patterns_of``: host in lower case, path steps without empty ones."""
    steps = F.filter(F.split(entry, "/"), lambda s, i: (i == 0) | (s != ""))
    return F.array_join(
        F.transform(steps, lambda s, i: F.when(i == 0, F.lower(s)).otherwise(s)), "/"
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, valid_from, valid_to) from (list, pattern, action, at).

    ``action`` is ``add`` or ``remove``; ``valid_to`` is exclusive, null while still active.
    """
    known = entries.where(
        "list is not null and pattern is not null and at is not null and action in ('add', 'remove')"
    )
    states = known.groupBy("list", pattern_of(F.col("pattern")).alias("pattern"), "at").agg(
        F.min(F.col("action") == "add").alias("active")
    )
    order = Window.partitionBy("list", "pattern").orderBy("at")
    changed = states.withColumn("was", F.lag("active").over(order)).where(
        F.col("was").isNull() | (F.col("was") != F.col("active"))
    )
    return (
        changed.withColumn("valid_to", F.lead("at").over(order))
        .where("active")
        .select("list", "pattern", F.col("at").alias("valid_from"), "valid_to")
    )


def active_lists(lookups: DataFrame, intervals: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(url, fetched_at, list) of the ``lookups`` (url, fetched_at, pattern) whose pattern is on the list then."""
    listed = materialize(intervals.select("list", "pattern").distinct(), "listed")
    met = materialize(sized_join(lookups, listed.select("pattern").distinct(), ["pattern"]), "lookups")
    parts = F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts")
    parts = sized_join(listed, materialize(met.groupBy("pattern").agg(parts), "parts"), ["pattern"])
    part = F.pmod(F.xxhash64("url", "fetched_at"), F.col("parts"))
    asked = sized_join(met, parts, ["pattern"]).select(
        "list", "pattern", part.cast("int").alias("part"), F.col("fetched_at").alias("at"),
        F.lit(None).cast("boolean").alias("active"), "url",
    )
    bounds = sized_join(intervals, parts, ["list", "pattern"]).select(
        "list", "pattern", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "valid_from", "valid_to"
    )
    bound = F.inline(F.array(
        F.struct(F.col("valid_from").alias("at"), F.lit(True).alias("active")),
        F.struct(F.col("valid_to").alias("at"), F.lit(False).alias("active")),
    ))
    bounds = bounds.select("list", "pattern", "part", bound).where("at is not null")
    merged = bounds.withColumn("url", F.lit(None).cast("string")).unionByName(asked)
    # Bounds precede lookups of the same moment; an interval that ends as the next starts does not occur.
    in_order = Window.partitionBy("list", "pattern", "part").orderBy("at", F.col("active").isNull())
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last("active", ignorenulls=True).over(so_far)
    return merged.withColumn("on", last).where("url is not null and on").select(
        "url", F.col("at").alias("fetched_at"), "list"
    )


def filter_urls(captures: DataFrame, entries: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``captures`` (url, fetched_at, ...) with ``matched_lists`` and ``blocked``."""
    intervals = materialize(validity_intervals(entries), "intervals")
    asked = captures.select("url", "fetched_at").where("url is not null and fetched_at is not null")
    lookups = asked.distinct().select("url", "fetched_at", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    found = (
        active_lists(lookups, intervals, part_rows)
        .groupBy("url", "fetched_at")
        .agg(F.sort_array(F.collect_set("list")).alias("lists"))
        .select(F.col("url").alias("_hit_url"), F.col("fetched_at").alias("_hit_at"), "lists")
        .withColumnRenamed("lists", "_hit_lists")
    )
    found = materialize(found, "matches")
    same = (F.col("url") == F.col("_hit_url")) & (F.col("fetched_at") == F.col("_hit_at"))
    joined = sized_join(captures, found, same, "left").drop("_hit_url", "_hit_at")
    lists = F.coalesce("_hit_lists", F.array().cast("array<string>"))
    return fresh(joined, {"matched_lists": lists, "blocked": F.col("_hit_lists").isNotNull()}).drop(
        "_hit_lists"
    )

"""Exact n-gram Jaccard join by vertical partitioning.

A text is the set of its distinct word shingles.  The order of their 64-bit hashes is
the global n-gram order; cutting it at fixed points gives fragments, and every set falls
into the same fragments.  Two steps use them:

* *Candidates.*  A pair with similarity >= t differs in at most d = s(1-t)/t shingles
  (s: size of the smaller set), hence in at most d fragments.  From 90 percent on fragments stand in groups
  of three; with d < 2 * groups, some group has at most one fragment in which the sets
  differ, and a group is hashed into one signature per fragment left out.  Below, where more may
  differ, each of more than d fragments is a signature of its own.  Either way a
  pair of sets that links shares at least one: no link is lost.  A signature covers
  several shingles, so that frequent words, lines or passages alone rarely meet in one.
* *Overlap.*  Sets connected by signatures form a cluster.  Within it the token
  order is cut into fragments again; partial overlaps are counted per fragment and summed
  per pair.  Clusters too large for one task are compared in bands of size and blocks.

Equal sets are one class and are compared once.  Signatures are pre-aggregated by minimum
and maximum, so that a signature of a third of all rows does not meet in one task, and
pairs are never listed: each block returns a spanning forest of its links.

Defined cases: a text with fewer words than a shingle is one shingle of all its words;
a null text or one without words is an empty set and links with nothing; rows that share
a ``doc_id`` are one document (their links are joined); a null ``doc_id`` has no
component.  Repeated rows are kept, an empty table gives an empty result, and columns
beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import WORD, Memo, connected_components, only, sized_join
from ledgerlake.sources.shared import materialize

# Shingles that one task compares with each other.
BLOCK_SHINGLES = 4_000_000
_GROWTH = 1.5
# Fragments of a group, and how many more groups there are than could differ: below 90 percent, and from there on.
_GROUP, _GROUP_HIGH = 1, 3
_SPARE, _SPARE_HIGH = (7, 5), (5, 4)
# Shingles that a signature covers at least, while a set has enough groups.
LEAST = 2
_NONE = np.empty(0, np.uint64)
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers: two rounds of multiply and xor-shift."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class Shingler:
    """Sorted distinct hashes of the word shingles of a text."""

    def __init__(self, words: int):
        self.words = words
        self.hashes = Memo(xxhash.xxh3_64_intdigest)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.unique(self.every(text))

    def every(self, text: str | None) -> np.ndarray:
        """The hash of each shingle, in the order of the text."""
        # On bytes, lower() and split() know ASCII letters and ASCII white space only.
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
        if not words:
            return _NONE
        each = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = min(self.words, len(words))
        count = len(words) - width + 1
        rolled = each[:count]
        for k in range(1, width):
            rolled = mixed(rolled) + each[k : k + count]
        return mixed(rolled + _U(width))


class Signatures:
    """Signatures of a set of shingle hashes for similarity >= percent / 100.

    A choice (a fragment, or a group without one of its three) counts only with ``LEAST`` shingles or more; a
    group counts if all its choices do.  A set signs its first groups until more of them count
    than can differ (d, or d / 2 where two fragments of a group must), so a partner that signs as many groups or more shares a counting choice with it.  A set
    that runs out of groups signs all choices of all groups, which covers two such sets.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.group, self.spare = (_GROUP_HIGH, _SPARE_HIGH) if percent >= 90 else (_GROUP, _SPARE)
        self.tops = [max(1, -(-percent // (100 - percent)) - 1)]
        while self.tops[-1] < 2**40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * _GROWTH)))

    def differing(self, size: int) -> int:
        """Most shingles in which a set of this size differs from a larger one it links with."""
        return size * (100 - self.percent) // self.percent

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        size = len(hashes)
        if not size:
            return _NONE
        # As the smaller set of a pair, and as the larger one with partners of a class below.
        low = bisect.bisect_left(self.tops, -(-size * self.percent // 100))
        high = bisect.bisect_left(self.tops, size)
        parts = [self._of_class(hashes, c, min(size, self.tops[c])) for c in range(low, high + 1)]
        return np.unique(np.concatenate(parts))

    def _of_class(self, hashes: np.ndarray, at: int, smaller: int) -> np.ndarray:
        differing = self.differing(smaller)
        if not differing:
            return _NONE
        # Groups that can hold no equal choice: a fragment by one shingle, three by two of them.
        spoilt = 1 if self.group == 1 else 2
        more, of = self.spare
        groups = -(-more * (self.differing(self.tops[at]) // spoilt + 1) // of)
        fragments = self.group * groups
        step = 2**64 // fragments + 1
        starts = np.searchsorted(hashes, np.array([i * step for i in range(fragments)], np.uint64))
        ends = np.append(starts[1:], len(hashes))
        sums = np.concatenate([[_U(0)], np.cumsum(mixed(hashes ^ _U(0x5851F42D4C957F2D)))])
        places = np.arange(fragments, dtype=np.uint64) + _U(at << 40)
        marks = mixed(sums[ends] - sums[starts] + mixed(places)).reshape(-1, self.group)
        counts = (ends - starts).reshape(-1, self.group)
        # All of a group but the fragment left out; a group of one leaves none out.
        marks, counts = (x if self.group == 1 else x.sum(1)[:, None] - x for x in (marks, counts))
        dense = counts >= LEAST
        enough = np.cumsum(dense.all(1)) > differing // spoilt
        if enough.any():
            dense[int(np.argmax(enough)) + 1 :] = False
        else:
            dense[:] = True
        return mixed(marks)[dense]


def _keys(hashes: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(hashes.tobytes())
    first, second = np.frombuffer(digest, np.int64)
    return int(first), int(second)


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, signatures) of every row; k1 and k2 identify the set."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, sign = Shingler(words), Signatures(percent)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle(x) for x in part.column("text").to_pylist()]
                keys = [_keys(s) for s in sets]
                signed = [sign(s) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in signed])])
                flat = np.concatenate([*signed, _NONE]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([k[0] for k in keys], pa.int64()),
                        pa.array([k[1] for k in keys], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "signatures"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(
        compute, "doc_id long, n_shingles long, k1 long, k2 long, signatures array<long>"
    )


class _Forest:
    def __init__(self, size: int):
        self.parent = list(range(size))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))])


def _reach(overlap: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (sizes + others - overlap)


def block_links(
    sets: list[np.ndarray], sides: np.ndarray, percent: int, fragments: int = 4,
    work: int = 4_000_000,
) -> list[tuple[int, int]]:
    """Spanning forest of the links between the sets of side 0 and those of side 1.

    Side 2 stands on both sides.  A few central sets are compared with all others first,
    which joins groups of near copies at once.  Then the n-gram order is cut into fragments,
    the overlaps within each are counted from its postings, and summed per pair; about
    ``work`` counts are held at a time.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    forest = _Forest(count)
    tokens, codes, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), sizes)
    shared = often[codes] > 1
    owner, codes = owner[shared], codes[shared]
    starts = np.searchsorted(owner, np.arange(count + 1))
    weight = np.bincount(owner, often[codes], count) / np.maximum(sizes, 1)

    def may_pair(x: int) -> np.ndarray:
        return (sides + sides[x] != 2 * sides[x]) | (sides[x] == 2)

    left = np.ones(count, bool)
    for _ in range(count if count <= 16 else 8):
        at = int(np.argmax(np.where(left, weight, -1.0)))
        left[at] = False
        flags = np.zeros(len(tokens), bool)
        flags[codes[starts[at] : starts[at + 1]]] = True
        overlap = np.bincount(owner, flags[codes], count).astype(np.int64)
        hit = _reach(overlap, sizes, sizes[at], percent) & may_pair(at)
        hit[at] = False
        for other in np.flatnonzero(hit):
            forest.link(at, int(other))
        # A set met by the centre no longer makes a good centre itself.
        left &= ~hit if count > 16 else left
        if not left.any():
            break
    if count <= 16 or len(set(forest.roots().tolist())) == 1:
        return forest.links

    by_token = owner[np.argsort(codes, kind="stable")]
    token_starts = np.concatenate([[0], np.cumsum(often * (often > 1))])
    cost = np.bincount(owner, often[codes], count)
    cuts = [len(tokens) * k // fragments for k in range(1, fragments + 1)]
    first = 0
    while first < count:
        rows = int(np.searchsorted(np.cumsum(cost[first:]), work, "right"))
        rows = max(1, min(rows, work // count, count - first))
        mine = np.arange(first, first + rows)
        a, b = starts[first], starts[first + rows]
        total = np.zeros(rows * count, np.int64)
        done = -1
        for cut in cuts:
            here = np.flatnonzero((codes[a:b] < cut) & (codes[a:b] > done)) + a
            done = cut - 1
            lengths = often[codes[here]]
            ends = np.cumsum(lengths)
            inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
            others = by_token[np.repeat(token_starts[codes[here]], lengths) + inner]
            cells = np.repeat((owner[here] - first) * count, lengths) + others
            total += np.bincount(cells, minlength=rows * count)
        hits = _reach(total.reshape(rows, count), sizes[mine][:, None], sizes[None, :], percent)
        hits &= (sides[mine][:, None] != sides[None, :]) | (sides[None, :] == 2)
        roots = forest.roots()
        hits &= roots[mine][:, None] != roots[None, :]
        for x, y in zip(*np.nonzero(hits), strict=True):
            forest.link(int(mine[x]), int(y))
        first += rows
    return forest.links


def signature_clusters(signed: DataFrame, key: str) -> DataFrame:
    """(key, component) of the keys that share a ``signature`` with another key.

    Rows of one signature are pre-aggregated and linked as a star, so that a signature of
    a third of all rows neither meets in one task nor is paired up.
    """
    shared = (
        signed.groupBy("signature")
        .agg(F.min(key).alias("a"), F.max(key).alias("b"))
        .where("a < b")
        .select("signature", "a")
    )
    shared = materialize(shared, "signatures")
    stars = sized_join(signed, shared, ["signature"]).where(F.col("a") != F.col(key))
    edges = stars.select("a", F.col(key).alias("b")).distinct()
    return connected_components(edges).withColumnRenamed("node", key)


def _cluster_members(sets: DataFrame, block_shingles: int, percent: int) -> DataFrame:
    """(rep, k1, k2, cluster, band, blocks, block) of every class that may link with another one.

    A cluster too large for one task is cut into bands of two neighbouring size steps.  Sets
    that link differ in size by at most one step, so each such pair meets in a band; bands
    without a set of their lower step would only repeat the next one.
    """
    # Copies of one set have one k1, so only signatures of different sets remain.
    signed = sets.where("n_shingles > 0").select("k1", F.explode("signatures").alias("signature"))
    clusters = signature_clusters(signed, "k1")
    classes = (
        sets.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"))
    )
    members = materialize(sized_join(classes, clusters, ["k1"]), "members").withColumnRenamed(
        "component", "cluster"
    )
    whole = members.groupBy("cluster").agg((F.sum("n") > block_shingles / 2).alias("large"))
    # A little more than the largest ratio of sizes, against rounding.
    step = math.log(100 / percent) * (1 + 1e-6)
    at = F.floor(F.log("n") / F.lit(step)).cast("int")
    own = F.when(F.col("large"), at).otherwise(F.lit(0))
    bands = F.when(F.col("large"), F.array(own - 1, own)).otherwise(F.array(own))
    banded = members.join(whole, "cluster").select(
        "rep", "k1", "k2", "n", "cluster", own.alias("own"), F.explode(bands).alias("band")
    )
    sizes = (
        banded.groupBy("cluster", "band")
        .agg(
            F.ceil(F.sum("n") / F.lit(block_shingles / 2)).cast("int").alias("blocks"),
            F.max(F.col("own") == F.col("band")).alias("needed"),
        )
        .where("needed")
        .select("cluster", "band", "blocks")
    )
    return banded.join(sizes, ["cluster", "band"]).select(
        "rep", "k1", "k2", "cluster", "band", "blocks",
        F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
    )


def links(
    docs: DataFrame, sets: DataFrame, words: int, percent: int,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(a, b): links between class representatives whose components are those of all links."""
    members = materialize(_cluster_members(sets, block_shingles, percent), "members")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingle(x) for x in part.column("text").to_pylist()]
                keys = list(zip(part.column("k1").to_pylist(), part.column("k2").to_pylist()))
                keep = pa.array([_keys(s) == k for s, k in zip(found, keys, strict=True)])
                content = pa.array([s.tobytes() for s in found], pa.binary())
                columns = [part.column(c) for c in ("rep", "cluster", "band", "blocks", "block")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, content],
                    names=["rep", "cluster", "band", "blocks", "block", "shingles"],
                ).filter(keep)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string"))
    found = sized_join(texts, members, ["rep"]).select(
        "text", "k1", "k2", "rep", "cluster", "band", "blocks", "block"
    )
    found = found.mapInArrow(
        sets_of, "rep long, cluster long, band int, blocks int, block int, shingles binary"
    )
    # Each block meets every block once; a cluster of one block is compared within it.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")),
    )
    dealt = found.withColumn("pair", F.explode(pairs)).select(
        "cluster", "band", "pair.i", "pair.j", "rep", "block", "shingles"
    )

    def compare(table: pa.Table) -> pa.Table:
        frame = table.to_pandas().sort_values(["rep", "shingles"]).drop_duplicates(
            ["rep", "shingles"]
        )
        reps = frame["rep"].to_numpy()
        i, j = frame["i"].iloc[0], frame["j"].iloc[0]
        sides = np.full(len(frame), 2) if i == j else (frame["block"] == j).to_numpy().astype(int)
        contents = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        found = block_links(contents, sides, percent) if len(frame) > 1 else []
        return pa.table(
            {
                "a": pa.array([int(reps[x]) for x, _ in found], pa.int64()),
                "b": pa.array([int(reps[y]) for _, y in found], pa.int64()),
            }
        )

    return dealt.groupBy("cluster", "band", "i", "j").applyInArrow(compare, "a long, b long")


def _document_links(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the representatives of the classes that rows of one ``doc_id`` are in."""
    key = F.struct("k1", "k2")
    known = sets.where("n_shingles > 0 and doc_id is not null").select("doc_id", "k1", "k2")
    several = known.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    several = materialize(several.where("low <> high").select("doc_id"), "several")
    rows = sized_join(known, several, ["doc_id"]).distinct()
    rows = materialize(classes.join(rows, ["k1", "k2"]).select("doc_id", "class_id"), "several")
    heads = rows.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    return sized_join(rows, heads, ["doc_id"]).select("a", F.col("class_id").alias("b"))


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES
) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) per row of ``docs``.

    ``class_id`` is the smallest ``doc_id`` with the same set, ``component_id`` the smallest
    one reachable over links.
    """
    docs = only(docs, "doc_id", "text")
    sets = materialize(shingle_sets(docs, words, percent), "shingles")
    classes = (
        sets.where("n_shingles > 0 and doc_id is not null")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("class_id"))
    )
    found = links(docs, sets, words, percent, block_shingles)
    linked = connected_components(found.unionByName(_document_links(sets, classes)))
    classes = (
        classes.join(linked.withColumnRenamed("node", "class_id"), "class_id", "left")
        .select("k1", "k2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )
    empty = F.col("n_shingles") == 0
    rows = sets.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    known = F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.when(known, F.col("class_id"))).alias("class_id"),
        F.when(empty, F.col("doc_id"))
        .otherwise(F.when(known, F.col("component_id")))
        .alias("component_id"),
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that a document of smaller ``doc_id`` makes redundant.

    Of each group the document with the smallest ``doc_id`` stays, in one row; rows
    without text or ``doc_id`` stay as they are.
    """
    found = near_duplicates(docs, words, percent).where("n_shingles > 0 and doc_id is not null")
    found = materialize(found.select("doc_id", "component_id"), "components")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    several = found.where("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    several = materialize(several.where("n > 1").select("doc_id"), "several")
    names = [F.col(f"`{c}`") for c in docs.columns]
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    worded &= F.col("doc_id").cast("long").isNotNull()
    kept = sized_join(docs.where(worded), materialize(gone, "redundant"), ["doc_id"], "left_anti")
    # Maps have no hash; rows that differ in them only are equal here.
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    one = (
        sized_join(kept, several, ["doc_id"], "left_semi")
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(*names), F.xxhash64(*hashed)).alias("_row"))
        .select("_row.*")
    )
    single = sized_join(kept, several, ["doc_id"], "left_anti").select(*names)
    return single.unionByName(one).unionByName(docs.where(~worded))

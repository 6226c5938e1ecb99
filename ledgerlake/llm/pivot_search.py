"""Exact top-k inner products by elimination with a table of distances to pivots.

Every vector keeps its distances to a fixed set of pivots.  For a query q and a vector x the
triangle inequality gives ``d(q, x) >= max over pivots p of |d(q, p) - d(x, p)|``, and with
``2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2`` an upper bound of the score.  Rows are dealt into
blocks of neighbouring vectors by ranges of (nearest pivot, distance to it), which any one
vector or cluster cannot outgrow.

1. The pivots are chosen far from one another among a bounded sample of distinct vectors.
2. A block answers its own queries; the k-th best score becomes the query's threshold.
3. The ranges of a block's pivot distances rule out whole blocks per query.
4. The blocks that are left evaluate a query's candidates in the order of their bounds and
   stop at the first bound below the k-th best score; the best of all blocks are merged.

Nothing is approximate: the sample only decides how much is ruled out.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do those with a scaled component of 2^31 or more or a squared length of 2^61 or more, whose products don't
fit a long; shorter vectors count as padded with zeros.  A query meets every row but itself, so
rows that share its id, or repeat it, are candidates, and each repeated query row is answered.
Rows with a null id are candidates that come last among equal scores.  Equal ids and scores
take any order.  An empty table, or one without queries, gives an empty result.  Only the id
and the vector are read, so further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.common import sized_join
from ledgerlake.sources.shared import materialize

PIVOTS = 32
# Distinct rows the pivots are chosen from.
SAMPLE = 4096
# Vectors of a block, and queries that meet a block in one task.
BLOCK_ROWS = 2**14
CHUNK_QUERIES = 2**16
# Distances are kept as floats; bounds are widened by more than their rounding.
_ROUNDING = 1e-6

_MEASURED = "vec_id long, ints array<long>, wanted boolean, dists array<float>, nearest int, near float"
_HOME = """block int, row long, query_id long, ints array<long>, dists array<float>, size double,
kth long, hits array<struct<vec_id: long, other: long, score: long>>, lows array<float>, highs array<float>"""
_HITS = "row long, query_id long, vec_id long, other long, score long"


def scaled(vectors: DataFrame, vec_id: str, vector: str, scale: int, wanted: Column) -> DataFrame:
    """(vec_id, ints, wanted) of the vectors that take part: floor(scale * component)."""
    products = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.coalesce(wanted, F.lit(False)).alias("wanted"),
        F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double") * float(scale)).alias("parts"),
    )
    fits = F.forall("parts", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < 2.0**31), F.lit(False)))
    length = F.aggregate("parts", F.lit(0.0), lambda total, x: total + F.floor(x) * F.floor(x).cast("double"))
    return (
        products.where(F.col("parts").isNotNull() & fits)
        .where(length < 2.0**61)
        .select("vec_id", F.transform("parts", lambda x: F.floor(x)).alias("ints"), "wanted")
    )


def _matrix(lists: pa.Array, width: int, kind=np.int64) -> np.ndarray:
    """Rows of a list array, padded with zeros to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(lists), width).astype(kind)
    out = np.zeros((len(lists), width), kind)
    at = np.arange(width) < sizes[:, None]
    out[at] = values
    return out


def _lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)),
        pa.array(matrix.ravel()),
    )


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances by direct differences, which do not cancel."""
    out = np.empty((len(vectors), len(pivots)), np.float32)
    exact = vectors.astype(np.float64)
    for i, pivot in enumerate(pivots):
        gap = exact - pivot
        out[:, i] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from one another: each next one is the farthest from those chosen."""
    if not len(sample):
        return sample.astype(np.float64)
    sample = sample.astype(np.float64)
    gap = ((sample - sample.mean(0)) ** 2).sum(1)
    chosen, gaps = [], np.full(len(sample), np.inf)
    for _ in range(min(count, len(sample))):
        at = int(np.argmax(gap if not chosen else gaps))
        if chosen and gaps[at] == 0:
            break
        chosen.append(at)
        gaps = np.minimum(gaps, ((sample - sample[at]) ** 2).sum(1))
    return sample[chosen]


class Block:
    """Vectors of one block with their pivot distances; answers queries exactly."""

    def __init__(self, table: pa.Table, width: int, pivots: int):
        self.ints = _matrix(table["ints"], width)
        self.dists = _matrix(table["dists"], pivots, np.float32)
        self.rows = table["row"].to_numpy()
        ids = table["vec_id"].combine_chunks()
        self.missing = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        real = self.ints.astype(np.float64)
        self.sizes = np.einsum("ij,ij->i", real, real)
        # Sums of products below 2^52 are exact in floating point, which multiplies faster.
        self.real = real if self.sizes.max(initial=0) < 2.0**52 else None

    def scores(self, at: np.ndarray, query: np.ndarray, size: float) -> np.ndarray:
        if self.real is not None and size < 2.0**52:
            return (self.real[at] @ query.astype(np.float64)).astype(np.int64)
        return self.ints[at] @ query

    def best(self, row: int, query: np.ndarray, dists: np.ndarray, size: float, kth: int | None, k: int):
        """(vec_id, row, score) of at most k best candidates with a score of ``kth`` or more."""
        gaps = np.abs(self.dists - dists).max(1, initial=0).astype(np.float64)
        reach = np.maximum(gaps - _ROUNDING * (np.sqrt(self.sizes) + np.sqrt(size)) * 4, 0)
        bounds = (size + self.sizes - reach**2) / 2 + _ROUNDING * (size + self.sizes) + 1
        bounds[self.rows == row] = -np.inf
        live = np.flatnonzero(bounds >= kth) if kth is not None else np.flatnonzero(bounds > -np.inf)
        order = live[np.argsort(-bounds[live], kind="stable")]
        places, found, start, step = [], [], 0, max(64, 4 * k)
        while start < len(order) and (kth is None or bounds[order[start]] >= kth):
            part = order[start : start + step]
            places.append(part)
            found.append(self.scores(part, query, size))
            start, step = start + step, step * 2
            seen = np.concatenate(found)
            if len(seen) >= k:
                kth = max(int(np.partition(seen, len(seen) - k)[len(seen) - k]), kth if kth is not None else -(2**63))
        if not places:
            return []
        place, score = np.concatenate(places), np.concatenate(found)
        if kth is not None:
            place, score = place[score >= kth], score[score >= kth]
        order = np.lexsort((self.rows[place], self.ids[place], self.missing[place], -score))[:k]
        return [
            (None if self.missing[p] else int(self.ids[p]), int(self.rows[p]), int(s))
            for p, s in zip(place[order], score[order])
        ]


def _home(width: int, pivots: int, k: int):
    def home(table: pa.Table) -> pa.Table:
        """A block's own queries with their best candidates of the block, and one row about the block."""
        block = Block(table, width, pivots)
        wanted = table["wanted"].to_numpy()
        number = table["block"][0].as_py()
        out = {name: [] for name in ("block", "row", "query_id", "ints", "dists", "size", "kth", "hits", "lows", "highs")}

        def add(**values):
            for name in out:
                out[name].append(values.get(name))

        add(block=number, size=float(block.sizes.max()), lows=block.dists.min(0), highs=block.dists.max(0))
        for i in np.flatnonzero(wanted):
            hits = block.best(block.rows[i], block.ints[i], block.dists[i], block.sizes[i], None, k)
            add(
                block=number, row=int(block.rows[i]), query_id=int(block.ids[i]), ints=block.ints[i],
                dists=block.dists[i], size=float(block.sizes[i]), kth=hits[-1][2] if len(hits) == k else None,
                hits=[{"vec_id": v, "other": o, "score": s} for v, o, s in hits],
            )
        hit = pa.list_(pa.struct([("vec_id", pa.int64()), ("other", pa.int64()), ("score", pa.int64())]))
        kinds = {
            "block": pa.int32(), "row": pa.int64(), "query_id": pa.int64(), "ints": pa.list_(pa.int64()),
            "dists": pa.list_(pa.float32()), "size": pa.float64(), "kth": pa.int64(), "hits": hit,
            "lows": pa.list_(pa.float32()), "highs": pa.list_(pa.float32()),
        }
        return pa.table({name: pa.array(values, kinds[name]) for name, values in out.items()})

    return home


def _away(width: int, pivots: int, k: int):
    def away(queries: pa.Table, table: pa.Table) -> pa.Table:
        """The best candidates of a block for queries of other blocks."""
        out = {"row": [], "query_id": [], "vec_id": [], "other": [], "score": []}
        if len(table) and len(queries):
            block = Block(table, width, pivots)
            ints, dists = _matrix(queries["ints"], width), _matrix(queries["dists"], pivots, np.float32)
            rows, ids = queries["row"].to_numpy(), queries["query_id"].to_numpy()
            sizes, kths = queries["size"].to_numpy(), queries["kth"].to_pylist()
            for i in range(len(queries)):
                for vec_id, other, score in block.best(rows[i], ints[i], dists[i], sizes[i], kths[i], k):
                    for name, value in zip(out, (rows[i], ids[i], vec_id, other, score)):
                        out[name].append(value)
        return pa.table({name: pa.array(values, pa.int64()) for name, values in out.items()})

    return away


def top_k(
    vectors: DataFrame, wanted: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 1024, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS, chunk_queries: int = CHUNK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every ``wanted`` row.

    Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors, vec_id, vector, scale, wanted & F.col(f"`{vec_id}`").isNotNull())
    about = rows.agg(
        F.count("*").alias("n"), F.max(F.size("ints")).alias("width"), F.count_if("wanted").alias("queries")
    ).first()
    if not about["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = about["width"]
    # The sample is bounded: SAMPLE distinct vectors of least hash.
    sampled = rows.select("ints").groupBy("ints").agg(F.xxhash64("ints").alias("hash")).orderBy("hash").limit(SAMPLE)
    sample = _matrix(sampled.select("ints").toArrow()["ints"], width)
    chosen = choose_pivots(sample, pivots)
    pivots = len(chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _matrix(batch["ints"], width)
            dists = _distances(ints, chosen)
            nearest = dists.argmin(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], _lists(ints), batch["wanted"], _lists(dists), pa.array(nearest),
                 pa.array(dists[np.arange(len(dists)), nearest])],
                names=["vec_id", "ints", "wanted", "dists", "nearest", "near"],
            )

    measured = rows.mapInArrow(measure, _MEASURED)
    blocks = materialize(
        measured.repartitionByRange(-(-about["n"] // block_rows), "nearest", "near", "vec_id").select(
            "vec_id", "ints", "wanted", "dists",
            F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("row"),
        ),
        "blocks",
    )
    home = materialize(blocks.groupBy("block").applyInArrow(_home(width, pivots, k), _HOME), "home")
    ranges = home.where("lows is not null").select("block", F.col("size").alias("longest"), "lows", "highs")
    queries = home.where("row is not null").drop("lows", "highs").withColumnRenamed("block", "own")
    last = ranges.agg(F.max("block")).first()[0]
    met = queries.drop("hits").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last)))).where("block <> own")
    # The least distance a member of the block can have, by the pivot that separates best.
    below = F.zip_with("lows", "dists", lambda low, d: low - d)
    above = F.zip_with("dists", "highs", lambda d, high: d - high)
    gap = F.array_max(F.zip_with(below, above, lambda a, b: F.greatest(a, b))).cast("double")
    total = F.col("size") + F.col("longest")
    reach = F.greatest(gap - F.lit(4 * _ROUNDING) * (F.sqrt("size") + F.sqrt("longest")), F.lit(0.0))
    bound = (total - reach * reach) / 2 + F.lit(_ROUNDING) * total + 1
    left = sized_join(met, ranges, ["block"]).where(F.col("kth").isNull() | (bound >= F.col("kth")))
    chunks = -(-about["queries"] // chunk_queries)
    asked = left.select(
        "block", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"),
        "row", "query_id", "ints", "dists", "size", "kth",
    )
    held = blocks.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "vec_id", "row", "ints", "dists"
    )
    found = (
        asked.groupBy("block", "chunk")
        .cogroup(held.groupBy("block", "chunk"))
        .applyInArrow(_away(width, pivots, k), _HITS)
    )
    near = queries.select("row", "query_id", F.inline("hits"))
    place = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return (
        near.unionByName(found)
        .withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

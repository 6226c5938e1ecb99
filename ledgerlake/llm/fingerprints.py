"""SimHash fingerprints of whole texts, and the search for close ones.

*Fingerprint.*  Terms are word shingles (five words); texts under 256 code points use
five-character shingles, those up to 512 both.  Each term's hash votes on every bit with the term's
weight, 1 + ln(count); the signs of the sums are the bits.  Equal texts have equal fingerprints.

*Search.*  For radius r the bits are cut into b > r blocks.  Two fingerprints that
differ in at most r bits agree in at least b - r blocks, so for each choice of b - r blocks a
table keyed by those blocks brings them together.  The number of tables is fixed by r and b (45
tables of 25 bits for 8 and 10), whatever the number of rows.  The fingerprints of a bucket are compared by
their true distance.  A crowded bucket is spread over many tasks: its rows are first linked to a
few centres, then dealt into blocks by centre; blocks of one centre need not meet.

*Near copies.*  Texts of Jaccard similarity s differ in about bits * acos(2s / (1 + s)) / pi bits: 4 of
128 at 0.99, 9 at 0.95, 19 at 0.8.  The search is exact for its radius; which near copies lie within it is
a matter of chance, as README states by similarity.  ``near_groups`` goes down to 0.8 (27 bits) with
keys of sampled bits; its tables grow with the rows, so it is for corpora of some million texts.

Defined cases: null texts are empty; an empty text has fingerprint 0; rows with null or equal
``doc_id`` are ordered by text; a single document is its own successor; an empty table gives
an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import connected_components, only, sized_join
from ledgerlake.llm.ngram_join import Shingler, _Forest, mixed
from ledgerlake.sources.shared import materialize

BITS = 128
WORDS = 5
RADIUS = 8
BLOCKS = 10
# Fingerprints that one task compares with each other.
BLOCK_ROWS = 2_000
# Rows that the others of a crowded bucket are linked to first.
CENTRES = 8
# Sampled bits (``near_groups``): the similarity that near copies have at least, the chance that two
# fingerprints at its radius share a key, and the rows of a bucket, about.
SIMILARITY = 0.8
RECALL = 0.99
LEAST_SAMPLE = 4
BUCKET_ROWS = 2_000
# Buckets of up to so many rows list their links, larger ones give a spanning forest.
_FEW = 8
_SHORT, _MEDIUM, _GRAM = 256, 512, 5
_SCALE = 8
_U = np.uint64


class SimHash:
    """128-bit fingerprints as 16 bytes."""

    def __init__(self, words: int = WORDS, bits: int = BITS):
        self.shingle, self.bits = Shingler(words), bits

    def _characters(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        width = min(_GRAM, len(points))
        rolled = mixed(points[: len(points) - width + 1] + _U(1 << 40))
        for k in range(1, width):
            rolled = mixed(rolled + points[k : len(points) - width + 1 + k])
        return rolled

    def __call__(self, text: str) -> bytes:
        parts = []
        if text and len(text) < _MEDIUM:
            parts.append(self._characters(text))
        if len(text) >= _SHORT:
            parts.append(self.shingle.every(text))
        terms = np.concatenate(parts) if parts else np.empty(0, _U)
        if not len(terms):
            return bytes(self.bits // 8)
        terms, counts = np.unique(terms, return_counts=True)
        lanes = [mixed(terms + _U(0x632BE59BD9B4E019 * k % 2**64)) for k in range(self.bits // 64)]
        bits = np.unpackbits(np.stack(lanes, 1).view(np.uint8), axis=1)
        # Bytes hold sums of up to 255 rows.
        whole = len(bits) // 255 * 255
        sums = bits[whole:].sum(0, dtype=np.int64)
        if whole:
            sums += bits[:whole].reshape(-1, 255, self.bits).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        votes, total = _SCALE * sums, _SCALE * len(bits)
        often = counts > 1
        if often.any():
            extra = np.rint(_SCALE * np.log(counts[often])).astype(np.int64)
            votes += extra @ bits[often].astype(np.int64)
            total += int(extra.sum())
        return np.packbits(2 * votes > total).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Cosine that the share of differing bits stands for; unrelated texts are near 0."""
    bits = 8 * len(a)
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * differing / bits))


def _ranges(docs: DataFrame, count: int) -> list[int]:
    """Upper bounds of ``count`` ranges of ``doc_id`` with about as many rows each, ascending."""
    shares = [(i + 1) / count for i in range(count - 1)]
    if not shares:
        return []
    found = docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]
    return sorted(set(found or []))


def _dealt(docs: DataFrame) -> DataFrame:
    """(doc_id, text, range, borrowed): rows by range of descending ``doc_id``.

    The first row of a range is also lent to the range before it (the first of all to the
    last one), so that every row finds its successor without a global sort.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = np.array(_ranges(docs, 2 * partitions), np.int64)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series) -> pd.Series:
        known = doc_id.notna()
        place = np.full(len(doc_id), len(bounds) + 1)
        # Nulls come last, with the smallest ids.
        ids = doc_id[known].to_numpy(np.int64)
        place[known.to_numpy()] = len(bounds) - np.searchsorted(bounds, ids, "left")
        return pd.Series(np.minimum(place, len(bounds)))

    ranged = docs.withColumn("range", range_of("doc_id"))
    # As many rows as ranges.
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head")).sort("range").collect()
    lent = [(h["head"], heads[i - 1]["range"]) for i, h in enumerate(heads)]
    lent = spark.createDataFrame(lent, "head long, lender int")
    marked = ranged.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("range").alias("range"), F.lit(False).alias("borrowed"))
    other = F.struct(F.col("lender").alias("range"), F.lit(True).alias("borrowed"))
    places = F.when(F.col("lender").isNull(), F.array(own)).otherwise(F.array(own, other))
    return (
        marked.select("doc_id", "text", F.explode(places).alias("at"))
        .select("doc_id", "text", "at.range", "at.borrowed")
        .repartition(partitions, "range")
        .sortWithinPartitions("range", "borrowed", F.desc_nulls_last("doc_id"), "text")
    )


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def edit_fingerprints(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Fingerprints of each text and of its edited text.

    The edited text ends in the beginning of the next document (by descending ``doc_id``,
    the first following the last) instead of its own second half.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHash(words, bits)
        last: tuple | None = None  # range, doc_id, text, fingerprint
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, at, borrowed in zip(
                *[c.to_pylist() for c in batch.columns], strict=True
            ):
                text = text or ""
                mark = simhash(text)
                if last is not None and last[0] == at:
                    _, own_id, own, own_mark = last
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    edited_mark = simhash(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append(
                        (
                            own_id, len(own), digest, own_mark.hex(), edited_mark.hex(),
                            likeness(own_mark, edited_mark), likeness(own_mark, mark),
                        )
                    )
                last = None if borrowed else (at, doc_id, text, mark)
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _dealt(read).mapInArrow(compute, _EDITED)


def fingerprints(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint) of each row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        simhash = SimHash(words, bits)
        for batch in batches:
            marks = [simhash(x or "").hex() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(marks, pa.string())],
                names=["doc_id", "fingerprint"],
            )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(compute, "doc_id long, fingerprint string")


def _tables(bits: int, radius: int, blocks: int) -> list[list[int]]:
    """For each table, the bits of its key."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [
        [bit for block in chosen for bit in range(cuts[block], cuts[block + 1])]
        for chosen in combinations(range(blocks), blocks - radius)
    ]


def _bucket_links(lanes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the rows within the radius.

    A few rows are compared with all others first, which joins large groups at once; rows
    of such a group are then compared with those outside it only.
    """
    count = len(lanes)
    label = np.arange(count)
    links: list[tuple[int, int]] = []

    def join(at: int, others: np.ndarray) -> None:
        met, first = np.unique(label[others], return_index=True)
        new = met != label[at]
        if new.any():
            links.extend((at, int(other)) for other in others[first[new]])
            label[np.isin(label, met[new])] = label[at]

    for at in range(0, count, max(1, count // 8)):
        join(at, np.flatnonzero(np.bitwise_count(lanes ^ lanes[at]).sum(1) <= radius))
    order = np.argsort(label, kind="stable")
    sizes = np.bincount(label, minlength=count)
    ranked = label[order]
    kind = np.uint8 if 8 * lanes.itemsize * lanes.shape[1] < 256 else np.uint16
    columns = [np.ascontiguousarray(c) for c in lanes[order].T]
    step = max(1, min(256, 250_000 // max(1, count)))
    first = 0
    while first < count:
        whole = int(sizes[ranked[first]])
        # Large groups come chunk by chunk, other rows may share one.
        end = int(np.searchsorted(ranked, ranked[first], "right"))
        stop = min(first + step, end if whole > step else count)
        after = end if whole > step else first
        differing = np.zeros((stop - first, count - after), kind)
        for column in columns:
            differing += np.bitwise_count(column[first:stop, None] ^ column[None, after:])
        near = differing <= radius
        for x in np.flatnonzero(near.any(1)).tolist():
            join(int(order[first + x]), order[np.flatnonzero(near[x]) + after])
        first = stop
    return links


def _lanes(marks: pa.Array) -> np.ndarray:
    """One row of 64-bit numbers per fingerprint."""
    raw = marks.to_pylist()
    if not raw:
        return np.empty((0, 1), _U)
    points = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    whole = -(-points.shape[1] // 8) * 8
    return np.pad(points, ((0, 0), (0, whole - points.shape[1]))).view(_U)


def _nodes(lanes: np.ndarray) -> np.ndarray:
    node = np.zeros(len(lanes), _U)
    for column in lanes.T:
        node = mixed(node + column)
    return node.view(np.int64)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = pa.array([bytes.fromhex(x) for x in batch.column("fingerprint").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("fingerprint"), marks, pa.array(_nodes(_lanes(marks)))],
            names=["fingerprint", "mark", "node"],
        )


def _keyed(distinct: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(bucket, mark): each fingerprint in its bucket of every table."""
    shift = _U(math.comb(blocks, radius).bit_length())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("mark")
            raw = marks.to_pylist()
            if not raw:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)
            for number, table in enumerate(_tables(bits.shape[1], radius, blocks)):
                packed = np.packbits(bits[:, table], axis=1)
                whole = np.zeros((len(raw), -(-packed.shape[1] // 8) * 8), np.uint8)
                whole[:, : packed.shape[1]] = packed
                key = np.full(len(raw), number, _U)
                for part in whole.view(_U).T:
                    key = mixed(key + part)
                # Buckets of different tables are different.
                key = (key >> shift << shift) + _U(number)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), marks], names=["bucket", "mark"])

    return distinct.select("mark").mapInArrow(keys, "bucket long, mark binary")


def _crowded(keyed: DataFrame, rows: int, block_rows: int) -> DataFrame:
    """(bucket) of more than ``block_rows`` rows.

    Bins of many buckets are counted first, so that only those of full bins are counted singly.
    """
    bins = max(1, -(-4 * rows // block_rows))
    place = F.pmod(F.xxhash64("bucket"), F.lit(bins)).alias("bin")
    full = keyed.groupBy(place).agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("bin")
    full = materialize(full, "bins")
    inside = sized_join(keyed.select("bucket", place), full, ["bin"], "left_semi")
    counted = inside.groupBy("bucket").agg(F.count("*").alias("n"))
    return materialize(counted.where(F.col("n") > block_rows).select("bucket"), "crowded")


def _pairs(nodes: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[found[:, 0]], pa.int64()), pa.array(nodes[found[:, 1]], pa.int64())], names=["a", "b"]
    )


def _sorted_links(buckets: np.ndarray, lanes: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links within each run of equal buckets."""
    edges = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
    starts = np.concatenate([[0], edges])
    lengths = np.diff(np.append(starts, len(buckets)))
    few = np.repeat(lengths <= _FEW, lengths)
    found = []
    for k in range(1, _FEW):
        first = np.flatnonzero((buckets[k:] == buckets[:-k]) & few[k:])
        near = np.bitwise_count(lanes[first] ^ lanes[first + k]).sum(1) <= radius
        found.append(np.stack([first[near], first[near] + k], 1))
    for run in np.flatnonzero(lengths > _FEW).tolist():
        at = int(starts[run])
        inner = _bucket_links(lanes[at : at + int(lengths[run])], radius)
        found.append(np.array(inner, np.int64).reshape(-1, 2) + at)
    return _pairs(_nodes(lanes), np.concatenate(found))


def _sparse_links(keyed: DataFrame, radius: int) -> DataFrame:
    """(a, b): links within buckets that are not crowded; sorted runs are read as a stream."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = lanes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more, marks = batch.column("bucket").to_numpy(), _lanes(batch.column("mark"))
            buckets = more if buckets is None else np.concatenate([buckets, more])
            lanes = marks if lanes is None else np.concatenate([lanes, marks])
            # The last run may go on in the next batch.
            cut = int(np.searchsorted(buckets, buckets[-1]))
            if cut:
                yield _sorted_links(buckets[:cut], lanes[:cut], radius)
                buckets, lanes = buckets[cut:], lanes[cut:]
        if buckets is not None:
            yield _sorted_links(buckets, lanes, radius)

    dealt = keyed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, "a long, b long")


def _crowded_links(keyed: DataFrame, crowded: DataFrame, radius: int, block_rows: int) -> DataFrame:
    """(a, b): a spanning forest of the links within crowded buckets, or more than that.

    ``label`` is the first of the linked centres that a row is within the radius of, or -1.  Rows of
    one label are connected, so only blocks of different labels and those of -1 meet.
    """
    rows = sized_join(keyed, crowded, ["bucket"])
    drawn = [F.min_by("mark", F.xxhash64("mark", F.lit(k))) for k in range(CENTRES)]
    centres = materialize(rows.groupBy("bucket").agg(F.array(*drawn).alias("centres")), "centres")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = _lanes(batch.column("mark"))
            buckets, first, which = np.unique(
                batch.column("bucket").to_numpy(), return_index=True, return_inverse=True
            )
            labels, met = np.full(len(lanes), -1, np.int32), np.zeros(len(lanes), np.int64)
            for number in range(len(buckets)):
                mine = np.flatnonzero(which == number)
                middle = _lanes(batch.column("centres")[int(first[number])].values)
                forest = _Forest(len(middle))
                for x, y in _bucket_links(middle, radius):
                    forest.link(x, y)
                near = np.bitwise_count(lanes[mine][:, None] ^ middle[None]).sum(2) <= radius
                hit = near.any(1)
                nearest = near.argmax(1)
                labels[mine] = np.where(hit, forest.roots()[nearest], -1)
                met[mine] = _nodes(middle)[nearest]
            yield pa.RecordBatch.from_arrays(
                [batch.column("bucket"), batch.column("mark"), pa.array(_nodes(lanes)), pa.array(labels), pa.array(met)],
                names=["bucket", "mark", "node", "label", "met"],
            )

    labelled = sized_join(rows, centres, ["bucket"]).select("bucket", "mark", "centres")
    labelled = materialize(
        labelled.mapInArrow(label, "bucket long, mark binary, node long, label int, met long"), "labelled"
    )
    to_centres = labelled.where("label >= 0 and met <> node").select(F.col("met").alias("a"), F.col("node").alias("b"))
    # At most one span per centre, and one of the other rows.
    parts = F.ceil(F.count("*") * 2 / F.lit(block_rows)).cast("int").alias("parts")
    counted = labelled.groupBy("bucket", "label").agg(parts)
    spans = counted.groupBy("bucket").agg(F.collect_list(F.struct("label", "parts")).alias("spans"))
    placed = sized_join(labelled, materialize(spans, "spans"), ["bucket"])
    own = F.filter("spans", lambda s: s["label"] == F.col("label"))[0]["parts"]
    block = F.struct("label", F.pmod(F.xxhash64("mark"), own).cast("int").alias("part"))
    met = F.flatten(
        F.transform(
            F.filter("spans", lambda s: (s["label"] != F.col("label")) | (F.col("label") < 0)),
            lambda s: F.transform(
                F.sequence(F.lit(0), s["parts"] - 1),
                lambda part: F.struct(s["label"].alias("label"), part.alias("part")),
            ),
        )
    )
    dealt = placed.select("bucket", "mark", block.alias("block"), F.explode(met).alias("other")).select(
        "bucket", "mark", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def compare(table: pa.Table) -> pa.Table:
        lanes = _lanes(table["mark"].combine_chunks())
        found = np.array(_bucket_links(lanes, radius), np.int64).reshape(-1, 2)
        return pa.Table.from_batches([_pairs(_nodes(lanes), found)])

    between = dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    return to_centres.unionByName(between)


def close_groups(
    marks: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(fingerprint, group): fingerprints joined by chains of at most ``radius`` differing bits.

    ``group`` is the smallest fingerprint of the chain; only groups of several are listed.
    """
    if radius >= blocks:
        raise ValueError("there must be more blocks than differing bits")
    distinct = marks.select("fingerprint").where("fingerprint is not null").distinct()
    distinct = materialize(
        distinct.mapInArrow(_marked, "fingerprint string, mark binary, node long"), "fingerprints"
    )
    keyed = _keyed(distinct, radius, blocks)
    crowded = _crowded(keyed, distinct.count() * math.comb(blocks, radius), block_rows)
    edges = _sparse_links(sized_join(keyed, crowded, ["bucket"], "left_anti"), radius)
    if not crowded.isEmpty():
        edges = edges.unionByName(_crowded_links(keyed, crowded, radius, block_rows))
    linked = connected_components(edges)
    named = sized_join(distinct, linked, ["node"]).select("fingerprint", "component")
    named = materialize(named, "groups")
    heads = named.groupBy("component").agg(F.min("fingerprint").alias("group"))
    return named.join(heads, "component").select("fingerprint", "group")


def radius_of(similarity: float, bits: int = BITS) -> int:
    """Differing bits of texts with this Jaccard similarity: the mean and two standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 2 * math.sqrt(bits * share * (1 - share)))


def meeting(bits: int, differing: int, sample: int) -> float:
    """Chance that ``sample`` of the bits hold none of the differing ones."""
    return math.comb(bits - differing, sample) / math.comb(bits, sample)


def sampled_tables(bits: int, radius: int, sample: int, recall: float = RECALL) -> list[np.ndarray]:
    """For each table, the bits of its key; the same ones on every call."""
    count = math.ceil(math.log(1 - recall) / math.log1p(-meeting(bits, radius, sample)))
    rng = np.random.default_rng(bits * 1000 + sample)
    return [np.sort(rng.permutation(bits)[:sample]) for _ in range(count)]


def near_groups(
    marks: DataFrame, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(fingerprint, group): fingerprints joined by chains of near copies, as ``close_groups``.

    A link is a pair within ``radius_of(similarity)`` bits that shares a bucket.
    """
    distinct = materialize(
        marks.select("fingerprint").where("fingerprint is not null").distinct(), "fingerprints"
    ).withColumn("node", F.xxhash64("fingerprint"))
    known = distinct.agg(F.count("*").alias("n"), F.max(F.length("fingerprint")).alias("digits")).first()
    bits = 4 * (known["digits"] or BITS // 4)
    radius = radius_of(similarity, bits)
    sample = max(LEAST_SAMPLE, math.ceil(math.log2(known["n"] / bucket_rows + 1)))
    tables = sampled_tables(bits, radius, sample)
    weights = 1 << np.arange(sample, dtype=np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [bytes.fromhex(x) for x in batch.column("fingerprint").to_pylist()]
            if not raw:
                continue
            marked = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)
            content = pa.array(raw, pa.binary())
            for number, table in enumerate(tables):
                # One number for table and key.
                bucket = (marked[:, table] @ weights) * len(tables) + number
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket), batch.column("node"), content], names=["bucket", "node", "mark"]
                )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        nodes = table["node"].to_numpy()
        lanes = np.frombuffer(b"".join(table["mark"].to_pylist()), np.uint8).reshape(len(nodes), -1)
        lanes = lanes.view(_U) if lanes.shape[1] % 8 == 0 else lanes
        found = np.array(_bucket_links(lanes, radius), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[found[:, 0]]), "b": pa.array(nodes[found[:, 1]])})

    keyed = distinct.select("node", "fingerprint").mapInArrow(keys, "bucket long, node long, mark binary")
    edges = keyed.groupBy("bucket").applyInArrow(compare, "a long, b long")
    linked = connected_components(edges)
    named = sized_join(distinct, linked, ["node"]).select("fingerprint", "component")
    named = materialize(named, "groups")
    heads = named.groupBy("component").agg(F.min("fingerprint").alias("group"))
    return named.join(heads, "component").select("fingerprint", "group")

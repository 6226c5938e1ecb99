"""Alignment of two tokenizers over a corpus, one pass per distinct text.

Texts are grouped by their full content (with map-side combine, so any number of copies
of a text costs a task one row), each distinct text is encoded by both tokenizers and aligned
once, and what it counts is weighted by its number of copies.  The measures of a text are joined
back to the rows that hold it by the text's SHA-256.

Both tokenizers encode a space and the text: the byte-level one (A) is given the space, the
piece model (B) adds it.  Byte offsets at which tokens of both end cut the text into groups.
A *link* is an A and a B token that end together; an id pair's count is the number of its links
in all texts.

Defined cases: null and empty texts, and texts that do not come back byte by byte from both
tokenizers, have no tokens (zeros, empty digest column); strings of special tokens are plain text;
rows that repeat or share an id each get the measures of their own text; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.  A text is encoded within one task, however long.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.common import sized_join
from ledgerlake.sources.shared import materialize

# Fixed value: how the byte-level vocabulary splits text before merging.
BYTE_LEVEL_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
# Texts with at least this share of all rows are joined back as a broadcast: at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 1000
# Id pairs are one number: an A id times 2^20 and a B id.
_B_BITS = 20

_NOTHING = (0, 0, 0, "", [], [])
_ALIGNED = (
    "text_key binary, copies long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, times array<int>"
)


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of bytes: visible Latin-1 stands for itself, the rest follows from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Two tokenizers and the alignment of texts under them."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken

        alphabet = _byte_alphabet()
        with open(byte_path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        special = {token["content"] for token in vocabulary["added_tokens"]}
        ranks = {
            bytes(alphabet[c] for c in token): i
            for token, i in vocabulary["model"]["vocab"].items()
            if token not in special
        }
        # Merges were learned in the order of their ids, so the ids rank them.
        self.a = tiktoken.Encoding(
            "bytes", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.a_size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.a_size[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if len(pieces) >= 1 << _B_BITS:
            raise ValueError("the piece vocabulary is too large for the pair codes")
        self.b_bytes = np.empty(len(pieces), object)
        self.b_bytes[:] = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int64)
        # Decimal ids with the mark that follows them: inside a group, then at the end of its part.
        self.a_text = np.array([f"{i}{mark}" for mark in ",|" for i in range(len(self.a_size))], object)
        self.b_text = np.array([f"{i}{mark}" for mark in ",;" for i in range(len(pieces))], object)

    def measure(self, text: str):
        """(n_a, n_b, n_groups, digest of the groups, distinct pairs, their times)."""
        whole = (" " + text).encode()
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        if self.a.decode_bytes(a) != whole:
            return _NOTHING
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        if b"".join(self.b_bytes[b]) != whole:
            return _NOTHING
        a_end, b_end = self.a_size[a].cumsum(), self.b_size[b].cumsum()
        ends = np.zeros(len(whole) + 1, np.int8)
        ends[a_end] += 1
        ends[b_end] += 1
        # Whether a token is the last one of its group, and the group's number.
        a_cut, b_cut = ends[a_end] == 2, ends[b_end] == 2
        a_group, b_group = a_cut.cumsum() - a_cut, b_cut.cumsum() - b_cut
        a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
        # Tokens as the groups are written: those of A in a group, then those of B.
        written = np.empty(len(a) + len(b), object)
        b_before = np.concatenate([[0], b_last + 1])[a_group]
        written[np.arange(len(a)) + b_before] = self.a_text[a + a_cut * len(self.a_size)]
        written[np.arange(len(b)) + (a_last + 1)[b_group]] = self.b_text[b + b_cut * len(self.b_size)]
        digest = hashlib.sha256("".join(written)[:-1].encode()).hexdigest()
        pairs, times = np.unique(a[a_last] << _B_BITS | b[b_last], return_counts=True)
        return len(a), len(b), len(a_last), digest, pairs, times.astype(np.int32)


@cache
def _pair(byte_path: str, piece_path: str) -> Pair:
    """One pair of tokenizers per Python worker."""
    return Pair(byte_path, piece_path)


def align_texts(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per distinct non-empty text: its key, copies, measures and distinct id pairs."""
    texts = (
        docs.select("text").where("text <> ''")
        .groupBy("text").agg(F.count("*").alias("copies"))
        .select("text", F.unhex(F.sha2("text", 256)).alias("text_key"), "copies")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _pair(byte_path, piece_path)
        for batch in batches:
            # Pairs of a few texts at a time, as a text can be very long.
            for start in range(0, len(batch), 500):
                rows = batch.slice(start, 500)
                found = [tokenizers.measure(text) for text in rows["text"].to_pylist()]
                n_a, n_b, n_groups, digests, pairs, times = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [rows["text_key"], rows["copies"], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()),
                     pa.array(n_groups, pa.int64()), pa.array(n_groups, pa.int64()), pa.array(digests),
                     pa.array(pairs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                    names=["text_key", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return texts.mapInArrow(align, _ALIGNED)


def _links() -> Column:
    return F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): links per id pair in all texts; best: none of its B id has more."""
    links = aligned.select("copies", F.inline(_links()))
    counts = links.groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("count"))
    # At most as many rows in a window as A has ids.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))


def align_corpus(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    docs = docs.select("doc_id", "text")
    aligned = materialize(align_texts(docs, byte_path, piece_path), "aligned")
    counts = materialize(pair_counts(aligned), "counts")
    links = aligned.select("text_key", F.inline(_links()))
    scored = (
        sized_join(links, counts, ["pair"])
        .groupBy("text_key")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
    )
    plain = aligned.drop("pairs", "times")
    measures = materialize(plain.join(scored, "text_key", "left"), "measures")
    keyed = docs.select("doc_id", F.when(F.col("text") != "", F.unhex(F.sha2("text", 256))).alias("text_key"))
    rows = measures.agg(F.sum("copies")).first()[0] or 0
    many = F.col("copies") >= max(1, int(rows * HOT_SHARE))
    hot, others = measures.where(many), measures.where(~many)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns[1:7]]
    # Copies of frequent texts never meet in a shuffle; any other text has few of them.
    frequent = keyed.join(F.broadcast(hot), "text_key")
    rare = keyed.where("text_key is not null").join(F.broadcast(hot.select("text_key")), "text_key", "left_anti")
    found = frequent.select(*columns).unionByName(sized_join(rare, others, ["text_key"]).select(*columns))
    empty = keyed.where("text_key is null").select(
        "doc_id", *[F.lit(0).alias(c) for c in columns[1:7]], F.lit("").alias("groups_sha256")
    )
    return found.unionByName(empty).select("doc_id", *number, "groups_sha256")

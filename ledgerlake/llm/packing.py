"""Best-fit packing of tokenized documents into sequences of fixed length.

Documents are tokenized, cut into pieces where they exceed a sequence, and dealt by
hash into blocks of bounded token count.  Each block packs on its own by *best-two-fit*: a
sequence is filled greedily with the longest piece that fits; if a gap is left, its
smallest piece is replaced by two unpacked ones that fill the expanded gap more tightly.
A block leaves at most about one sequence unfilled, so block size, not input size, bounds both
memory and loss.

Defined cases: a null text is empty and holds only the closing id; a document of exactly one
sequence is one piece; repeated rows and rows that share a ``doc_id`` are packed each; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlake.llm.common import Memo
from ledgerlake.sources.shared import materialize

SEQUENCE = 2048
CLOSING_ID = 0
# Tokens that one task packs: about 16,000 full sequences.
BLOCK_TOKENS = 2**25
_BREAKING = ("\x1c", "\x1d", "\x1e", "\x1f")
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


# Marks that end a word; letters before them are tokenized apart from them.
_ENDINGS = ".,;:!?()#*$%&|<>"


def _stays_letters(word: str) -> bool:
    """Whether a word is letters only, also composed and in lower case."""
    return word.isalpha() and (
        word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()
    )


class Encoder:
    """Ids of texts as little-endian bytes, from remembered ids of their words.

    The tokenizer must not form tokens across white space (added tokens hold none), and
    must split letters from punctuation.  New words of letters only are encoded together:
    their ids are told apart by the tokens that end a word.
    """

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.words: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks = Memo(self.whole)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        # The fast form leaves out offsets, which nobody needs here.
        (found,) = self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words) and cuts[-1] == len(ids):
            content, at = ids.tobytes(), 0
            for word, cut in zip(words, (4 * cuts).tolist(), strict=True):
                self.letters[word] = content[at:cut]
                at = cut
        else:  # lower-casing or composing has split a word
            self.letters.update((word, self.whole(word)) for word in words)

    def _learn(self, chunks: set[str]) -> None:
        plain = [(c, c.rstrip(_ENDINGS)) for c in chunks]
        unknown = {core for _, core in plain if core not in self.letters and _stays_letters(core)}
        if unknown:
            self._learn_letters(sorted(unknown))
        for chunk, core in plain:
            known = self.letters.get(core)
            if known is None:
                self.words[chunk] = self.whole(chunk)
            else:
                self.words[chunk] = known + self.marks[chunk[len(core) :]] if core != chunk else known

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            # str.split() also splits at these four, which are no white space to the tokenizer.
            if any(mark in text for mark in _BREAKING):
                yield self.whole(text)
                continue
            chunks = text.split()
            new = set(chunks).difference(self.words)
            if len(self.words) + len(new) > self.limit:
                self.words.clear()
                self.letters.clear()
                new = set(chunks)
            if new:
                self._learn(new)
            yield b"".join(map(self.words.__getitem__, chunks))


@cache
def shared_encoder(path: str) -> Encoder:
    """One per Python worker, so that tasks after the first know its words."""
    return Encoder(path)


def token_pieces(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, closing_id: int = CLOSING_ID
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for each piece of each document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        closing = np.array([closing_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                texts = [text or "" for text in part.column("text").to_pylist()]
                for doc_id, content in zip(
                    part.column("doc_id").to_pylist(), encoder.encode(texts), strict=True
                ):
                    ids = content + closing
                    for piece, cut in enumerate(range(0, len(ids), 4 * sequence)):
                        content = ids[cut : cut + 4 * sequence]
                        rows.append((doc_id, piece, cut // 4, len(content) // 4, zlib.crc32(content)))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return read.mapInArrow(compute, _PIECE)


class _Shelf:
    """Unpacked pieces by length, with their lengths in order."""

    def __init__(self, lengths: np.ndarray):
        self.stacks: dict[int, list[int]] = defaultdict(list)
        for at in range(len(lengths) - 1, -1, -1):
            self.stacks[int(lengths[at])].append(at)
        self.lengths = sorted(self.stacks)

    def longest(self, room: int) -> int:
        """The largest length up to ``room``, or 0."""
        at = bisect.bisect_right(self.lengths, room)
        return self.lengths[at - 1] if at else 0

    def take(self, length: int) -> int:
        stack = self.stacks[length]
        item = stack.pop()
        if not stack:
            del self.lengths[bisect.bisect_left(self.lengths, length)]
        return item

    def give(self, length: int, item: int) -> None:
        if not self.stacks[length]:
            bisect.insort(self.lengths, length)
        self.stacks[length].append(item)

    def best_two(self, room: int, beyond: int) -> tuple[int, int] | None:
        """The two lengths with the largest sum in (beyond, room]."""
        known = np.array(self.lengths[: bisect.bisect_left(self.lengths, room)], np.int64)
        if not len(known):
            return None
        partner = np.searchsorted(known, room - known, "right") - 1
        same = partner == np.arange(len(known))
        single = np.array([len(self.stacks[int(x)]) == 1 for x in known[same]], bool)
        partner[np.flatnonzero(same)[single]] -= 1
        totals = np.where(partner >= 0, known + known[partner], 0)
        best = int(np.argmax(totals))
        if totals[best] <= beyond:
            return None
        return int(known[best]), int(known[partner[best]])


def best_two_fit(lengths: np.ndarray, sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset for each piece."""
    shelf = _Shelf(lengths)
    numbers = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    number = 0
    while shelf.lengths:
        packed: list[tuple[int, int]] = []
        room = sequence
        while length := shelf.longest(room):
            packed.append((length, shelf.take(length)))
            room -= length
        if room and shelf.lengths and len(packed) > 1:
            smallest, item = packed[-1]
            pair = shelf.best_two(room + smallest, smallest)
            if pair is not None:
                packed.pop()
                packed += [(x, shelf.take(x)) for x in pair]
                shelf.give(smallest, item)
        at = 0
        for length, item in packed:
            numbers[item], offsets[item] = number, at
            at += length
        number += 1
    return numbers, offsets


def pack(
    docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, closing_id: int = CLOSING_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Pieces of the documents with ``sequence_id`` and ``offset``."""
    pieces = materialize(token_pieces(docs, tokenizer, sequence, closing_id), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("block")
    order = ["length", "doc_id", "piece", "ids_crc32"]

    def pack_block(table: pa.Table) -> pa.Table:
        table = table.sort_by([(name, "ascending") for name in order])
        numbers, offsets = best_two_fit(table["length"].to_numpy(), sequence)
        first = table["block"][0].as_py() << 32
        placed = table.drop_columns(["block"])
        placed = placed.append_column("sequence_id", pa.array(numbers + first))
        return placed.append_column("offset", pa.array(offsets))

    return pieces.select("*", block).groupBy("block").applyInArrow(
        pack_block, _PIECE + ", sequence_id long, offset long"
    )

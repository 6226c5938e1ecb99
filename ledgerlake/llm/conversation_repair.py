"""Cheapest repair of damaged conversations by dynamic programming over a grammar.

A row of a conversation becomes one symbol: its role's place in the turn order and its fault.
A repair is a path through four states (nothing yet, after the system row, after a user row, after
an assistant row), so a run of rows is a min-plus *transfer matrix*: for each pair of states the cost of
the cheapest edits and, among those, the one whose audit is least.

The symbol strings of all conversations are compressed by Re-Pair: the most frequent pairs
of neighbours become rules, round by round.  The matrix of a rule is the product of its two parts' matrices,
computed once, bottom-up, and used by every conversation that holds the rule.  Its audits are
ropes: an entry holds the state in which its two halves meet.  Two entries
of one row of a matrix differ in the end state, so their audits differ, and as every edit sequence of a
run closes with the edit of its last row, none is a prefix of another.  The order of the halves therefore decides
the order of the whole, and no audit is spelled out before the end.

Rows stream through the tasks in order, sorted by Spark; a task holds the symbols and the audit of one
conversation (a few bytes per row), never its texts.  The digest of a repaired conversation is sequential by
nature, so the rows of one conversation are read by one task, however many they are.

Defined cases: nulls in any column read as one space; a null ``conv_id`` is one conversation; rows of one
turn are taken by role and text digest; roles are told apart by their first character, and a row
whose role is empty or begins with another letter than s, u and a can't be kept as it is; a
conversation without rows after the damage has zeros, an empty audit and the digest of nothing; an
empty table gives an empty result; only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlake.llm.common import WORD
from ledgerlake.sources.shared import materialize

# The characters that end a sentence, and the costs of the edits.
SENTENCE_END = "[.!?]"
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 2, 3, 2, 1
# Rules of the grammar; symbols without a rule are chained one by one.
RULES = 64
# Rules that one pass over the strings adds.
PER_ROUND = 16

# States: nothing yet, after system, after user, after assistant.
_NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
_ROLE = {"u": "user", "a": "assistant"}
# What closes a conversation that ends in a state.
_CLOSING = ["", "II", "I", ""]
_NEVER = 1 << 60

# One character per symbol: roles of sound rows, roles of truncated rows, rows that must go.
_SOUND, _CUT, _GONE = "suax", "SUAX", "-"
_FIRST_RULE = 0xE000

_STRINGS = (
    "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage, and one row with ``present`` false where a row was dropped."""
    column = lambda name: F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id"), F.col("turn").cast("long").alias("turn"), column("role").alias("role"), column("text").alias("text"),
        (F.crc32(F.concat(column("conv_id"), F.lit(":"), column("turn"))) % 20).alias("damage"),
    )
    text = (
        F.when(F.col("damage") <= 1, "")
        .when(F.col("damage") == 2, F.regexp_replace("text", SENTENCE_END, ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), (F.col("damage") != 0).alias("present"), F.explode(copies).alias("copy"),
    ).withColumn("digest", F.sha2(F.concat("role", F.lit(":"), "text"), 256))


def _order() -> list[Column]:
    """The order of a conversation's rows; every pass sorts by it."""
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def _faults(rows: DataFrame) -> DataFrame:
    """Narrow rows with their fault: 1 blank, 2 duplicate, 3 truncated, 0 none."""
    visible = F.regexp_like("text", F.lit(WORD))
    ended = F.regexp_like("text", F.lit(SENTENCE_END + r"[\x20\x09-\x0D]*\z"))
    narrow = rows.select(
        "conv_id", "turn", "role", "digest", "copy", "present", F.substring("role", 1, 1).alias("initial"),
        (~visible).alias("blank"), (~ended).alias("open"),
    )
    # Dealt by conversation, which also serves the window and the order below.
    earlier = Window.partitionBy("conv_id", "present", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("open"), 3).otherwise(0)
    )
    return (
        narrow.repartition("conv_id")
        .withColumn("nth", F.row_number().over(earlier))
        .withColumn("fault", fault)
        .sortWithinPartitions("conv_id", *_order())
        .select("conv_id", "turn", "initial", "fault", "present")
    )


def _read_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per conversation: its counts and its symbols."""

    def runs():
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "initial", "fault", "present")))

    def conversations():
        for conv_id, rows in itertools.groupby(runs(), key=lambda row: row[0]):
            symbols, faults, illegal, before = [], [0] * 4, 0, None
            low = high = last = None
            turns = 0
            for _, turn, initial, fault, present in rows:
                if not present:
                    continue
                faults[fault] += 1
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                if turn is not None:
                    low = turn if low is None else low
                    high, turns, last = turn, turns + (turn != last), turn
                kind = "suax".find(initial) if initial in ("s", "u", "a") else 3
                symbols.append(_GONE if fault in (1, 2) else (_CUT if fault == 3 else _SOUND)[kind])
            gaps = high - low + 1 - turns if low is not None else 0
            yield conv_id, gaps, faults[1], faults[2], faults[3], illegal, "".join(symbols)

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "symbols"]
    found = conversations()
    while part := list(itertools.islice(found, 2000)):
        columns = list(zip(*part))
        # Ids keep the type the schema asks for.
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64() if n not in ("conv_id", "symbols") else None) for n, c in zip(names, columns)],
            names=names,
        )


def pair_counts(text: str) -> Counter:
    """How often each pair of neighbours could be replaced, without overlaps."""
    counts = Counter(map("".join, zip(text, text[1:])))
    for pair in counts:
        if pair[0] == pair[1]:
            counts[pair] = text.count(pair)
    return counts


def compress(text: str, rules: list[tuple[str, str]]) -> str:
    for pair, symbol in rules:
        text = text.replace(pair, symbol)
    return text


def learn_grammar(strings: DataFrame, rules: int = RULES, per_round: int = PER_ROUND) -> list[tuple[str, str]]:
    """Re-Pair rules (pair, new symbol) of a table (symbols, n), most frequent pairs first.

    A round counts the pairs of all strings by a grouped sum; what reaches the driver is bounded by the
    square of the alphabet.  Pairs that share no symbol don't hinder each other, so
    one round takes several.
    """
    learned: list[tuple[str, str]] = []
    while len(learned) < rules:
        so_far = list(learned)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                total: Counter = Counter()
                for text, n in zip(batch["symbols"].to_pylist(), batch["n"].to_pylist()):
                    for pair, times in pair_counts(compress(text, so_far)).items():
                        total[pair] += times * n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["pair", "n"]
                )

        counts = strings.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        ranked = sorted(((row["n"], row["pair"]) for row in counts.collect()), key=lambda x: (-x[0], x[1]))
        taken: set[str] = set()
        for _, pair in ranked:
            if len(learned) - len(so_far) == per_round or len(learned) == rules:
                break
            if not taken & set(pair):
                taken |= set(pair)
                learned.append((pair, chr(_FIRST_RULE + len(learned))))
        if len(learned) == len(so_far):
            break
    return learned


class Matrix:
    """Costs, order of audits within a row, and ropes of the transfers of one symbol."""

    def __init__(self, cost, order, rope):
        self.cost, self.order, self.rope = cost, order, rope


def _terminal(symbol: str) -> Matrix:
    """Edits of one row: inserts before it, then keep, rerole or delete."""
    cost = [[_NEVER] * 4 for _ in range(4)]
    audit = [[""] * 4 for _ in range(4)]
    for start in range(4):
        state, inserts = start, 0
        # Two inserts reach every state that inserts can reach.
        while inserts <= 2:
            options = [("D", state, DELETE)]
            if symbol != _GONE:
                extra = UNFINISHED if symbol in _CUT else 0
                step = _NEXT[state].get(symbol.lower())
                if step is not None:
                    options.append(("K", step, KEEP + extra))
                options += [("R", _NEXT[state][role], REROLE + extra) for role in "ua" if role in _NEXT[state]]
            for letter, end, price in options:
                new = (INSERT * inserts + price, "I" * inserts + letter)
                if new < (cost[start][end], audit[start][end]):
                    cost[start][end], audit[start][end] = new
            state, inserts = _NEXT[state].get("a") or _NEXT[state]["u"], inserts + 1
    return Matrix(cost, [_ranks(row) for row in audit], audit)


def _ranks(values: list) -> list[int]:
    places = {v: i for i, v in enumerate(sorted(set(values)))}
    return [places[v] for v in values]


def multiply(left: Matrix, right: Matrix) -> Matrix:
    """Transfers of ``left`` then ``right``; a rope entry is the state between them."""
    cost = [[_NEVER] * 4 for _ in range(4)]
    rope = [[0] * 4 for _ in range(4)]
    order = [[0] * 4 for _ in range(4)]
    for start in range(4):
        keys = [(_NEVER, 0, 0)] * 4
        for end in range(4):
            keys[end], rope[start][end] = min(
                ((min(left.cost[start][k] + right.cost[k][end], _NEVER), left.order[start][k], right.order[k][end]), k)
                for k in range(4)
            )
            cost[start][end] = keys[end][0]
        order[start] = _ranks([key[1:] for key in keys])
    return Matrix(cost, order, rope)


class Repairer:
    """The grammar's matrices; repairs symbol strings."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.parts = {symbol: pair for pair, symbol in rules}
        self.matrices = {symbol: _terminal(symbol) for symbol in _SOUND + _CUT + _GONE}
        for pair, symbol in rules:
            self.matrices[symbol] = multiply(self.matrices[pair[0]], self.matrices[pair[1]])
        self.repair = lru_cache(maxsize=20_000)(self._repair)

    def _spell(self, symbol: str, start: int, end: int, out: list[str]) -> None:
        """Append the audit of one matrix entry."""
        todo = [(symbol, start, end)]
        while todo:
            symbol, start, end = todo.pop()
            rope = self.matrices[symbol].rope[start][end]
            if symbol in self.parts:
                left, right = self.parts[symbol]
                todo += [(right, rope, end), (left, start, rope)]
            else:
                out.append(rope)

    def _repair(self, symbols: str) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair."""
        text = compress(symbols, self.rules)
        cost, order, came = [0, _NEVER, _NEVER, _NEVER], [0, 1, 2, 3], []
        for symbol in text:
            matrix = self.matrices[symbol]
            best = [
                min(
                    ((min(cost[k] + matrix.cost[k][end], _NEVER), order[k], matrix.order[k][end]), k)
                    for k in range(4)
                )
                for end in range(4)
            ]
            cost, order = [b[0][0] for b in best], _ranks([b[0][1:] for b in best])
            came.append(bytes(b[1] for b in best))
        end = min(range(4), key=lambda k: (min(cost[k] + INSERT * len(_CLOSING[k]), _NEVER), order[k]))
        total, closing = cost[end] + INSERT * len(_CLOSING[end]), _CLOSING[end]
        path = [end]
        for step in reversed(came):
            path.append(step[path[-1]])
        path.reverse()
        audit: list[str] = []
        for i, symbol in enumerate(text):
            self._spell(symbol, path[i], path[i + 1], audit)
        return total, "".join(audit) + closing


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams each conversation's audit, then its rows, into the digest of its repaired text."""
    given, state, at, digest, begun = None, 0, 0, None, False

    def write(line: str) -> None:
        nonlocal begun
        digest.update(("\n" * begun + line).encode())
        begun = True

    def inserts() -> None:
        nonlocal state, at
        while at < len(given["audit"]) and given["audit"][at] == "I":
            role = "a" if state == 2 else "u"
            write(f"{_ROLE[role]}:")
            state, at = _NEXT[state][role], at + 1

    def closed() -> dict:
        inserts()
        return given | {"repaired_sha256": digest.hexdigest()}

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["audit"] is not None:
                if given is not None:
                    done.append(closed())
                given = {name: row[name] for name in batch.schema.names if name not in ("turn", "role", "text", "present", "digest", "copy")}
                state, at, digest, begun = 0, 0, hashlib.sha256(), False
                continue
            inserts()
            edit, at = given["audit"][at], at + 1
            if edit == "K":
                write(f"{row['role']}:{row['text']}")
                state = _NEXT[state][row["role"][0]]
            elif edit == "R":
                role = "a" if state == 2 else "u"
                write(f"{_ROLE[role]}:{row['text']}")
                state = _NEXT[state][role]
        if done:
            yield pa.RecordBatch.from_pylist(done, _result_schema(batch.schema))
    if given is not None:
        yield pa.RecordBatch.from_pylist([closed()], _result_schema(batch.schema))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _result_schema(schema: pa.Schema) -> pa.Schema:
    kept = [schema.field(n) for n in ("conv_id", *_COUNTS, "audit")]
    return pa.schema([*kept, pa.field("repaired_sha256", pa.string())])


def repair_conversations(conversations: DataFrame, rules: int = RULES) -> DataFrame:
    """Per conversation: gaps, fault counts, cost and audit of its repair, digest of the repaired rows."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    strings = materialize(_faults(rows).mapInArrow(_read_strings, _STRINGS.format(kind=kind)), "strings")
    distinct = materialize(strings.groupBy("symbols").agg(F.count("*").alias("n")), "distinct")
    grammar = learn_grammar(distinct, rules)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer = Repairer(grammar)
        for batch in batches:
            found = [repairer.repair(s) for s in batch["symbols"].to_pylist()]
            cost, audit = zip(*found) if found else ((), ())
            kept = batch.drop_columns(["symbols"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cost, pa.int64()), pa.array(audit, pa.string())],
                names=[*kept.schema.names, "cost", "audit"],
            )

    heads = f"conv_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string"
    audits = strings.mapInArrow(repair, heads)
    body = rows.where("present").select("conv_id", "turn", "role", "text", "present", "digest", "copy")
    # The audit of a conversation comes before its rows.
    both = audits.unionByName(body, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("present").asc_nulls_first(), *_order()
    )
    return both.mapInArrow(_digests, heads + ", repaired_sha256 string")

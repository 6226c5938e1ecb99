"""Search, tokenizer alignment and conversation repair against plain versions."""

import hashlib
import itertools
import random
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import alignment, conversation_repair, pivot_search
from ledgerlake.llm.queries import QUERIES, tokenizer_path

BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain_top_k(vectors, k):
    """(query_id, rank, vec_id, score) over (vec_id, components)."""
    usable = []
    for vec_id, parts in vectors:
        if parts is not None and all(x is not None and np.isfinite(x) for x in parts):
            usable.append((vec_id, [int(np.floor(float(np.float32(x)) * 1024)) for x in parts]))
    out = []
    for place, (query, q) in enumerate(usable):
        if query is None or query % 100:
            continue
        scored = []
        for other, (vec_id, x) in enumerate(usable):
            if other != place:
                scored.append((-sum(a * b for a, b in zip(q, x)), vec_id is None, vec_id or 0))
        for rank, (score, missing, vec_id) in enumerate(sorted(scored)[:k], 1):
            out.append((query, rank, None if missing else vec_id, -score))
    return out


def vectors_of(spark, rows):
    data = [(i, v, "x", 1.5) for i, v in rows]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, RANK string, score double")


def same(found, expected):
    assert sorted(map(repr, found)) == sorted(map(repr, expected))


@pytest.mark.parametrize("block_rows", [7, 60, 10_000])
def test_search_equals_all_products(spark, block_rows):
    rng = np.random.default_rng(block_rows)
    centre = rng.normal(size=6)
    rows = [(i, (centre + 0.01 * rng.normal(size=6)).tolist()) for i in range(0, 200)]  # one dense group
    rows += [(i, rng.normal(size=6).tolist()) for i in range(200, 420)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(500, 540)]  # equal vectors: ties
    rows += [(600, [0.0] * 6), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]), (601, None), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    rows += [(603, [float("nan")] * 6), (604, [float("inf")] * 6), (100, [3.0] * 6), (100, [3.0] * 6)]
    rows += [(700, [1.0, 2.0]), (701, [])]
    found = pivot_search.top_k(
        vectors_of(spark, rows), F.col("vec_id") % 100 == 0, k=10, block_rows=block_rows, chunk_queries=3
    )
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    same([tuple(r) for r in found.collect()], plain_top_k(rows, 10))


def test_search_of_few_large_or_no_vectors(spark):
    rows = [(0, [30000.0, -30000.0]), (1, [30000.0, 1.0]), (2, [-30000.0, 2.0]), (3, [3e30, 0.0])]
    wanted = F.col("vec_id") % 100 == 0
    found = pivot_search.top_k(vectors_of(spark, rows), wanted).collect()
    same([tuple(r) for r in found], plain_top_k(rows[:3], 10))  # the last one is too long to take part
    assert pivot_search.top_k(vectors_of(spark, []), wanted).collect() == []
    assert pivot_search.top_k(vectors_of(spark, [(1, [1.0])]), wanted).collect() == []
    assert pivot_search.top_k(vectors_of(spark, [(0, [1.0])]), wanted).collect() == []


def plain_alignment(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) from whole encodings."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(BYTES))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = dict(zip(map(chr, visible), visible))
    for i, byte in enumerate(x for x in range(256) if x not in visible):
        letters[chr(256 + i)] = byte
    with open(tokenizer_path(BYTES), encoding="utf-8") as file:
        tokens = {i: t for t, i in json.load(file)["model"]["vocab"].items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def ends(lengths):
        return list(itertools.accumulate(lengths))

    def links(text):
        if not text:
            return None
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in tokens[i]) for i in ids_a]
        bytes_b = [b_bytes(i) for i in ids_b]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return None
        ends_a, ends_b = ends(map(len, bytes_a)), ends(map(len, bytes_b))
        pairs = [(i, j) for i, e in zip(ids_a, ends_a) for j, f in zip(ids_b, ends_b) if e == f]
        groups, start = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            part = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends) if start < e <= cut)  # noqa: E731, B023
            groups.append(f"{part(ids_a, ends_a)}|{part(ids_b, ends_b)}")
            start = cut
        return len(ids_a), len(ids_b), groups, pairs

    found = [links(t) for t in texts]
    counts = {}
    for one in found:
        for pair in one[3] if one else []:
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for one in found:
        if one is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, pairs = one
        out.append((
            n_a, n_b, len(groups), len(pairs), sum(counts[p] == most[p[1]] for p in pairs),
            sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return out


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(4)
    letters = [" ", " ", "\n", "\t", "a", "The ", "é", "日本", "1", "!!", "'s", "　", "😀", "<s>", "\x00", "▁"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(150)]
    texts += [None, "", " ", "  ", "x ", "<|endoftext|> </s>", "a" * 4000, "word " * 3000, "▁", "a▁b"]
    return texts + ["the same text"] * 40 + [None, ""]


def test_alignment_equals_whole_encodings(spark, monkeypatch):
    texts = odd_texts()
    docs = spark.createDataFrame(
        [(i if i % 7 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, N_A string, pairs int"
    )
    expected = [(i if i % 7 else None, *m) for i, m in enumerate(plain_alignment(texts))]
    paths = tokenizer_path(BYTES), tokenizer_path(PIECES)
    same([tuple(r) for r in alignment.align_corpus(docs, *paths).select("doc_id", *MEASURES).collect()], expected)
    # Without broadcasts of measured tables.
    monkeypatch.setattr(alignment, "sized_join", lambda left, right, on: left.join(right.hint("merge"), on))
    same([tuple(r) for r in alignment.align_corpus(docs, *paths).select("doc_id", *MEASURES).collect()], expected)
    assert alignment.align_corpus(docs.limit(0), *paths).collect() == []
    assert [r["n_a"] for r in alignment.align_corpus(docs.where("text = ''"), *paths).collect()] == [0, 0]


BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    """{conv_id: rows (turn, role, text) after the damage, in order}."""
    out = {}
    for conv_id, turn, role, text in rows:
        kept = out.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (2 if kind == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()
        ))
    return out


def plain_faults(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        shown = text.strip(BLANKS)
        faults.append(
            "blank" if not shown else "duplicate" if (role, text) in seen
            else "truncated" if shown[-1] not in ".!?" else ""
        )
        seen.add((role, text))
    return faults


def plain_repair(rows, faults):
    """Least (cost, audit, lines) over all edit sequences, by recursion over rows."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def least(at, last, inserted):
        best = None

        def offer(cost, letter, line, rest):
            nonlocal best
            if rest is not None:
                new = (cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2])
                best = new if best is None or new < best else best

        if at == len(rows) and last in ("", "a"):
            best = (0, "", ())
        if inserted < 3:
            for role in follow[last].replace("s", ""):
                offer(2, "I", f"{names[role]}:", least(at, role, inserted + 1))
        if at < len(rows):
            _, role, text = rows[at]
            offer(3, "D", None, least(at + 1, last, 0))
            if faults[at] not in ("blank", "duplicate"):
                extra = faults[at] == "truncated"
                if role[:1] and role[:1] in follow[last]:
                    offer(extra, "K", f"{role}:{text}", least(at + 1, role[0], 0))
                for new in "ua":
                    if new in follow[last]:
                        offer(2 + extra, "R", f"{names[new]}:{text}", least(at + 1, new, 0))
        return best

    return least(0, "", 0)


def plain_conversations(rows):
    out = []
    for conv_id, kept in plain_damage(rows).items():
        faults = plain_faults(kept)
        turns = {t for t, _, _ in kept if t is not None}
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = plain_repair(kept, faults)
        out.append((
            conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return out


def conversations(spark, rows):
    return spark.createDataFrame(
        [(*row, "x", 3) for row in rows], "conv_id long, turn long, role string, text string, AUDIT string, present int"
    )


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("rules", [0, 5, 64])
def test_repair_equals_all_edit_sequences(spark, rules):
    rng = random.Random(rules)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", " ", "User"]
    texts = ["Yes.", "No", "", " \n", None, "Why?  \n", "ok! then", "。", "a.b", "same.", "same."]
    rows = []
    for conv_id in [*range(120), None]:
        weird = rng.random() < 0.3
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(roles) if weird or rng.random() < 0.2 else ["user", "assistant"][turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Answer {rng.random()}."
            rows += [(conv_id, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 3]), role, text)]
            rows += [rows[-1]] * (rng.random() < 0.05)
    rows.append((9_999, 0, "user", "alone"))
    found = conversation_repair.repair_conversations(conversations(spark, rows), rules=rules)
    assert found.columns == RESULT
    same([tuple(r) for r in found.collect()], plain_conversations(rows))


def test_repair_of_a_long_conversation_and_none(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i % 40}.") for i in range(5_000)]
    (row,) = conversation_repair.repair_conversations(conversations(spark, rows)).collect()
    kept = plain_damage(rows)[1]
    faults = plain_faults(kept)
    # The same recursion from the end, without deep calls.
    long = conversation_repair.Repairer([])
    symbols = "".join(
        "-" if f in ("blank", "duplicate") else r[0].upper() if f else r[0] for f, (_, r, _) in zip(faults, kept)
    )
    assert (row["cost"], row["audit"]) == long.repair(symbols)
    assert row["duplicate"] == faults.count("duplicate")
    empty = conversation_repair.repair_conversations(conversations(spark, []))
    assert empty.collect() == []


def test_rules_replace_the_most_frequent_pairs():
    assert conversation_repair.pair_counts("aaaab") == {"aa": 2, "ab": 1}
    rules = [("ua", ""), ("", "")]
    assert conversation_repair.compress("suauaua", rules) == "s"


def test_queries_on_the_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    data = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    found = QUERIES["op13_conversation_repair"](spark, folder)
    same([tuple(r) for r in found.collect()], plain_conversations([tuple(r) for r in data]))
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    found = QUERIES["op11_pivot_search"](spark, folder)
    same([tuple(r) for r in found.collect()], plain_top_k([tuple(r) for r in vectors], 10))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").where("length(text) < 3000")
    rows = docs.collect()
    found = alignment.align_corpus(docs, tokenizer_path(BYTES), tokenizer_path(PIECES))
    expected = [(r["doc_id"], *m) for r, m in zip(rows, plain_alignment([r["text"] for r in rows]))]
    same([tuple(r) for r in found.select("doc_id", *MEASURES).collect()], expected)

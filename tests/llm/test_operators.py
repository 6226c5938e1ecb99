"""Each operator against a plain version, on nulls, empty tables, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row, functions as F

from ledgerlake.llm import (
    chat,
    fingerprints,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    statistics,
    url_filters,
    warc,
)
from ledgerlake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Position string, TAKEN int"


def documents(spark, rows):
    """Rows of (doc_id, text, source), with columns that clash with results."""
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), "x", 1) for i, t, s in rows], SCHEMA
    )


def random_texts(count, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "eps", "zeta.", "ETA!!", "th|eta"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(count // 3)]
    texts = []
    for _ in range(count):
        parts = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = f"w{rng.randrange(10**6)}"
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    return texts


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    return documents(
        spark,
        [
            (1, None, "a"), (2, "", None), (3, "one", "a"), (3, "one", "a"), (4, long, None),
            (None, "two words", "b"), (5, " \t\n", "b"), (5, "other text here", "b"),
        ],
    )


# -- n-gram join ---------------------------------------------------------------


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 4_000_000), (5, 80, 300), (3, 60, 200)])
def test_ngram_join_equals_brute_force(spark, words, percent, block):
    texts = random_texts(150)
    docs = documents(spark, [(i, t, "a") for i, t in enumerate(texts)])
    found = {r.doc_id: r for r in ngram_join.near_duplicates(docs, words, percent, block).collect()}
    sets = []
    for text in texts:
        parts = text.lower().split()
        n = min(words, len(parts))
        sets.append({tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)})
    links = [
        (i, j) for i, j in combinations(range(len(sets)), 2)
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    want = roots(range(len(sets)), links)
    assert {i: r.component_id for i, r in found.items()} == want
    assert {i: r.n_shingles for i, r in found.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        sign = ngram_join.Signatures(percent)
        for _ in range(400):
            size = int(rng.integers(1, 300))
            base = np.unique(rng.integers(0, 2**63, size).astype(np.uint64) * np.uint64(2))
            gone = int(rng.integers(0, max(1, len(base) * (100 - percent) // 100) + 1))
            other = np.unique(np.append(rng.permutation(base)[gone:], rng.integers(0, 2**63, gone // 2).astype(np.uint64)))
            same = len(np.intersect1d(base, other))
            if same and len(base) != same and 100 * same >= percent * (len(base) + len(other) - same):
                assert np.intersect1d(sign(base), sign(other)).size


def test_ngram_join_of_odd_rows(spark, odd):
    found = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.near_duplicates(odd).collect()}
    assert found[1, 0] == 1 and found[2, 0] == 2 and found[3, 1] == 3 and found[None, 1] is None
    assert ngram_join.near_duplicates(odd).count() == 8
    assert ngram_join.near_duplicates(odd.limit(0)).count() == 0
    assert ngram_join.keep_one(odd).columns == odd.columns


def test_rows_of_one_document_join_their_groups(spark):
    a, b, c = ("one two three four five six", "red green blue black white grey", "just some other words here now")
    rows = [(1, a), (5, a), (5, b), (9, b), (20, c), (20, c), (20, "more words of twenty in a row"), (9, None), (30, b + " x")]
    docs = documents(spark, [(i, t, "a") for i, t in rows])
    found = ngram_join.near_duplicates(docs, 3, 80).where("n_shingles > 0").collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 5: 1, 9: 1, 20: 20, 30: 1}
    assert len({(r.doc_id, r.component_id) for r in found}) == 5
    left = [(r.doc_id, r.text) for r in ngram_join.keep_one(docs, 3, 80).collect()]
    assert sorted(i for i, _ in left) == [1, 9, 20]
    assert (1, a) in left and (9, None) in left


# -- mixing --------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    rng = random.Random(1)
    docs = documents(
        spark, [(i, "w " * rng.randint(0, 90), rng.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(600)]
    )
    plan = mixing.plan_mix(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = plan.groupby("source", dropna=False).agg(
        size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"), taken=("taken", "sum")
    )
    assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 1).all()
    assert abs(by.target.sum() - 1.5 * by.source_size.sum()) < 1e-6
    assert (plan.taken <= 2 * plan["size"]).all()
    weights = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    open_ = [(t / weights[s if s == s else None]) for s, t, z in zip(by.index, by.target, by.source_size) if t < 2 * z - 1e-6]
    assert max(open_) - min(open_) < 1e-6
    again = mixing.plan_mix(docs.repartition(7)).orderBy("doc_id").select("doc_id", "taken").collect()
    assert again == mixing.plan_mix(docs).orderBy("doc_id").select("doc_id", "taken").collect()


def test_mix_follows_the_schedule(spark):
    docs = documents(spark, [(i, "w " * 10, "early" if i % 2 else "late") for i in range(400)])
    knots = [("early", [(0.0, 2.0), (1.0, 0.0)]), ("late", [(0.0, 0.0), (1.0, 2.0)])]
    plan = spark.createDataFrame(knots, "source string, knots array<struct<at: double, weight: double>>")
    mixed = mixing.mix(docs, plan, budget=1.0).select("source", "position").toPandas()
    assert mixed.position.is_monotonic_increasing and len(mixed) == 400
    # The running integral of 2 - 2u at one half is three quarters.
    assert abs((mixed[mixed.source == "early"].position < 0.5).mean() - 0.75) < 0.02
    assert abs((mixed[mixed.source == "late"].position < 0.5).mean() - 0.25) < 0.02


def test_mix_of_odd_rows(spark, odd):
    plan = mixing.plan_mix(odd)
    assert plan.count() == 8 and plan.where("size = 0 and taken > 0").count() == 0
    assert mixing.plan_mix(odd.limit(0)).count() == 0
    assert {"epoch", "words", "position"} <= set(mixing.mix(odd).columns)
    assert "Position" not in mixing.mix(odd).columns


# -- packing -------------------------------------------------------------------


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [*random_texts(60), "İ. ŉ, can't <|endoftext|>. a\x1cb", "x" * 5000, "A, b! ½"]
    docs = odd.unionByName(documents(spark, [(100 + i, t, "a") for i, t in enumerate(texts)]))
    found = packing.pack(docs, path, sequence=64, block_tokens=40_000).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            want[r.doc_id, k, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())] += 1
    columns = ["piece", "start", "length", "ids_crc32"]
    ids = [None if i != i else int(i) for i in found.doc_id]
    assert Counter(zip(ids, *[found[c].tolist() for c in columns])) == want
    for _, rows in found.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 64
    assert packing.pack(docs.limit(0), path).count() == 0


def test_best_two_fit_replaces_the_smallest():
    # Greedy 6 + 3 leaves a gap of 1; 3 gives way to 2 + 2.
    numbers, _ = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert numbers[0] == numbers[2] == numbers[3] != numbers[1]
    lengths = np.random.default_rng(2).integers(1, 65, 3000)
    numbers, _ = packing.best_two_fit(lengths, 64)
    assert numbers.max() + 1 <= -(-lengths.sum() // 64) * 1.02


# -- quality -------------------------------------------------------------------


def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(800):
        words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(25, 90))]
        bad = i % 4 == 0
        if bad:
            words = [w + "###" for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 0 if bad else 1))
    labels += [(None, 1), (5, None), (7, 0), (99_999, 1)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rule_ensemble_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    found = quality_classifier.classify(docs, labels).toPandas()
    crc = [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]
    assert found.held_out.tolist() == crc
    held = found[found.held_out]
    assert (held.predicted == (held.doc_id % 4 != 0).astype(int)).mean() > 0.98
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(found[found.predicted == 1].doc_id)


def test_decision_list_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    found = quality_rules.judge(docs, labels).toPandas()
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]
    right = found.kept == (found.doc_id % 4 != 0)
    assert right[held].mean() > 0.98 and found.rule.nunique() > 1


def test_quality_without_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int")
    scores = quality_classifier.classify(odd, none).select("score").distinct().collect()
    assert [r.score for r in scores] == [0.5]
    judged = quality_rules.judge(odd, none)
    assert judged.count() == 8 and judged.where("not base_failed and not kept").count() == 0
    assert quality_classifier.classify(odd.limit(0), none).count() == 0


def test_statistics_equal_plain_counts(spark, odd):
    texts = [*random_texts(60), "a b c d e f g h i " * 3, "x " * 7, "x " * 9, "L\nL\n \nL \nM"]
    docs = odd.unionByName(documents(spark, [(100 + i, t, "a") for i, t in enumerate(texts)]))
    found = statistics.with_statistics(docs, "doc_id", "text").collect()
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(inside))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))


# -- line dedup ----------------------------------------------------------------


def test_lines_of_many_sites_keep_their_first_place(spark, odd):
    rows = [(i, f"own {i}\n boiler plate \nnear {i % 3}\n\ntail {i}", f"s{i % 12}") for i in range(36)]
    rows.append((36, "boiler plate\nboiler plate", None))
    cleaned = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows), 10).collect()}
    assert cleaned[0].text == rows[0][1] and cleaned[0].n_removed == 0
    assert cleaned[7].text == "own 7\nnear 1\n\ntail 7" and cleaned[7].n_lines == 5
    assert cleaned[36].text == "" and cleaned[36].n_removed == 2
    assert line_dedup.dedup_lines(odd, 2).count() == 8
    assert line_dedup.dedup_lines(odd.limit(0), 2).count() == 0


@pytest.mark.parametrize("sites", [19, 20, 21, 200])
def test_line_threshold_is_exact(spark, sites):
    docs = documents(spark, [(i, "same line", f"site{i}") for i in range(sites)])
    removed = line_dedup.dedup_lines(docs, 20).where("n_removed > 0").count()
    assert removed == (sites - 1 if sites >= 20 else 0)


# -- fingerprints --------------------------------------------------------------


def test_edited_texts(spark, odd):
    docs = documents(spark, [(2 * i, t, "a") for i, t in enumerate(random_texts(80))])
    found = {r.doc_id: r for r in fingerprints.edit_fingerprints(docs).collect()}
    order = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for k, (doc_id, text) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        row = found[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.edited_fingerprint == fingerprints.SimHash()(edited).hex()
        assert row.near_next == fingerprints.likeness(
            bytes.fromhex(row.fingerprint), fingerprints.SimHash()(other)
        )
    assert fingerprints.edit_fingerprints(odd).count() == 8
    assert fingerprints.edit_fingerprints(odd.limit(0)).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(8)
    marks = []
    for _ in range(60):
        base = rng.getrandbits(128)
        for _ in range(rng.randint(1, 5)):
            marks.append(f"{base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 4))):032x}")
    found = fingerprints.close_groups(
        spark.createDataFrame([Row(doc_id=i, fingerprint=m) for i, m in enumerate(marks)]), radius=3, blocks=5, block_rows=8
    ).collect()
    distinct = sorted(set(marks))
    links = [(a, b) for a, b in combinations(distinct, 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= 3]
    want = roots(distinct, links)
    sizes = Counter(want.values())
    assert {r.fingerprint: r.group for r in found} == {m: g for m, g in want.items() if sizes[g] > 1}


def test_fingerprint_equals_a_plain_vote(spark):
    def mix(x):
        for shift, factor in ((31, 0x7FB5D329728EA185), (27, 0x81DADEF4BC2DD44D)):
            x = (x ^ (x >> shift)) * factor % 2**64
        return x ^ (x >> 33)

    rng = random.Random(5)
    for length in (5, 60, 700):
        words = [f"Word{rng.randrange(9)}" * 6 for _ in range(length)]
        text = " ".join(words)
        terms = []
        if len(text) < 512:
            for at in range(len(text) - 4):
                term = 0
                for k in range(5):
                    term = mix((term + ord(text[at + k]) + (0 if k else 2**40)) % 2**64)
                terms.append(term)
        if len(text) >= 256:
            each = [xxhash.xxh3_64_intdigest(w.lower().encode()) for w in words]
            for at in range(len(words) - 4):
                term = each[at]
                for k in range(1, 5):
                    term = (mix(term) + each[at + k]) % 2**64
                terms.append(mix((term + 5) % 2**64))
        votes = np.zeros(128)
        for term, count in Counter(terms).items():
            hashed = b"".join(
                mix((term + 0x632BE59BD9B4E019 * lane) % 2**64).to_bytes(8, "little") for lane in range(2)
            )
            signs = np.unpackbits(np.frombuffer(hashed, np.uint8)).astype(float) * 2 - 1
            votes += signs * np.rint(8 * (1 + np.log(count)))
        assert fingerprints.SimHash()(text) == np.packbits(votes > 0).tobytes()


@pytest.mark.parametrize("block_rows", [40, 100_000])
def test_crowded_buckets_lose_no_link(spark, block_rows):
    rng = random.Random(18)
    flip = lambda mark, most, low=0: mark ^ sum(1 << b for b in rng.sample(range(low, 128), rng.randint(0, most)))
    base, other = rng.getrandbits(128), rng.getrandbits(128)
    marks = [rng.getrandbits(128) for _ in range(200)]
    marks += [flip(base, 4) for _ in range(300)] + [flip(other, 9) for _ in range(150)]
    # One bucket of a table in common, and mostly unlinked else.
    marks += [(rng.getrandbits(102) << 26) | (base % 2**26) for _ in range(150)]
    marks += [flip(m, 10, 26) for m in marks[-60:]]
    marks = [f"{m:032x}" for m in marks]
    rows = spark.createDataFrame(list(enumerate([*marks, *marks[:20], None])), "doc_id long, fingerprint string")
    found = fingerprints.close_groups(rows, block_rows=block_rows).collect()
    distinct = sorted(set(marks))
    links = [(a, b) for a, b in combinations(distinct, 2) if (int(a, 16) ^ int(b, 16)).bit_count() <= 8]
    want = roots(distinct, links)
    sizes = Counter(want.values())
    assert Counter((r.fingerprint, r.group) for r in found) == Counter((m, g) for m, g in want.items() if sizes[g] > 1)
    assert fingerprints.close_groups(rows.limit(0)).count() == 0


def test_near_copies_of_texts_share_a_group(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        # Each replaced word changes five of 396 shingles: similarities of about 0.97, 0.9 and 0.8.
        for replaced in (0, 1, 4, 9):
            copy = list(words)
            for at in range(replaced):
                copy[at * 400 // 9 + 20] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = fingerprints.fingerprints(docs).collect()
    found = fingerprints.near_groups(spark.createDataFrame(marks, "doc_id long, fingerprint string"), bucket_rows=100)
    group = {r.fingerprint: r.group for r in found.collect()}
    group = {r.doc_id: group.get(r.fingerprint, r.fingerprint) for r in marks}
    for copy, share in ((1, 1.0), (2, 0.99), (3, 0.9)):
        assert np.mean([group[i] == group[i + copy] for i in range(0, 600, 4)]) >= share
    assert len(set(group.values())) >= 150
    assert fingerprints.near_groups(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0


# -- chat ----------------------------------------------------------------------


def test_chat_round_trip(spark):
    hard = ["<|turn|>", r"<\|end|>", r"\n", "<s></s>[INST][/INST]<<SYS>>", "", None, "[\\\\INST]\n<|", "$1 \\"]
    rows = [(i % 3, k, role, text) for i, role in enumerate(["user", "assistant", "a\\n\nb<|"]) for k, text in enumerate(hard)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(turns.withColumn("parts", chat.text_parts(F.col("text"))))
    back = formatted.select(
        "conv_id", "formatted", "loss_spans", chat.read_turns(F.col("formatted")).alias("t"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    ).collect()
    for r in back:
        mine = [(x[2], x[3] or "") for x in rows if x[0] == r.conv_id]
        assert [(t.role, t.text) for t in r.t] == mine
        assert r.loss == "".join(t for role, t in mine if role == "assistant")
        assert r.formatted.count(chat.OPEN) == len(mine) and r.formatted.count("</s>") == 1


def test_typed_parts(spark):
    part = lambda kind, **x: Row(
        **{"kind": kind, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    )
    parts = [
        part("text", text="see <|image|> "), part("image", uri="i.png", width=57, height=28),
        part("audio", uri="a.wav", seconds=2.0), part("document", uri="d.pdf", pages=3), part("odd"), part(None, text="!"),
    ]
    turns = spark.createDataFrame(
        [(1, 0, "user", parts), (1, 1, "assistant", None)],
        f"conv_id long, turn long, role string, parts array<{chat.PART}>",
    )
    row = chat.format_chats(turns).first()
    assert row.formatted == (
        "<s><|turn|>user\nsee <\\|image|> <|image|><|audio|><|document|><|odd|>!<|end|>\n"
        "<|turn|>assistant\n<|end|>\n</s>"
    )
    assert [(a.kind, a.uri, a.tokens) for a in row.attachments] == [
        ("image", "i.png", 3), ("audio", "a.wav", 25), ("document", "d.pdf", 1536), ("odd", None, 0)
    ]
    assert row.attachment_tokens == 1564
    assert chat.format_chats(turns.limit(0)).count() == 0


# -- archives ------------------------------------------------------------------


def test_archive_round_trip(spark):
    big, nasty = "é" * 700, "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    rows = [
        (1, "http://x.org/a", big), (2, "http://x.org/b\r\nX: y", big), (9, None, big), (3, "http://x.org/c", "short"),
        (4, "http://x.org/d", "short"), (5, "u", None), (None, "http://n.org/", nasty), (6, "u", "same"), (6, "u", "same"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("capture", F.lit(1))
    from ledgerlake.sources.shared import shared_path

    path = shared_path(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=4000)
    found = warc.assemble(warc.read_records(spark, path)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert len(r.requests) == 1 and len(r.metadata) == 1
        about = {e.key: e.value for e in r.metadata[0].fields}["page_id"]
        by[int(about) if about else None] = r.capture
    assert by[9].record_type == "response" and bytes(by[9].payload).decode() == big
    assert by[1].record_type == by[2].record_type == "revisit" and by[1].payload is None
    assert by[1].refers_to == by[9].record_id and by[1].payload_bytes == 1400
    assert by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest()
    assert by[3].record_type == by[4].record_type == "response" and by[5].payload_bytes == 0
    assert bytes(by[None].payload).decode() == nasty
    assert by[2].target_uri == "http://x.org/b%0D%0AX: y" and by[9].target_uri is None
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_revisits_are_answered_by_their_response(spark):
    big, long = "é" * 700, "x" * 3_000_000
    rows = [(1, "u", big), (2, "v", big), (9, "w", big), (9, "w", big), (3, "u", "short"), (4, "u", None), (7, "y", long)]
    captures = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"))
    payload = F.col("capture.payload")
    questions = {"n": F.octet_length(payload), "sha": F.sha1(payload)}
    found = warc.resolve_revisits(captures, questions)
    assert Counter(
        (r.id, r.capture.record_type, r.n, r.sha)
        for r in found.withColumn("id", warc.page_id_of(F.col("capture.record_id"))).collect()
    ) == Counter(
        (i, "revisit" if i in (1, 2) else "response", len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest())
        for i, _, t in rows
    )
    orphans = warc.resolve_revisits(captures.where("capture.record_type = 'revisit'"), questions).collect()
    assert [(r.n, r.sha) for r in orphans] == [(None, None)] * 2 and orphans[0].capture.payload_bytes == 1400
    assert warc.resolve_revisits(captures.limit(0), questions).count() == 0


# -- lists ---------------------------------------------------------------------


def test_temporal_lists(spark):
    entries = spark.createDataFrame(
        [
            ("l", "Bad.org", "add", 10), ("l", "bad.org", "add", 12), ("l", "bad.org", "remove", 20),
            ("l", "bad.org", "add", 30), ("m", "x.com/a/b", "add", 0), ("n", "x.com", "add", 5),
            ("n", "x.com", "remove", 5), (None, "x.com", "add", 0), ("l", "q.com", "odd", 0),
        ],
        "list string, pattern string, action string, at int",
    )
    captures = [
        ("http://www.bad.org/p?q=1", 9), ("http://www.bad.org/p?q=1", 10), ("HTTPS://u@BAD.org:80", 19),
        ("http://bad.org", 20), ("http://bad.org", 31), ("http://notbad.org", 31), ("http://x.com/a/b/c#d", 3),
        ("http://x.com/a/bc", 6), (None, 3), ("nothing", 3), ("http://bad.org", None), ("http://bad.org", 31),
    ]
    frame = spark.createDataFrame(captures, "url string, fetched_at int").withColumn("Blocked", F.lit("x"))
    found = url_filters.filter_urls(frame, entries).collect()
    assert Counter((r.url, r.fetched_at, r.blocked, tuple(r.matched_lists)) for r in found) == Counter(
        (u, t, bool(m), m)
        for (u, t), m in zip(
            captures, [(), ("l",), ("l",), (), ("l",), (), ("m",), (), (), (), (), ("l",)], strict=True
        )
    )
    assert url_filters.filter_urls(frame.limit(0), entries).count() == 0
    assert url_filters.filter_urls(frame, entries.limit(0)).where("blocked").count() == 0


@pytest.mark.parametrize("part_rows", [3, 100_000])
def test_long_histories_equal_a_plain_lookup(spark, part_rows):
    """Patterns with hundreds of entries, one of them asked by most captures."""
    rng = random.Random(5)
    entries = [
        (rng.choice("lmn"), rng.choice(["hot.org", "org", "cold.com", "cold.com/a"]), rng.choice(["add", "remove"]), rng.randrange(400))
        for _ in range(900)
    ]
    urls = ["http://hot.org/" + "x" * 5000, "http://a.hot.org", "http://b.cold.com/a", "http://cold.com/a/b", "http://free.net"]
    captures = [(rng.choice(urls[:2] * 4 + urls), rng.randrange(-5, 410)) for _ in range(600)]
    asks = {urls[0]: ["hot.org", "org"], urls[1]: ["hot.org", "org"], urls[2]: ["cold.com"], urls[3]: ["cold.com", "cold.com/a"], urls[4]: []}

    def plain(url, at):
        lists = set()
        for pattern in asks[url]:
            for name in "lmn":
                seen = [(t, action == "add") for n, p, action, t in entries if (n, p) == (name, pattern) and t <= at]
                if seen and min(seen, key=lambda e: (-e[0], e[1]))[1]:
                    lists.add(name)
        return tuple(sorted(lists))

    found = url_filters.filter_urls(
        spark.createDataFrame(captures, "url string, fetched_at int"),
        spark.createDataFrame(entries, "list string, pattern string, action string, at int"), part_rows,
    ).collect()
    assert Counter((r.url, r.fetched_at, tuple(r.matched_lists)) for r in found) == Counter((u, t, plain(u, t)) for u, t in captures)


def test_url_prefixes_match_paths_as_written(spark):
    day = "timestamp_ntz'2024-01-01'"
    entries = spark.sql(
        f"select 'l' as list, pattern, 'add' as action, {day} as at from values "
        "('Site.Org/Some/Path'), ('b.org/dir/'), ('C.Org'), ('d.org/'), ('e.org//x') as t(pattern)"
    )
    blocked = ["http://site.org/Some/Path/x", "http://b.org/dir", "http://b.org/dir/y", "http://x.c.org/", "http://d.org/q", "http://e.org/x"]
    free = ["http://site.org/some/path", "http://b.org/dirt", "http://e.org/X"]
    urls = spark.createDataFrame([(u,) for u in blocked + free], "url string")
    captures = urls.selectExpr("url", f"{day} + interval 1 day as fetched_at")
    found = {r.url for r in url_filters.filter_urls(captures, entries).where("blocked").collect()}
    assert found == set(blocked)


def test_control_strings_across_text_parts(spark):
    texts = [["[", "INST]"], ["[\\", "INST]"], ["<", "|tu", "rn|>"], ["</", None, "s>"]]
    rows = [(i, 0, "user", [Row(kind="text", text=t) for t in parts]) for i, parts in enumerate(texts)]
    rows.append((9, 0, "user", [Row(kind="text", text="<"), Row(kind="image", text=None), Row(kind="text", text="/s>")]))
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<kind: string, text: string>>")
    full = F.transform("parts", lambda p: F.get(chat.text_parts(p["text"]), F.lit(0)).withField("kind", p["kind"]))
    formatted = chat.format_chats(turns.withColumn("parts", full))
    back = formatted.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"))
    back = {r.conv_id: r for r in back.collect()}
    for i, parts in enumerate(texts):
        assert back[i].t[0].text == "".join(p or "" for p in parts)
        assert back[i].formatted.count("[INST]") == 0 and back[i].formatted.count("</s>") == 1
    assert back[9].t[0].text == "<<|image|>/s>"


def test_lines_of_a_few_sites_are_boilerplate(spark):
    rows = [(i, f"own {i}\nlicence\npair {i // 2}", f"s{i % 4}") for i in range(8)]
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert cleaned == {i: t if i == 0 else f"own {i}\npair {i // 2}" for i, t, _ in rows}
    two = documents(spark, [(i, "licence", f"s{i % 2}") for i in range(8)])
    assert line_dedup.dedup_lines(two).where("n_removed > 0").count() == 0

from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from contract import compare
from ledgerlake.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def test_stages_keep_their_promises(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left and left <= ids
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def odd_documents(spark):
    """Given documents with nulls, repeats, shared ids and columns named like results of operators."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame(
        [(None, "no id at all", "en", "a", 12), (7, None, "en", "a", 0), (8, "", "en", None, 0), (9, " \n ", None, "b", 3)],
        docs.schema,
    )
    again = docs.orderBy("doc_id").limit(3)
    return docs.unionByName(more).unionByName(again).withColumns({
        "Position": F.concat(F.lit("p"), F.col("doc_id")), "n_removed": F.lit("kept"), "words": F.lit("w"),
        "epoch": F.lit("e"), "component_id": F.lit("c"),
    })


def plain_line_dedup(docs, sites=3):
    """Texts without the lines that three sources or more carry, but for their first occurrence."""
    found, first = {}, {}
    for d in docs:
        for place, line in enumerate((d.text or "").split("\n")):
            if key := line.strip(BLANKS):
                found.setdefault(key, set()).add(d.source)
                at = (d.doc_id is None, d.doc_id or 0, d.text, place)
                first[key] = min(first.get(key, at), at)
    out = []
    for d in docs:
        kept = [
            line for place, line in enumerate((d.text or "").split("\n"))
            if len(found.get(line.strip(BLANKS), ())) < sites
            or first[line.strip(BLANKS)] == (d.doc_id is None, d.doc_id or 0, d.text, place)
        ]
        out.append((d.doc_id, None if d.text is None else "\n".join(kept)))
    return out


def plain_near_duplicates(docs):
    """Ids that a smaller id reaches over links of similarity 0.8 of five-word shingles."""
    sets = {}
    for d in docs:
        words = (d.text or "").encode().lower().split()
        width = min(5, len(words))
        if words and d.doc_id is not None:
            shingles = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
            sets.setdefault(d.doc_id, []).append(shingles)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if any(100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i for i in sets if root(i) != i}


def test_stages_equal_plain_versions_and_keep_columns(spark):
    docs = odd_documents(spark)
    names = ["Position", "n_removed", "words", "epoch", "component_id"]
    rows = docs.collect()
    found = corpus_pipeline.drop_boilerplate_lines(spark, docs, SF)
    assert found.schema == docs.schema or found.columns == docs.columns
    left = found.collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left))) == sorted(map(repr, plain_line_dedup(rows)))
    assert all(r.n_chars == len(r.text) for r in left if r.text is not None)
    assert {r.n_removed for r in left} == {"kept"}
    found = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    gone = plain_near_duplicates(rows)
    kept = found.collect()
    assert found.columns == docs.columns
    assert {r.doc_id for r in kept} == {r.doc_id for r in rows if r.doc_id not in gone}
    assert len([r for r in kept if (r.text or "").strip(BLANKS) and r.doc_id is not None]) == len(
        {r.doc_id for r in rows if (r.text or "").strip(BLANKS) and r.doc_id is not None} - gone
    )
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and mixed.schema["Position"].dataType.simpleString() == "string"
    given = {repr(tuple(r)) for r in docs.select("doc_id", "text", *names).collect()}
    taken = {repr(tuple(r)) for r in mixed.select("doc_id", "text", *names).collect()}
    assert taken and taken <= given
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setitem(compare.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(compare.ORACLES, name, ORACLES[name])
    count, outcome = compare.compare(spark, SF, name)
    assert outcome == "same" and count > 0


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)

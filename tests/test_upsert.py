import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from conftest import final_plan, rows
from ledgerlake.operators.upsert import (
    DuplicateSourceKeys,
    changes,
    classify_changes,
    count_changes,
    upsert,
)

SCHEMA = "k int, name string, n int"
TARGET = [(1, "a", 1), (2, "b", None), (3, None, 3), (4, "d", 4), (None, "x", 0)]
SOURCE = [(2, "b", None), (3, "c", 3), (4, None, 4), (5, "e", 5), (None, "y", 9)]


def merged(target, source):
    """Expected result by plain dictionaries; rows without a key never match."""
    keyed = {r[0]: r for r in target if r[0] is not None}
    keyed.update({r[0]: r for r in source if r[0] is not None})
    loose = [r for r in target + source if r[0] is None]
    return sorted(list(keyed.values()) + loose, key=repr)


def test_upsert_replaces_adds_and_keeps(spark):
    target, source = (spark.createDataFrame(d, SCHEMA) for d in (TARGET, SOURCE))
    assert rows(upsert(target, source, ["k"])) == merged(TARGET, SOURCE)


def test_upsert_without_broadcast(spark, no_broadcast):
    target, source = (spark.createDataFrame(d, SCHEMA) for d in (TARGET, SOURCE))
    result = upsert(target, source, ["k"], broadcast_bytes=-1)
    assert "SortMergeJoin" in final_plan(result)
    assert rows(result) == merged(TARGET, SOURCE)


def test_small_source_does_not_shuffle_the_target(spark):
    target, source = (spark.createDataFrame(d, SCHEMA) for d in (TARGET, SOURCE))
    plan = final_plan(upsert(target, source, ["k"]))
    assert "LeftAnti" in plan and "hashpartitioning" not in plan


def test_upsert_casts_and_reorders_source_columns(spark):
    target = spark.createDataFrame([(1, "a", 1.0)], "k bigint, name string, n double")
    source = spark.createDataFrame([(7, "z", 2)], "n int, name string, k int")
    result = upsert(target, source, ["k"])
    assert result.schema == target.schema
    assert rows(result) == [(1, "a", 1.0), (2, "z", 7.0)]


def test_duplicate_source_keys_are_refused(spark):
    target = spark.createDataFrame(TARGET, SCHEMA)
    source = spark.createDataFrame([(1, "p", 1), (1, "q", 1)], SCHEMA)
    with pytest.raises(DuplicateSourceKeys):
        upsert(target, source, ["k"])


def test_change_classes(spark):
    target, source = (spark.createDataFrame(d, SCHEMA) for d in (TARGET, SOURCE))
    classes = {r["k"]: r["change"] for r in classify_changes(target, source, ["k"]).collect()
               if r["k"] is not None}
    assert classes == {1: "target_only", 2: "unchanged", 3: "update", 4: "update", 5: "insert"}
    assert rows(count_changes(target, source, ["k"])) == [
        ("insert", 2), ("target_only", 2), ("unchanged", 1), ("update", 2)
    ]


def test_changes_keep_only_rows_that_matter(spark):
    target, source = (spark.createDataFrame(d, SCHEMA) for d in (TARGET, SOURCE))
    assert [r[0] for r in rows(changes(target, source, ["k"]))] == [3, 4, 5, None]
    assert [r[0] for r in rows(changes(target, source, ["k"], compare=["n"]))] == [5, None]


keyed_rows = st.dictionaries(
    st.integers(0, 6),
    st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([1, 2, None])),
    max_size=6,
).map(lambda d: [(k, *v) for k, v in d.items()])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(keyed_rows, keyed_rows)
def test_upsert_is_idempotent(spark, left, right):
    target, source = (spark.createDataFrame(d, SCHEMA) for d in (left, right))
    once = upsert(target, source, ["k"])
    assert rows(once) == merged(left, right)
    assert rows(upsert(once, source, ["k"])) == rows(once)


def test_two_column_key(spark):
    schema = "d string, h int, q double"
    target = spark.createDataFrame([("n", 1, 1.0), ("n", 2, 2.0), ("s", 1, 3.0)], schema)
    source = spark.createDataFrame([("n", 2, 9.0), ("s", 2, 4.0)], schema)
    assert rows(upsert(target, source, ["d", "h"])) == [
        ("n", 1, 1.0), ("n", 2, 9.0), ("s", 1, 3.0), ("s", 2, 4.0)
    ]

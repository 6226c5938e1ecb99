from pyspark.sql import functions as F

from conftest import final_plan, rows
from ledgerlake.operators.joins import equal_keys, measured_bytes, reference_join


def test_measured_size_follows_content(spark):
    small = spark.createDataFrame([("a" * 10, [1, 2])], "s string, a array<int>")
    large = spark.createDataFrame([("a" * 1000, [1] * 50)] * 3, "s string, a array<int>")
    assert 0 < measured_bytes(small) < 200
    assert measured_bytes(large) > 3 * (1000 + 8 * 50)
    assert measured_bytes(small.limit(0)) == 0


def test_large_side_is_not_broadcast(spark, no_broadcast):
    fact = spark.range(2000).selectExpr("CASE WHEN id < 700 THEN 1 ELSE id END AS k", "id AS v")
    side = spark.range(0, 2000, 2).selectExpr("id + 1 AS k", "concat('n', id) AS name")
    small = reference_join(fact, side, equal_keys(["k"])).select("fact.v", "side.name")
    large = reference_join(fact, side, equal_keys(["k"]), broadcast_bytes=0).select("fact.v", "side.name")
    assert "BroadcastHashJoin" in final_plan(small)
    plan = final_plan(large)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows(small) == rows(large) and small.count() == 700 + 650


def test_stream_with_hot_key_and_large_side(spark, no_broadcast, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    fact = spark.range(300).selectExpr("CASE WHEN id < 200 THEN 7 ELSE id END AS k", "id AS v")
    fact.write.parquet(source)
    side = spark.range(250).selectExpr("id AS k", "concat('n', id) AS name")
    stream = spark.readStream.schema(fact.schema).parquet(source)
    for how, label in (("inner", "inner"), ("left_anti", "anti")):
        joined = reference_join(stream, side, equal_keys(["k"]), how, broadcast_bytes=0, salts=4)
        assert "_salt" not in joined.columns
        picked = joined.select("fact.v", "side.name") if how == "inner" else joined
        query = (
            picked.writeStream.format("parquet").option("checkpointLocation", f"{sink}-{label}-ck")
            .trigger(availableNow=True).start(f"{sink}-{label}")
        )
        query.awaitTermination()
    assert spark.read.parquet(f"{sink}-inner").count() == 200 + 50
    assert spark.read.parquet(f"{sink}-anti").agg(F.min("v"), F.count("v")).first() == (250, 50)


def test_batch_without_adaptive_execution_is_salted(spark, no_broadcast):
    fact = spark.range(600).selectExpr("CASE WHEN id < 400 THEN 1 ELSE id END AS k", "id AS v")
    side = spark.range(500).selectExpr("id AS k", "concat('n', id) AS name")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = reference_join(fact, side, equal_keys(["k"]), broadcast_bytes=0, salts=4)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan and joined.count() == 400 + 100
        left = reference_join(fact, side, equal_keys(["k"]), "left_anti", 0, 4)
        assert rows(left, "v") == [(v,) for v in range(500, 600)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_adaptive_execution_splits_a_hot_key(spark, no_broadcast):
    """A key with most rows is shared by several tasks without any salting."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in settings}
    fact = spark.range(0, 60000, 1, 8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 1 ELSE id END AS k", "xxhash64(id) AS v")
    side = spark.range(60000).selectExpr("id AS k", "concat('n', id) AS name")
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = reference_join(fact, side, equal_keys(["k"]), broadcast_bytes=0)
        assert "skew=true" in final_plan(joined)
        assert joined.count() == 60000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)

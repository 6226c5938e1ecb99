from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import final_plan, rows
from contract import queries
from ledgerlake.functions.vectors import first_place_of, vector_entry, vector_size


def test_entries_equal_those_of_the_array(spark):
    vectors = [
        Vectors.dense([0.0, 1.0, 1.0, 5.0]), Vectors.sparse(4, [1, 2, 3], [1.0, 1.0, 5.0]),
        Vectors.sparse(4, [], []), Vectors.dense([2.0, 0.0, -1.0, 0.0]), Vectors.sparse(6, [0, 5], [0.0, 1.0]),
    ]
    data = spark.createDataFrame(list(enumerate(vectors)), ["id", "v"])
    array, width = vector_to_array("v"), F.size(vector_to_array("v"))
    wide = data.select("id", width, F.array_position(array, 1.0), *[F.get(array, F.lit(k)) for k in range(-1, 7)],
                       F.element_at(array, -1))
    short = data.select("id", vector_size(F.col("v")), first_place_of(F.col("v"), 1.0),
                        *[vector_entry(F.col("v"), F.lit(k)) for k in range(-1, 7)],
                        vector_entry(F.col("v"), vector_size(F.col("v")) - 1))
    assert rows(short) == rows(wide)


def test_encoding_query_makes_no_array_of_all_categories(spark):
    plan = final_plan(queries.index_encode_assemble(spark, "/root/testdata/sf0.001"))
    assert "unwrap" in plan.lower() and "vector_to_array" not in plan and "vectorToArray" not in plan

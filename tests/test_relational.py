from pyspark.sql import functions as F

from tarnlake.operators import relational


def test_full_join_shares_a_frequent_key_and_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(relational, "BLOCK_ROWS", 100)
    monkeypatch.setattr(relational, "TASK_ROWS", 50_000)
    # key 0 has 800 and 1,000 rows, key 1 one and two, keys 2 and 3 are on one side only, as are null keys and rows that are equal
    left = spark.range(800).select(F.lit(0).alias("a"), F.col("id").alias("x")).union(spark.createDataFrame([(1, 1), (2, 2), (2, 2), (None, 3)], "a int, x long"))
    right = spark.range(1000).select(F.lit(0).alias("b"), F.col("id").alias("y")).union(spark.createDataFrame([(1, 1), (1, 1), (3, 2), (None, 3), (None, 3)], "b int, y long"))
    found = relational.full_join(left, right, ["a"], ["b"])
    assert found.columns == ["a", "x", "b", "y"]
    plain = left.join(right, left.a == right.b, "full")
    assert found.exceptAll(plain).isEmpty() and plain.exceptAll(found).isEmpty()
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 800 * 1000 + 2 + 3 + 3 and max(sizes) < 200_000


def test_full_join_of_empty_sides_and_two_keys(spark):
    left = spark.createDataFrame([(1, None, 5), (1, 2, 6)], "a int, b int, x int")
    right = spark.createDataFrame([(1, None, 7), (1, 2, 8)], "c int, d int, y int")
    both = relational.full_join(left, right, ["a", "b"], ["c", "d"])
    assert sorted(map(tuple, both.collect()), key=repr) == sorted([(1, None, 5, None, None, None), (1, 2, 6, 1, 2, 8), (None, None, None, 1, None, 7)], key=repr)
    assert relational.full_join(left, right.where("false"), ["a", "b"], ["c", "d"]).count() == 2
    assert relational.full_join(left.where("false"), right.where("false"), ["a", "b"], ["c", "d"]).count() == 0

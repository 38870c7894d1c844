from pyspark.sql import functions as F

from treeloom import runtime
from treeloom.runtime import cut, join_groups


def test_hot_values_are_dealt(spark, monkeypatch):
    """A value of a third of all rows, others of one or few, a null key, and a group that no row has."""
    monkeypatch.setattr(runtime, "SLICES", 20)
    rows = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    sizes = rows.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    groups = cut(sizes.union(spark.createDataFrame([("absent", 5, 0)], sizes.schema)), "groups")
    got = join_groups(rows, groups, ["k"], "n", ["id"])
    assert got.columns == ["k", "id", "least"]
    want = rows.join(groups.drop("n"), "k")
    assert sorted(got.collect()) == sorted(want.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_one_hash_slices_alike(spark, monkeypatch):
    """A key of two columns, one of them null in places, and values hot to different degrees."""
    monkeypatch.setattr(runtime, "SLICES", 50)
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 30).alias("x"), (F.col("id") % 3).alias("y"), "id")
    groups = cut(rows.filter("x is not null").groupBy("x", "y").agg(F.count("*").alias("n"), F.max("id").alias("most")), "groups")
    got = join_groups(rows, groups, ["x", "y"], "n", ["id"])
    assert sorted(got.collect()) == sorted(rows.join(groups.drop("n"), ["x", "y"]).collect())


def test_empty_groups(spark):
    groups = spark.createDataFrame([], "k string, n long, x long")
    assert join_groups(spark.createDataFrame([("a", 1)], "k string, id long"), groups, ["k"], "n", ["id"]).count() == 0

from pyspark.sql import functions as F

from trailmill.functions.skew import join_by_weight


def test_heavy_and_light_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") < 3000, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1500).cast("string"))).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.concat(F.lit("v"), "k")).where("k <> 'k7'")
    got = join_by_weight(left, right, ["k"], "n", "id")
    assert got.columns == ["id", "k", "n", "v"] and got.count() == 5000
    assert got.where("v = concat('v', k)").count() == 5000 - got.where("k = 'k7'").count() and got.where("v IS NULL AND k <> 'k7'").count() == 0
    assert join_by_weight(left, right.limit(0), ["k"], "n", "id").where("v IS NULL").count() == 5000
    assert join_by_weight(left.limit(0), right, ["k"], "n", "id").count() == 0

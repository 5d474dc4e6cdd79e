import pytest
from pyspark.sql import functions as F

from trailmill.functions.ranking import rank, running_total
from trailmill.operators import sampling as S


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"{r}-{i}", r) for r, n in (("a", 50), ("b", 5), ("c", 1), (None, 3)) for i in range(n)]
    return spark.createDataFrame(data, "instance_id string, repo string")


def test_stratified_is_round_robin_and_grows(rows):
    n6 = S.stratified_sample(rows, 6, "repo", "instance_id").collect()
    assert len(n6) == 6 and sorted(r.round for r in n6) == [1, 1, 1, 1, 2, 2]
    n20 = {r.instance_id for r in S.stratified_sample(rows, 20, "repo", "instance_id").collect()}
    assert {r.instance_id for r in n6} <= n20 and len(n20) == 20
    assert S.stratified_sample(rows, None, "repo", "instance_id").count() == 59
    assert S.stratified_sample(rows, 1000, "repo", "instance_id").count() == 59
    assert S.stratified_sample(rows.limit(0), 5, "repo", "instance_id").count() == 0


def test_weighted_merge(rows):
    merged = S.weighted_merge(rows, "a", "b", 0.5, "instance_id", "repo")
    n = dict(merged.groupBy("repo").count().collect())
    assert n["b"] == 27 and n["a"] == 50 and n["c"] == 1
    assert merged.where("copy_no > 0").select("instance_id").distinct().count() > 1
    assert S.weighted_merge(rows, "a", "z", 0.5, "instance_id", "repo").count() == 59
    assert S.weighted_merge(rows.limit(0), "a", "b", 0.5, "instance_id", "repo").count() == 0


def test_order_batch_and_positions(rows):
    first = [r.instance_id for r in S.shuffled(rows, "instance_id", 1).collect()]
    assert first == [r.instance_id for r in S.shuffled(rows.repartition(5), "instance_id", 1).collect()] != [r.instance_id for r in S.shuffled(rows, "instance_id", 2).collect()]
    one, other = S.batch(rows, "instance_id", 1, 8), S.batch(rows, "instance_id", 2, 8)
    assert one.count() == 8 and sorted(map(tuple, one.collect())) != sorted(map(tuple, other.collect()))
    assert S.batch(rows.limit(0), "instance_id", 1, 8).count() == 0
    numbered = S.numbered(rows, "instance_id").orderBy("instance_id").collect()
    assert [r.ordinal for r in numbered] == list(range(59))
    assert [r.instance_id for r in S.positions(rows, 2, 4, "instance_id").collect()] == [r.instance_id for r in numbered[2:4]]


def test_numbered_keeps_the_order_of_a_table_with_further_columns(spark):
    rows = spark.range(0, 60_000, 1, 8).select("id", F.xxhash64("id").alias("h"), F.md5(F.col("id").cast("string")).alias("extra"))
    got = [(r.h, r.id, r.extra) for r in S.numbered(rows, "h", "id").orderBy("ordinal").collect()]
    assert got == sorted((r.h, r.id, r.extra) for r in rows.collect())
    numbers = S.numbered(rows, "h", "id").agg(F.min("ordinal"), F.max("ordinal"), F.count_distinct("ordinal"), F.count_distinct("extra")).first()
    assert tuple(numbers) == (0, 59_999, 60_000, 60_000)


def test_union_and_sticky(spark, rows):
    both = S.union_all([rows, rows.select("instance_id").withColumn("x", F.lit(1))])
    assert both.count() == 118 and set(both.columns) == {"instance_id", "repo", "x", "input_no"}
    placed = S.sticky(rows, "repo", 4).withColumn("p", F.spark_partition_id()).where("repo IS NOT NULL").groupBy("repo").agg(F.count_distinct("p").alias("n"))
    assert all(r.n == 1 for r in placed.collect())


def test_rank_is_a_permutation_in_each_key(rows):
    for repo, n in (("a", 50), ("b", 5), (None, 3)):
        got = rank(rows, ["repo"], ["instance_id"], "r").where(F.col("repo").eqNullSafe(repo)).collect()
        assert sorted(r.r for r in got) == list(range(n))


def test_running_total(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = running_total(df, ["k"], F.floor(F.col("id") / 10), ["id"], F.col("v"), "t").collect()
    for r in got:
        assert r.t == sum(x for x in range(r.id) if x % 3 == r.k)


def test_ranks_do_not_depend_on_the_number_of_buckets(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 > 0 THEN id % 3 END AS k", "'x' AS _key")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    few = {r.id: r.r for r in rank(df, ["k"], ["id"], "r").collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "700")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert {r.id: r.r for r in rank(df, ["k"], ["id"], "r").collect()} == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for k in (None, 1, 2):
        assert sorted(v for i, v in few.items() if (i % 3 or None) == k) == list(range(sum((i % 3 or None) == k for i in few)))


def test_a_large_stratum_is_sampled_in_hash_order(spark):
    df = spark.range(300).selectExpr("cast(id AS string) AS instance_id", "CASE WHEN id % 10 = 0 THEN 'small' WHEN id % 10 < 9 THEN 'hot' END AS repo", "id AS round_no")
    got = [(r.instance_id, r.repo, r["round"]) for r in S.stratified_sample(df, 250, "repo", "instance_id", 3).collect()]
    import hashlib

    order = lambda i: hashlib.md5(f"3:{i}".encode()).hexdigest()
    for repo in ("small", "hot", None):
        ids = sorted((r.instance_id for r in df.where(F.col("repo").eqNullSafe(F.lit(repo))).collect()), key=order)
        mine = [(i, k) for i, p, k in got if p == repo]
        assert [i for i, _ in mine] == ids[: len(mine)] and [k for _, k in mine] == list(range(1, len(mine) + 1))
    assert len(got) == 250

import math

import pytest
from conftest import MESSAGES, msg
from pyspark.sql import functions as F

from trailmill.operators import joins, metrics as Me


@pytest.mark.parametrize("n", [1, 7, 100, 200, 300])
def test_nearest_rank(spark, n):
    df = spark.range(n).select((F.col("id") * F.col("id")).alias("v"))
    r = Me.percentiles(df, "v", (7, 50, 90, 95, 99)).first()
    for p in (7, 50, 90, 95, 99):
        assert r[f"p{p}"] == sorted(i * i for i in range(n))[max(0, math.ceil(n * p / 100.0) - 1)]


def test_percentiles_of_nothing(spark):
    r = Me.percentiles(spark.range(0).select(F.col("id").alias("v")), "v").first()
    assert (r.p50, r["max"], r.n) == (0, 0, 0)


def test_recommend_and_caps(spark):
    df = spark.createDataFrame([(x,) for x in (10, 5000, 9000, 90000)], "v bigint")
    assert tuple(Me.recommend(df, "v", 95, 4096, 40960).first()) == (40960, 25.0)
    assert tuple(Me.recommend(df, "v", 50, 4096, 40960).first()) == (8192, 50.0)
    assert dict(Me.above_caps(df, "v", [10, 9000]).collect()) == {10: 3, 9000: 1}


def test_best_of_n(spark):
    nan = float("nan")
    rows = [("a", 0, 0, 0.5, "x"), ("a", 1, 1, 0.5, "y"), ("a", 2, 2, nan, "z"), ("b", 0, 3, nan, "x"), ("b", 1, 4, None, "y"), ("c", 1, 6, 0.0, None), ("d", 3, 7, 0.1, "late"), ("d", 1, 8, 0.9, "best")]
    df = spark.createDataFrame(rows, "instance_id string, repetition_id bigint, rollout_id bigint, score double, patch string")
    assert {r.instance_id: (r.score, r.patch) for r in Me.best_of_n(df).collect()} == {"a": (0.5, "x"), "b": (-1.0, ""), "c": (0.0, ""), "d": (0.9, "best")}
    assert {r.instance_id: r.candidates for r in Me.best_of_n(df, 1).collect()} == {"a": 1, "b": 1}


def test_advantages(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0), (None, None)], "g string, reward int")
    got = sorted((r.g or "", r.reward if r.reward is not None else -1, r.advantage) for r in Me.advantages(df, ["g"]).collect())
    assert got == [("", -1, None), ("", 0, 0.0), ("a", 0, -0.5), ("a", 1, 0.5), ("b", 1, 0.0)]
    assert Me.positive(Me.advantages(df, ["g"])).count() == 2


def test_rates_without_rows(spark):
    df = spark.createDataFrame([], "s string, r int")
    r = Me.status_rates(df, F.col("s") == "x", F.col("r") >= 1).first()
    assert (r.total, r.submit_rate) == (0, 0.0)
    assert Me.code_metrics(spark.createDataFrame([], "passed int, total int, pass_all boolean, has_code boolean")).first().pass_at_1 == 0.0


def test_repair(spark):
    bad, two = msg("assistant", "no call"), msg("assistant", "two", [("1", "a"), ("2", "b")])
    good, err, user = msg("assistant", "ok", [("3", "c")]), msg("user", "FORMAT ERROR"), msg("user", "thanks")
    df = spark.createDataFrame([(1, [user, bad, err, good, two, err, bad, user]), (2, []), (3, None)], f"row_id int, messages {MESSAGES}")
    assert [tuple(r) for r in Me.repair_pairs(df, "row_id", "FORMAT").orderBy("assistant_index").collect()] == [(1, 1, 2, 0), (1, 4, 5, 2)]
    kept = df.select("row_id", Me.repair(F.col("messages"), "FORMAT").alias("m")).orderBy("row_id").collect()
    assert [m.content for m in kept[0].m] == ["thanks", "ok", "no call", "thanks"] and kept[1].m == [] and kept[2].m is None
    audit = spark.createDataFrame([("a", [(1, 2, 0, "r")]), ("b", []), ("c", None)], "instance_id string, repairs array<struct<assistant_index:int,rejection_index:int,rejected_tool_call_count:int,reason:string>>")
    assert tuple(Me.repair_rollup(audit).first()) == (3, 2, 1, 1, 1, 3)


def test_joins(spark):
    rows = spark.createDataFrame([("a", "x"), ("", "h"), (None, "y"), ("h", "z"), ("b", None)], "instance_id string, id string")
    held = spark.createDataFrame([("h",), (None,), ("h",)], "instance_id string")
    assert sorted(r.id or "" for r in joins.without_leaks(rows, held).collect()) == ["", "h", "x", "y"]
    assert sorted(r.id or "" for r in joins.without_leaks(rows, held, fallback="id").collect()) == ["", "x", "y"]
    assert joins.without_leaks(rows, held.limit(0)).count() == 5
    assert tuple(joins.leakage_stats(rows, held).first()) == (5, 4, 1)
    assert joins.only_listed(rows, held).count() == 1
    assert joins.only_listed_if_readable(rows, spark, "/nowhere").count() == 5
    b, a = (spark.createDataFrame(x, "task string, v double") for x in ([("m", 1.0), ("n", 2.0)], [("n", 3.0), ("o", 4.0)]))
    got = {r.task: (r.before, r.after, r.delta) for r in joins.compare(b, a, "task", "v").collect()}
    assert got["n"] == (2.0, 3.0, 1.0) and math.isnan(got["m"][1]) and math.isnan(got["o"][2])


def test_results_and_retries(spark):
    jobs = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2025-01-01 00:00:00'), ('b', TIMESTAMP'2025-01-01 00:00:00'), ('c', TIMESTAMP'2025-01-01 00:00:00') t(job_id, created_at)")
    results = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP'2025-01-01 01:00:00', 0), ('a', TIMESTAMP'2025-01-01 01:30:00', 1), ('b', TIMESTAMP'2025-01-01 03:00:00', 1), ('x', TIMESTAMP'2025-01-01 00:10:00', 1) t(job_id, result_at, reward)")
    assert {r.job_id: r.reward for r in joins.with_results(jobs, results).collect()} == {"a": 1, "b": None, "c": None}
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    tries = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 4, True)], "k string, attempt int, ok boolean")
    assert sorted(map(tuple, joins.retry(items, tries, "k", F.col("ok")).collect())) == [("a", 2, True), ("b", 3, False), ("c", 3, False)]
    z = spark.range(1).select(joins.zip_lists(a=F.array(F.lit(1), F.lit(2)), b=F.array(F.lit("x"))).alias("z")).first().z
    assert [tuple(x) for x in z] == [(1, "x")]

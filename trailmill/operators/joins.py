"""Joins by id. Nulls never match and, in anti joins, stay.

Whether a side is broadcast is left to Spark, which knows its size at run time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def id_set(rows: DataFrame, key: str = "instance_id") -> DataFrame:
    """Distinct ids without null."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct()


def without_leaks(rows: DataFrame, held_out: DataFrame, key: str = "instance_id", fallback: str | None = None) -> DataFrame:
    """Rows whose id (or `fallback`, where the id is null or '') is not held out; rows without an id stay."""
    used = F.nullif(F.col(key), F.lit(""))
    if fallback:
        used = F.coalesce(used, F.nullif(F.col(fallback), F.lit("")))
    ids = id_set(held_out).withColumnRenamed("instance_id", "_held")
    return rows.withColumn("_used", used).join(ids, F.col("_used") == F.col("_held"), "left_anti").drop("_used")


def leakage_stats(rows: DataFrame, held_out: DataFrame, key: str = "instance_id") -> DataFrame:
    """One row (input, kept, leaked_verified), from one pass."""
    ids = id_set(held_out).select(F.col("instance_id").alias("_held"))
    joined = rows.select(key).join(ids, F.col(key) == F.col("_held"), "left")
    return joined.agg(F.count("*").alias("input"), F.count_if(F.col("_held").isNull()).alias("kept"), F.count("_held").alias("leaked_verified"))


def only_listed(rows: DataFrame, listed: DataFrame, key: str = "instance_id") -> DataFrame:
    return rows.join(id_set(listed, key), key, "left_semi").select(*rows.columns)


def only_listed_if_readable(rows: DataFrame, spark: SparkSession, path: str, key: str = "instance_id") -> DataFrame:
    """`only_listed` by a Parquet list; all rows if that cannot be read."""
    try:
        return only_listed(rows, spark.read.parquet(path), key)
    except AnalysisException:
        return rows


def with_results(jobs: DataFrame, results: DataFrame, key: str = "job_id", seconds: int = 7_200) -> DataFrame:
    """Each job with its last result that came within the deadline; null result columns mean a timeout."""
    others = [c for c in results.columns if c not in (key, "result_at")]
    latest = results.join(jobs.select(key, "created_at"), key).where(
        F.col("result_at").between(F.col("created_at"), F.col("created_at") + F.make_interval(secs=F.lit(seconds)))
    ).groupBy(key).agg(F.max("result_at").alias("result_at"), *(F.max_by(c, F.struct("result_at", F.col(c).cast("string"))).alias(c) for c in others))
    return jobs.join(latest, key, "left")


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, delta) over the keys of either side; a missing side is NaN."""
    nan = F.lit(float("nan"))
    joined = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key, "full_outer")
    b, a = F.coalesce("_b", nan), F.coalesce("_a", nan)
    return joined.select(key, b.alias("before"), a.alias("after"), (a - b).alias("delta"))


def zip_lists(**lists: Column) -> Column:
    """Parallel lists as one list of structs, as long as the shortest; null if one is null."""
    n = F.least(*(F.size(c) for c in lists.values())) if len(lists) > 1 else F.size(next(iter(lists.values())))
    named = F.arrays_zip(*(c.alias(k) for k, c in lists.items()))
    return F.slice(named, F.lit(1), F.greatest(n, F.lit(0)))


def retry(items: DataFrame, attempts: DataFrame, key: str, ok: Column, rounds: int = 3) -> DataFrame:
    """(key, rounds, done): items are tried again until an attempt is good, at most `rounds` times. `attempts` has
    (key, attempt from 1, ...)."""
    good = attempts.where(ok & F.col("attempt").between(1, rounds)).groupBy(key).agg(F.min("attempt").alias("_first"))
    return items.select(key).join(good, key, "left").select(key, F.coalesce("_first", F.lit(rounds)).alias("rounds"), F.col("_first").isNotNull().alias("done"))

"""Ranks and running totals that no single task has to order alone.

A plain `row_number() OVER (PARTITION BY hot_key)` sorts a hot key's rows in one task. Here each key is cut into
buckets that follow the order; rows are ranked within their bucket, and the bucket's offset, a running total over the
buckets of a key, is added. Buckets of a hash are its leading bits, as many as the session's shuffle partitions call for,
so they get no larger when the data and with them the partitions grow; the order, and so every rank, is that of the
whole hash and does not depend on their number. Null keys are a key of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fewest leading bits of a hash that make a bucket.
LEAST_BITS = 9


def running_total(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column | str], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same keys that come before, by bucket, then by order."""
    # One key for the window and the join: both use the same partitions, and nulls within a struct are equal.
    df = df.withColumn("_at_key", F.struct(*keys, bucket.alias("_bucket"))).withColumn("_at_value", value.cast("long"))
    sums = df.groupBy("_at_key").agg(F.sum("_at_value").alias("_sum"))
    before = Window.partitionBy(*(F.col("_at_key")[k] for k in keys)).orderBy(F.col("_at_key._bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_at_key", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_at_offset"))
    inside = Window.partitionBy("_at_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_at_inside", F.coalesce(F.sum("_at_value").over(inside), F.lit(0)))
    return ranked.join(offsets, "_at_key").withColumn(name, F.col("_at_inside") + F.col("_at_offset")).drop("_at_key", "_at_value", "_at_inside", "_at_offset")


def bits(df: DataFrame) -> int:
    """Leading bits that make at least four buckets for each shuffle partition of the session."""
    return max(LEAST_BITS, (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def hash_order(*columns: Column | str) -> Column:
    return F.xxhash64(F.lit(7), *columns)


def hash_bucket(df: DataFrame, *columns: Column | str) -> Column:
    """The bucket of `hash_order`, in the same order."""
    return F.shiftright(hash_order(*columns), 64 - bits(df))


def rank(df: DataFrame, keys: Sequence[str], by: Sequence[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... within the keys, in a fixed pseudo-random order that depends on the columns `by` only."""
    return running_total(df, keys, hash_bucket(df, *by), [hash_order(*by), *by], F.lit(1), name)

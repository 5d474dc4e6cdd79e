"""Joins to a table of unique keys of which some are very frequent on the other side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

#: At most so many keys are broadcast: those that have at least 1 / HEAVY of all rows.
HEAVY = 1_000


def join_by_weight(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str, spread: str) -> DataFrame:
    """Left join of `left` to `right`, which has one row for each key and, in `weight`, how many rows of `left` have it.

    A key with at least 1 / HEAVY of all rows is heavy; there can be no more than HEAVY of them, so they are broadcast,
    and their rows are spread over the shuffle by the column `spread`. The others are joined by key. `right` is read
    three times; callers materialise it. Keys must not be null.
    """
    others = [c for c in right.columns if c not in keys]
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY >= F.lit(total)
    value = F.struct(*others)
    marked = left.join(F.broadcast(right.where(heavy).select(*keys, value.alias("_heavy"))), list(keys), "left")
    marked = marked.withColumn("_spread", F.when(F.col("_heavy").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread)))
    light = right.where(~heavy).select(*keys, value.alias("_light"), F.lit(0).cast("long").alias("_spread"))
    joined = marked.join(light, [*keys, "_spread"], "left").withColumn("_value", F.coalesce("_heavy", "_light"))
    return joined.select(*left.columns, *(F.col(f"_value.{c}").alias(c) for c in others))

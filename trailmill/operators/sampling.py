"""Deterministic sampling, splitting, merging and ordering: random choices are hashes of a seed and the id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import hash_bucket, hash_order as in_hash_order, rank, running_total
from ..session import cut

SEPARATOR = ":"


def hash_order(seed: int, *columns: Column | str) -> Column:
    return F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), *columns))


def stratified_sample(rows: DataFrame, n: int | None, stratum: str, key: str, seed: int = 42) -> DataFrame:
    """n rows by round robin over the strata: one of each stratum a round, strata in hash order; None: all rows. Adds
    `round`, from 1. Rounds beyond n need no look, so a stratum keeps at most n rows before the final ordering. A large
    stratum is ranked in buckets by the first digits of the hash, so no task orders it alone."""
    if n is None:
        return rows.withColumn("round", F.lit(None).cast("int"))
    hashed = rows.withColumn("_hash", hash_order(seed, F.col(key)))
    place = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    ranked = running_total(hashed, [stratum], F.coalesce(place, F.lit(-1)), [F.col("_hash"), F.col(key)], F.lit(1), "round")
    ranked = ranked.withColumn("round", (F.col("round") + 1).cast("int")).where(F.col("round") <= n).drop("_hash").select(*rows.columns, "round")
    return ranked.orderBy("round", hash_order(seed, F.coalesce(F.col(stratum), F.lit(""))), stratum).limit(n)


def union_all(inputs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name; `input_no` tells from which input a row comes."""
    first, *rest = (df.withColumn("input_no", F.lit(i)) for i, df in enumerate(inputs))
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def weighted_merge(rows: DataFrame, major: str, minor: str, min_fraction: float, key: str, source: str = "source", seed: int = 42) -> DataFrame:
    """All rows, and rows of the minor source drawn again, with replacement, until it has `min_fraction` of both named
    sources together; nothing is drawn if one of them has no rows. Adds `copy_no`, 0 for originals."""
    named = rows.where(F.col(source).isin(major, minor))
    counts = named.agg(F.count_if(F.col(source) == major).alias("majors"), F.count_if(F.col(source) == minor).alias("minors"))
    wanted = F.floor((F.col("majors") + F.col("minors")) * F.lit(min_fraction))
    extra = F.when((F.col("majors") > 0) & (F.col("minors") > 0), F.greatest(wanted - F.col("minors"), F.lit(0))).otherwise(F.lit(0)).cast("long")
    draws = counts.select("minors", F.when(extra > 0, F.sequence(F.lit(1).cast("long"), extra)).otherwise(F.array().cast("array<bigint>")).alias("d")).select("minors", F.explode("d").alias("copy_no"))
    draws = draws.withColumn("ordinal", F.pmod(F.conv(F.substring(hash_order(seed, F.col("copy_no").cast("string")), 1, 12), 16, 10).cast("long"), F.col("minors")))
    pool = rank(rows.where(F.col(source) == minor), [source], [key], "ordinal")
    again = draws.select("copy_no", "ordinal").join(pool, "ordinal").select(*rows.columns, "copy_no")
    return rows.withColumn("copy_no", F.lit(0).cast("long")).unionByName(again)


def shuffled(rows: DataFrame, key: str, seed: int = 42, copy: str | None = None) -> DataFrame:
    """All rows in a pseudo-random total order."""
    parts = [F.col(key).cast("string")] + ([F.col(copy).cast("string")] if copy else [])
    return rows.orderBy(hash_order(seed, *parts), key)


def first_n(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first n rows of an order; 0: all."""
    return rows.orderBy(*order).limit(n) if n > 0 else rows


def numbered(rows: DataFrame, *order: Column | str, name: str = "ordinal") -> DataFrame:
    """Adds 0, 1, ... over the whole table in the given order, by range partitions and their offsets. The partitions are
    materialised: planned twice, they would be sampled twice, and the offsets would not belong to the rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))  # as Spark composes it
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a partition
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, inside + F.col("_offset")).drop("_part", "_id", "_offset")


def positions(rows: DataFrame, low: int, high: int, *order: Column | str) -> DataFrame:
    """Rows at positions low <= i < high of the order."""
    return rows.orderBy(*order).offset(low).limit(high - low)


def batch(rows: DataFrame, key: str, step: int, size: int, seed: int = 42) -> DataFrame:
    """`size` rows drawn with replacement for a step; adds `slot`."""
    n = rows.agg(F.count("*").alias("n"))
    draws = n.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
    draws = draws.select("slot", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), F.lit(str(step)), F.col("slot").cast("string"))), 1, 12), 16, 10).cast("long"), F.col("n")).alias("ordinal"))
    pool = running_total(rows.withColumn("_all", F.lit(1)), ["_all"], hash_bucket(rows, key), [in_hash_order(key), key], F.lit(1), "ordinal").drop("_all")
    return draws.join(pool, "ordinal").drop("ordinal")


def sticky(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows of one key lie in one partition; those without a key are spread."""
    return rows.repartition(partitions, F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.uuid()))

"""Splits that keep related records together (problem 2).

Families of repos are the components of the graph of owners and forks (`families`). A record's group is its family, else
the repo its id names, else its id, else itself (`grouped`). Groups are assigned largest first to the split furthest
below its target (`assign`): equal groups are assigned together, from the histogram of group sizes, which has at most
sqrt(2 x rows) lines and is all that the driver sees.

Defined cases: letter case, blanks, prefixes and suffixes of ids don't matter; null, blank and synthetic ids make
groups of their own; a name that is both a repo's present and another's former name means the present one; empty tables
give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.instance_ids import core_id, repo_name
from ..functions.ranking import rank
from ..functions.skew import join_by_weight
from ..session import cut
from .components import components

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def families(repos: DataFrame) -> DataFrame:
    """(repo, family): every repo with the first repo, in code-point order, of its family."""
    key = F.lower("repo")
    links = repos.select(key.alias("a"), F.concat(F.lit("owner:"), F.lower("owner")).alias("b")).unionByName(
        repos.select(key.alias("a"), F.lower("fork_of").alias("b"))
    )
    roots = components(links, "a", "b")
    named = repos.where("repo IS NOT NULL").select("repo", key.alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("repo").alias("family"))
    return named.join(first, "root").select("repo", "family")


def names_of(repos: DataFrame) -> DataFrame:
    """(name, repo): every present and former name in lower case, each once."""
    present = repos.where("repo IS NOT NULL").select(F.lower("repo").alias("name"), "repo", F.lit(0).alias("age"))
    former = repos.where("repo IS NOT NULL AND former_name IS NOT NULL").select(F.lower("former_name").alias("name"), "repo", F.lit(1).alias("age"))
    return present.unionByName(former).groupBy("name").agg(F.min_by("repo", F.struct("age", "repo")).alias("repo"))


def grouped(records: DataFrame, repos: DataFrame, key: str = "row_id") -> DataFrame:
    """(row_id, family, group): family is null if the id names no known repo; group is never null."""
    named = names_of(repos).join(families(repos), "repo").select("name", "family")
    ids = records.select(F.col(key), repo_name(F.col("instance_id")).alias("name"), core_id(F.col("instance_id")).alias("core"))
    return ids.join(named, "name", "left").select(
        key,
        "family",
        F.coalesce(
            F.concat(F.lit("family:"), "family"), F.concat(F.lit("repo:"), "name"), F.concat(F.lit("id:"), "core"),
            F.concat(F.lit("row:"), F.coalesce(F.col(key).cast("string"), F.lit(""))),
        ).alias("group"),
    )


def _fill(missing: list[float], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each split gets if each goes to the one with most missing."""
    low, high = min(missing) - size * (count + 1.0), max(missing)
    given = lambda level: [max(0, -int((level - m) // size)) if m > level else 0 for m in missing]
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(given(mid)) <= count else (mid, high)
    out = given(high)
    while sum(out) > count:
        # What was given last is taken back: where least was missing, of equal ones the last split.
        out[min((i for i in range(len(out)) if out[i]), key=lambda i: (missing[i] - size * (out[i] - 1), -i))] -= 1
    while sum(out) < count:
        out[max(range(len(out)), key=lambda i: (missing[i] - size * out[i], -i))] += 1
    return out


def plan(histogram: list[tuple[int, int]], shares: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """(size, split, from, to): which of the groups of a size, by rank, go where."""
    total = sum(s * n for s, n in histogram)
    missing, out = [total * x for x in shares.values()], []
    for size, n in sorted(histogram, reverse=True):
        at = 0
        for i, (split, k) in enumerate(zip(shares, _fill(missing, size, n))):
            missing[i] -= size * k
            if k:
                out.append((size, split, at, at + k))
                at += k
    return out


def assign(groups: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(group, size, split) from (group, size)."""
    spark = groups.sparkSession
    histogram = [(r["size"], r["n"]) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]
    schema = T.StructType([T.StructField("size", T.LongType()), T.StructField("split", T.StringType()), T.StructField("low", T.LongType()), T.StructField("high", T.LongType())])
    ranges = spark.createDataFrame(plan(histogram, shares or SHARES), schema)
    ranked = rank(groups.select("group", F.col("size").cast("long").alias("size")), ["size"], ["group"], "rank")
    return ranked.join(ranges, "size").where("rank >= low AND rank < high").select("group", "size", "split")


def split_records(records: DataFrame, repos: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(row_id, family, group, split) for every record."""
    key = "row_id"
    rows = grouped(records, repos)
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    return join_by_weight(rows, cut(assign(sizes, shares)), ["group"], "size", key).select("row_id", "family", "group", "split")

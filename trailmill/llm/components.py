"""Distributed union-find: connected components of a graph given by its links.

Every task builds a forest of its own links and hands on only (node, root) pairs, each once; it keeps at most `NODES`
nodes in mind and hands on the forest it has when there are more. The forests are then merged level by level, by key:
a level links all trees that meet at a root to the least of its neighbours (large star), and all parents of a node to
the least of them (small star), each in the task that has the key, until every component is one star. The levels are
logarithmic in the size of a component, links never multiply, nothing depends on how many there are, and no task sees
more than its share of the keys. The driver sees whether a level is the last.

Defined cases: links with a null end are ignored, repeated links and links of a node to itself do no harm, no links give
an empty result. The root is the least node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut, map_pandas

#: Nodes of the forest that a task keeps in mind, about 200 bytes each.
NODES = 500_000


def _forest(most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(x):
            root = x
            while (up := parent.get(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent.get(x, x)
            return root

        def trees() -> Iterator[pd.DataFrame]:
            nodes = list(parent)
            for at in range(0, len(nodes), 50_000):
                yield pd.DataFrame([(n, find(n)) for n in nodes[at : at + 50_000]], columns=["a", "b"])
            parent.clear()

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                x, y = find(a), find(b)
                if x != y:
                    low, high = (x, y) if x < y else (y, x)
                    parent[high] = low
                    if len(parent) >= most:
                        yield from trees()
        yield from trees()

    return run


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One contraction: every node's larger (or smaller) neighbours are linked to its least neighbour."""
    both = links if small else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if small:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    joined = both.join(least, "a")
    if not small:
        return joined.where("b > a AND b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
    up = joined.where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return up.unionByName(least.where("a <> least").select("a", F.col("least").alias("b"))).distinct()


def _merged(forest: DataFrame) -> bool:
    """Whether the links are stars: no node has two parents, and none is both a child and a parent."""
    ends = forest.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        forest.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame, a: str, b: str, nodes: int = NODES) -> DataFrame:
    """(node, root) for every node that has a link to another."""
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    # Each link comes to one task, whichever way and however often it is given.
    forest = cut(map_pandas(pairs.distinct(), _forest(nodes), pairs.schema))
    while not _merged(forest):
        forest = cut(_star(_star(forest, small=False), small=True))
    return forest.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(forest.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

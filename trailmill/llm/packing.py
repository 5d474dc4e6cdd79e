"""Filling fixed-capacity containers with items (problem 6).

Items are documents measured in tokens; only one that exceeds a container is cut, into full containers and a rest. The
plan needs nothing but the histogram of lengths, at most `capacity` lines, which is all that the driver sees. Minimum
bin slack: the longest remaining length opens a container, and a bitset subset-sum over the remaining multiset of
lengths finds the filling closest to the capacity; backtracking through the stored bitsets yields its counts. The
pattern is used as often as the multiset allows, so the number of steps depends on the capacity, not on the data. Items
are then placed by their rank within their length.

Defined cases: null and empty texts need no room and get a row without container; ties between items of one length are
broken by a hash of the id; repeated texts are items of their own; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ranking import rank
from ..session import cut, map_arrow
from .tokens import VOCABULARY, count_column


def fill(lengths: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The sub-multiset of (length, count) whose sum is at most `room` and as close to it as possible."""
    reach, steps = 1, []
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    for length, count in lengths:
        if length > room:
            continue
        left, part = min(count, room // length), 1
        while left and not reach & goal:
            part = min(part, left)
            steps.append((reach, length, part))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach & goal:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): what containers hold, until every item has its place."""
    left = {k: n for k, n in sorted(histogram.items(), reverse=True) if n > 0 and 0 < k <= capacity}
    out = []
    while left:
        longest = next(iter(left))
        rest = [(k, n - (k == longest)) for k, n in left.items()]
        pattern = fill([x for x in rest if x[1]], capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def _table(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, first container, per container), in order of length and rank."""
    at: dict[int, int] = {}
    rows, container = [], 0
    for pattern, times in patterns:
        for length, n in pattern.items():
            rows.append((length, at.get(length, 0), container, n))
            at[length] = at.get(length, 0) + n * times
        container += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def sizes(documents: DataFrame, key: str = "doc_id", path: str = VOCABULARY) -> DataFrame:
    return count_column(documents.select(key, "text"), "text", path)


def pack(measured: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(key, part_no, token_from, token_to, container_id) from (key, n_tokens)."""
    measured = cut(measured.select(key, "n_tokens"))
    parts = measured.select(
        key, "n_tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int") - 1)).alias("part_no")
    ).select(key, "part_no", (F.col("part_no").cast("long") * capacity).alias("token_from"), F.least("n_tokens", (F.col("part_no").cast("long") + 1) * capacity).alias("token_to"))
    items = parts.withColumn("length", F.col("token_to") - F.col("token_from"))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = items.sparkSession.sparkContext.broadcast(_table(plan(histogram, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        starts = t[:, 0] * (1 << 40) + t[:, 1]
        for batch in batches:
            length, at = (batch.column(i).to_numpy() for i in (4, 5))
            if len(t):
                i = np.searchsorted(starts, length * (1 << 40) + at, side="right") - 1
                container = t[i, 2] + (at - t[i, 1]) // t[i, 3]
            else:
                container = np.zeros(len(at), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container, mask=length == 0)], names=[*out_names])

    out_names = [key, "part_no", "token_from", "token_to", "container_id"]
    kind = dict(measured.dtypes)[key]
    ranked = rank(items, ["length"], [key, "part_no"], "rank").select(key, "part_no", "token_from", "token_to", "length", "rank")
    return map_arrow(ranked, place, f"`{key}` {kind}, part_no int, token_from bigint, token_to bigint, container_id bigint")


def cut_items(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, tokens): items that were placed in more than one container, and their tokens."""
    whole = packed.where("container_id IS NOT NULL").groupBy(key).agg(F.min("container_id").alias("low"), F.max("container_id").alias("high"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    return whole.where("low <> high").select(key, "tokens")


def proof(packed: DataFrame, measured: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """One row: items, those without room, containers above the capacity, items whose parts are not all their tokens in
    one piece after the other, and items cut although they fit: the last three are 0."""
    over = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("n")).where(F.col("n") > capacity).agg(F.count("*"))
    per = packed.groupBy(key).agg(
        F.count("*").alias("parts"), F.max("token_to").alias("end"), F.sum(F.col("token_to") - F.col("token_from")).alias("n"), F.count("container_id").alias("placed"),
        F.count_if(F.col("token_from") != F.col("part_no").cast("long") * capacity).alias("shifted"),
    )
    both = measured.select(key, "n_tokens").join(per, key, "left")
    bad = F.coalesce((F.col("n") != F.col("n_tokens")) | (F.col("end") != F.col("n_tokens")) | (F.col("shifted") > 0) | ((F.col("n_tokens") > 0) & (F.col("placed") != F.col("parts"))), F.lit(True))
    one = both.agg(F.count("*").alias("documents"), F.count_if(F.col("n_tokens") == 0).alias("without_room"), F.count_if(bad).alias("broken"), F.count_if((F.col("n_tokens") <= capacity) & (F.col("parts") > 1)).alias("cut_in_vain"))
    return one.withColumn("overfull", over.scalar())


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, the least possible number of containers, and the share of room used."""
    inside = packed.where("container_id IS NOT NULL").groupBy("container_id").agg(F.count("*").alias("items"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    return inside.agg(
        F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
        F.ceil(F.sum("tokens") / capacity).alias("least_containers"), F.round(F.sum("tokens") / (F.count("*") * capacity), 6).alias("used"),
    )

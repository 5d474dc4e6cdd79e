"""Mixing sources to target weights (problem 7).

The tokens of each source, in an order given by a hash of the document id, are packed into blocks of fixed length. The
mix has as many slots of one block as the tokens of all sources in question fill. Source counts per output shard are
multinomial draws given the totals: counts are halved down a tree of shards by hypergeometric draws, each shard walking
its own path. Use number g of a source is block `permutation(g mod blocks)` of pass `g div blocks`, by a keyed
pseudorandom permutation of the indexes, so a block comes again only after all others have come, and at most
`max_repeats` times. Blocks are joined by index.

A source too small for its share gives what it may; the others keep their number of slots, and the report has the
shares reached. With `exact` the mix is made as small as it takes for every source to reach its share; a source that may
give nothing can't reach one in any mix but the empty one, so it is left out and the others keep their proportions.

Defined cases: null and empty texts and documents of other or null sources have no part; a target source without
documents is reported with 0; the last block of a source may be shorter; repeated texts are texts; empty tables give an
empty mix; further columns are ignored. Targets are a fixed table of a few rows, which the driver reads.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.ranking import hash_bucket, hash_order, running_total
from ..session import cut, map_arrow
from .tokens import VOCABULARY, count_column

BLOCK = 512
SHARD = 1024
_U = np.uint64


def _stirling_error(n: float) -> float:
    """log n! less Stirling's formula."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return (x * math.log(x / mean) if x else 0.0) + mean - x
    v = (x - mean) / (x + mean)
    total, term, k = (x - mean) * v, 2 * x * v, 1
    while abs(term := term * v * v) > 1e-17 * abs(total):
        k += 2
        total += term / k
    return total


def _log_binomial(x: int, n: int, p: float) -> float:
    """log of the binomial probability by the saddle point expansion, whose terms stay small near the mean."""
    if x in (0, n):
        return n * math.log1p(-p) if x == 0 else n * math.log(p)
    size = 0.5 * (math.log(n) - math.log(x) - math.log(n - x) - math.log(2 * math.pi))
    return size + _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))


def hypergeometric(good: int, bad: int, drawn: int, rng: np.random.Generator) -> int:
    """A draw for counts of any size: rejection from a table mountain hat (Stadlober's HRUA)."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total, p = good + bad, drawn / (good + bad)
    log_f = lambda k: _log_binomial(k, good, p) + _log_binomial(drawn - k, bad, p)
    centre = drawn * (good / total) + 0.5
    width = math.sqrt((total - drawn) / (total - 1) * drawn * (good / total) * (bad / total) + 0.5)
    width = 2 * math.sqrt(2 / math.e) * width + 3 - 2 * math.sqrt(3 / math.e)
    top = log_f(min(max((drawn + 1) * (good + 1) // (total + 2), low), high))
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= log_f(k) - top:
            return k


def _split(counts: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each of `counts` are among `left` that are drawn from all, one count after the other."""
    total, out = int(counts.sum()), np.zeros_like(counts)
    for i, n in enumerate(counts.tolist()):
        total -= n
        out[i] = hypergeometric(n, total, left, rng)
        left -= int(out[i])
    return out


def shard_counts(totals: np.ndarray, shards: int, shard: int, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, counts in all shards before) of one shard: `totals` without replacement, `size` slots a shard."""
    counts, before, low, high = totals.astype(np.int64), np.zeros(len(totals), np.int64), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        left = _split(counts, min((mid - low) * size, int(counts.sum())), np.random.default_rng((seed, low, high)))
        if shard < mid:
            counts, high = left, mid
        else:
            counts, before, low = counts - left, before + left, mid
    return counts, before


def permute(index: np.ndarray, n: np.ndarray | int, key: int) -> np.ndarray:
    """A keyed pseudorandom permutation of 0 .. n-1: a Feistel network on the next even number of bits, walked until
    the value falls below n."""
    n = int(n)
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(half), x & mask
        for r in range(4):
            f = (right + _U((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
            f ^= f >> _U(29)
            f *= _U(0x94D049BB133111EB)
            left, right = right, left ^ (f >> _U(32)) & mask
        return left << _U(half) | right

    x = once(index.astype(_U))
    while (out := x >= _U(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def blocks(documents: DataFrame, sources: list[str], block: int = BLOCK, path: str = VOCABULARY, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(source, key, n_tokens) of the documents in question, and the pieces (source, block_no, key, token_from,
    token_to) of their blocks."""
    chosen = documents.where(F.col("source").isin(sources) & (F.coalesce(F.length("text"), F.lit(0)) > 0)).select("source", key, "text")
    measured = cut(count_column(chosen, "text", path))
    placed = running_total(measured.where("n_tokens > 0"), ["source"], hash_bucket(measured, key), [hash_order(key), key], F.col("n_tokens"), "start")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n_tokens") - 1) / block)
    pieces = placed.select("source", key, "start", "n_tokens", F.explode(F.sequence(first, last)).alias("block_no")).select(
        "source", "block_no", key,
        F.greatest(F.col("block_no") * block - F.col("start"), F.lit(0)).alias("token_from"),
        F.least((F.col("block_no") + 1) * block - F.col("start"), F.col("n_tokens")).alias("token_to"),
    )
    return measured, pieces


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = 42, path: str = VOCABULARY, key: str = "doc_id", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix (shard, slot, source, use_no, block_no, key, token_from, token_to), and the report (source, target_share,
    max_repeats, tokens, wanted_tokens, used_tokens, share, most_uses)."""
    spark = documents.sparkSession
    goals = [r for r in targets.select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("long").alias("repeats")).collect() if r.source is not None]
    measured, pieces = blocks(documents, [g.source for g in goals], block, path, key)
    held = {r.source: r.n for r in measured.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    have = np.array([held.get(g.source, 0) or 0 for g in goals], np.int64)
    total = int(have.sum())
    n_blocks = -(-have // block)
    wanted = np.array([round((g.share or 0) * total / block) for g in goals], np.int64)
    if exact and total:
        room = [n * block * g.repeats / g.share for g, n in zip(goals, n_blocks) if (g.share or 0) > 0 and n * (g.repeats or 0) > 0]
        wanted = np.array([int((g.share or 0) * min(total, *room) / block) for g in goals], np.int64)
    slots = np.minimum(wanted, n_blocks * np.array([g.repeats or 0 for g in goals], np.int64))
    shards = -(-int(slots.sum()) // shard)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.column(0).to_pylist():
                counts, before = shard_counts(slots, shards, s, shard, seed)
                which = np.repeat(np.arange(len(counts)), counts)
                use = np.concatenate([b + np.arange(c) for b, c in zip(before, counts)]).astype(np.int64)
                turn, index = use // n_blocks[which], use % n_blocks[which]
                number = np.empty(len(use), np.int64)
                for k, t in set(zip(which.tolist(), turn.tolist())):
                    at = (which == k) & (turn == t)
                    number[at] = permute(index[at], n_blocks[k], (seed * 1_000_003 + k) * 1_000_003 + t)
                slot = np.random.default_rng((seed, 1, s)).permutation(len(use))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(use), s)), pa.array(slot), pa.array([goals[k].source for k in which], pa.string()), pa.array(turn), pa.array(number)],
                    names=["shard", "slot", "source", "use_no", "block_no"],
                )

    drawn = map_arrow(spark.range(shards).select("id"), draw, "shard bigint, slot bigint, source string, use_no bigint, block_no bigint")
    # Spark takes the drawn slots for as small as the shard numbers they come from; they must not be broadcast.
    mixed = drawn.hint("merge").join(pieces.hint("merge"), ["source", "block_no"]).select("shard", "slot", "source", "use_no", "block_no", key, "token_from", "token_to")
    used = mixed.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("used_tokens"), (F.max("use_no") + 1).alias("most_uses"))
    schema = T.StructType([T.StructField(*x) for x in (("source", T.StringType()), ("target_share", T.DoubleType()), ("max_repeats", T.LongType()), ("tokens", T.LongType()), ("wanted_tokens", T.DoubleType()))])
    asked = spark.createDataFrame([(g.source, g.share, g.repeats, int(n), float((g.share or 0) * total)) for g, n in zip(goals, have)], schema)
    joined = asked.join(used, "source", "left").withColumns({"used_tokens": F.coalesce("used_tokens", F.lit(0)), "most_uses": F.coalesce("most_uses", F.lit(0))})
    everything = Window.partitionBy()  # over the rows of the fixed table of targets
    reached = joined.withColumn("_all", F.sum("used_tokens").over(everything)).withColumn("share", F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all")).otherwise(0.0))
    return mixed, reached.select("source", "target_share", "max_repeats", "tokens", "wanted_tokens", "used_tokens", "share", "most_uses")


def short_sources(report: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sources that the mix has less of than they should give, and that could not have given it: what was drawn is
    compared first, to a block; all that a source may give, used as often as it may, decides the rest."""
    drawn_less = F.col("used_tokens") < F.col("wanted_tokens") + block
    return report.where(drawn_less & (F.greatest("used_tokens", F.col("tokens") * F.coalesce("max_repeats", F.lit(0))) < F.col("wanted_tokens"))).select("source")


def proof(mixed: DataFrame, report: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, uses_above, repeated_uses): uses beyond `max_repeats`, and uses of a block with
    the same number that come more than once; both are 0."""
    uses = mixed.select("source", "use_no", "block_no", "shard", "slot").distinct().groupBy("source", "use_no", "block_no").agg(F.count("*").alias("n"))
    per = uses.groupBy("source").agg(F.max("use_no").alias("last"), F.sum(F.col("n") - 1).alias("again"))
    joined = report.select("source", "target_share", "max_repeats").join(per, "source", "left")
    return joined.select("source", "target_share", "max_repeats", F.greatest(F.coalesce("last", F.lit(-1)) + 1 - F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("uses_above"), F.coalesce("again", F.lit(0)).alias("repeated_uses"))

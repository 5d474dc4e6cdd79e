"""Aggregations: counts, nearest-rank percentiles, recommended lengths, advantages, best of N, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import running_total
from ..functions.skew import join_by_weight
from ..session import cut

PERCENTS = (50, 90, 95, 99)


def counts(rows: DataFrame, by: Column, name: str, default: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(by, F.lit(default)).alias(name)).agg(F.count("*").alias("rows"))


def percentiles(rows: DataFrame, length: str, percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """One row (p50, ..., max, n): the nearest-rank value, number ceil(n p / 100) of the ordered ones; 0 without rows.

    Works on the histogram of lengths: no task sorts the rows, and ties cost nothing.
    """
    histogram = rows.where(F.col(length).isNotNull()).groupBy(F.col(length).cast("long").alias("v")).agg(F.count("*").alias("c"))
    bucket = F.floor(F.log2(F.greatest(F.col("v"), F.lit(0)) + F.lit(1.0)) * 64).cast("int")
    running = running_total(histogram, [], bucket, ["v"], F.col("c"), "below")
    # The number of rows is a scalar subquery, not a join.
    joined = running.withColumn("n", histogram.agg(F.coalesce(F.sum("c"), F.lit(0))).scalar())
    pick = lambda p: F.coalesce(F.min(F.when(F.col("below") + F.col("c") >= F.greatest(F.ceil(F.col("n") * p / F.lit(100.0)), F.lit(1)), F.col("v"))), F.lit(0))
    return joined.agg(*(pick(p).alias(f"p{p}") for p in percents), F.coalesce(F.max("v"), F.lit(0)).alias("max"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def above_caps(rows: DataFrame, length: str, caps: list[int]) -> DataFrame:
    """(cap, rows_above) of each cap, from one pass."""
    one = rows.agg(*(F.count_if(F.col(length) > c).alias(str(c)) for c in caps))
    pairs = F.array(*(F.struct(F.lit(c).cast("long").alias("cap"), F.col(str(c)).alias("rows_above")) for c in caps))
    return one.select(F.inline(pairs))


def recommend(rows: DataFrame, length: str, percentile: int = 95, block: int = 4096, cap: int = 40960) -> DataFrame:
    """One row (recommended, truncated_pct): the percentile rounded up to a block, at least a block, at most the cap."""
    target = percentiles(rows, length, (percentile,))
    best = F.least(F.lit(cap), F.greatest(F.lit(block), F.ceil(F.col(f"p{percentile}") / block) * block)).cast("long")
    joined = rows.select(length).withColumn("recommended", target.select(best).scalar())
    return joined.agg(F.max("recommended").alias("recommended"), F.round(100.0 * F.avg((F.col(length) > F.col("recommended")).cast("int")), 2).alias("truncated_pct"))


def advantages(rollouts: DataFrame, groups: list[str], reward: str = "reward") -> DataFrame:
    """Adds group_mean and advantage = reward - mean of its group; null keys are a group. Means are joined, so no task
    sorts a large group, and the rows of a group that has many of all rows are spread (`join_by_weight`)."""
    keyed = rollouts.withColumns({"_group": F.struct(*groups), "_place": F.monotonically_increasing_id()})
    means = cut(keyed.groupBy("_group").agg(F.avg(F.col(reward).cast("double")).alias("group_mean"), F.count("*").alias("_rows")))
    joined = join_by_weight(keyed, means, ["_group"], "_rows", "_place")
    return joined.drop("_group", "_place", "_rows").withColumn("advantage", F.col(reward) - F.col("group_mean"))


def positive(rows: DataFrame, reward: str = "reward") -> DataFrame:
    return rows.where((F.col("advantage") > 0) | (F.col(reward) >= 1))


def step_metrics(rollouts: DataFrame, step: Column, reward: str = "reward") -> DataFrame:
    return rollouts.groupBy(step.alias("step")).agg(F.count("*").alias("rollouts"), F.round(F.avg(F.col(reward).cast("double")), 6).alias("mean_reward"), F.count_if(F.col(reward) >= 1).alias("resolved"))


def best_of_n(rollouts: DataFrame, k: int | None = None, key: str = "instance_id", order: tuple[str, ...] = ("repetition_id", "rollout_id")) -> DataFrame:
    """(key, score, patch, candidates): the patch of the highest score; ties go to the first in order, NaN and null
    never win; without any valid score '' and -1."""
    rows = rollouts if k is None else rollouts.where(F.col(order[0]) < k)
    valid = F.col("score").isNotNull() & ~F.isnan("score") & (F.col("score") > -1.0)
    best = F.max_by(F.struct("score", "patch"), F.when(valid, F.struct(F.col("score"), *((-F.col(c)).alias(f"o{i}") for i, c in enumerate(order)))))
    picked = rows.groupBy(key).agg(best.alias("b"), F.count_if(valid).alias("ok"), F.count("*").alias("candidates"))
    return picked.select(key, F.when(F.col("ok") > 0, F.col("b.score")).otherwise(F.lit(-1.0)).alias("score"), F.when(F.col("ok") > 0, F.coalesce("b.patch", F.lit(""))).otherwise(F.lit("")).alias("patch"), "candidates")


def status_rates(rollouts: DataFrame, submitted: Column, resolved: Column) -> DataFrame:
    """One row: total, submitted, resolved and the three rates between them."""
    one = rollouts.agg(F.count("*").alias("total"), F.count_if(submitted).alias("submitted"), F.count_if(submitted & resolved).alias("resolved"))
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return one.select("*", rate("submitted", "total").alias("submit_rate"), rate("resolved", "submitted").alias("resolved_of_submitted"), rate("resolved", "total").alias("end_to_end"))


def repeated_commands(messages: DataFrame, key: str) -> DataFrame:
    """(key, command, times, steps): the call arguments a trajectory repeats most often; ties by the least text."""
    calls = messages.select(key, F.explode(F.filter(F.flatten(F.transform(F.filter("messages", lambda m: m["tool_calls"].isNotNull()), lambda m: F.transform(m["tool_calls"], lambda c: c["function"]["arguments"]))), lambda a: a.isNotNull())).alias("command"))
    per = calls.groupBy(key, "command").agg(F.count("*").alias("times"))
    return per.groupBy(key).agg(F.min_by("command", F.struct(-F.col("times"), "command")).alias("command"), F.max("times").alias("times"), F.sum("times").alias("steps"))


def repair_rollup(audit: DataFrame) -> DataFrame:
    """One row over the audit: rows, clean, repaired, pairs_removed, most_repairs, unique_instance_ids."""
    n = F.coalesce(F.size("repairs"), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return audit.select("instance_id", n.alias("n")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("n") == 0).alias("clean"), F.count_if(F.col("n") > 0).alias("repaired"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("pairs_removed"), F.max("n").alias("most_repairs"), F.count_distinct("instance_id").alias("unique_instance_ids"),
    )


def repair_counts(audit: DataFrame) -> DataFrame:
    """(rejected_tool_call_count, reason, repairs, adjacent): adjacent ones have the rejection right after the turn."""
    return audit.select(F.explode("repairs").alias("r")).groupBy("r.rejected_tool_call_count", "r.reason").agg(F.count("*").alias("repairs"), F.count_if(F.col("r.rejection_index") == F.col("r.assistant_index") + 1).alias("adjacent"))


#: Prefixes of the metric's key, best first.
PASS_KEYS = ("pass@1,", "pass@1", "pass_at_1,", "pass_at_1")


def pass_at_1(results: DataFrame) -> DataFrame:
    """(task, value, stderr) from (task, key, value, position): the first key of the best prefix; a task without one is
    dropped. The error's key has `_stderr` after the metric's name."""
    prefix = F.lit(None).cast("int")
    for i in reversed(range(len(PASS_KEYS))):
        prefix = F.when(F.startswith("key", F.lit(PASS_KEYS[i])), i).otherwise(prefix)
    best = results.withColumn("p", prefix).where("p IS NOT NULL").groupBy("task").agg(F.min_by(F.struct("key", "value"), F.struct("p", "position")).alias("b"))
    chosen = best.select("task", F.col("b.key").alias("key"), F.col("b.value").alias("value"))
    error = F.replace(F.replace("key", F.lit("pass@1"), F.lit("pass@1_stderr")), F.lit("pass_at_1"), F.lit("pass_at_1_stderr"))
    errors = results.select(F.col("task").alias("_t"), F.col("key").alias("_k"), F.col("value").alias("stderr"))
    return chosen.withColumn("_e", error).join(errors, (F.col("task") == F.col("_t")) & (F.col("_e") == F.col("_k")), "left").select("task", "value", "stderr")


def code_metrics(samples: DataFrame) -> DataFrame:
    """One row (n, pass_at_1, mean_reward, has_code_rate) from (passed, total, pass_all, has_code); all divided by n, 0
    without rows."""
    rate = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return samples.agg(
        F.count("*").alias("n"), rate(F.col("pass_all").cast("int")).alias("pass_at_1"),
        rate(F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(0.0)).alias("mean_reward"), rate(F.col("has_code").cast("int")).alias("has_code_rate"),
    )


def rollout_summary(rollouts: DataFrame, reward: str = "reward", steps: str = "steps") -> DataFrame:
    return rollouts.agg(F.count("*").alias("n"), F.round(F.avg(F.col(reward).cast("double")), 6).alias("avg_reward"), F.min(steps).alias("min_steps"), F.max(steps).alias("max_steps"), F.round(F.avg(F.col(steps).cast("double")), 6).alias("avg_steps"))


def latest_path(paths: DataFrame, column: str = "path") -> DataFrame:
    """The last path in lexicographic order."""
    return paths.agg(F.max(column).alias(column)).where(F.col(column).isNotNull())


def repair(messages: Column, marker: str) -> Column:
    """Messages without the assistant turns that have no call or several and are answered at once by a user message
    that holds `marker`, and without those answers."""
    indexed = F.transform(messages, lambda m, i: F.struct(i.alias("i"), m.alias("m")))

    def rejected(i: Column) -> Column:
        turn, reply = F.get(messages, i), F.get(messages, i + 1)
        bad = (turn["role"] == "assistant") & (F.coalesce(F.size(turn["tool_calls"]), F.lit(0)) != 1)
        return F.coalesce(bad & (reply["role"] == "user") & F.contains(reply["content"], F.lit(marker)), F.lit(False))

    kept = F.filter(indexed, lambda x: ~rejected(x["i"]) & ~F.when(x["i"] > 0, rejected(x["i"] - 1)).otherwise(False))
    return F.transform(kept, lambda x: x["m"])


def repair_pairs(rows: DataFrame, key: str, marker: str) -> DataFrame:
    """(key, assistant_index, rejection_index, rejected_tool_call_count): the pairs that `repair` removes."""
    flat = rows.select(key, F.posexplode("messages").alias("i", "m"))
    w = Window.partitionBy(key).orderBy("i")
    reply = flat.withColumns({"next_role": F.lead("m.role").over(w), "next_text": F.lead("m.content").over(w)})
    n = F.greatest(F.coalesce(F.size("m.tool_calls"), F.lit(0)), F.lit(0))
    hit = (F.col("m.role") == "assistant") & (n != 1) & (F.col("next_role") == "user") & F.contains("next_text", F.lit(marker))
    return reply.where(hit).select(key, F.col("i").alias("assistant_index"), (F.col("i") + 1).alias("rejection_index"), n.alias("rejected_tool_call_count"))

"""Data preparation from raw records to training rows, as lazy plans.

Inputs are DataFrames with a VARIANT column `record` (see `sources.json_files`). Every step returns the rows kept and,
where records can be rejected, the counts by reason; both come from one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M, text as X
from ..operators import context, drift, joins, metrics, predicates as P, rewards, sampling

ROW = ("instance_id", "messages", "source", "metadata")


def _extracted(records: DataFrame, mode: str, paths: tuple[str, ...], encoded: bool) -> DataFrame:
    """Adds instance_id, resolved, raw messages as typed structs, and the metadata that is kept."""
    rows = P.with_resolved(records, mode).withColumnRenamed(mode, "resolved")
    rows = P.with_instance_id(rows).withColumn("_listed", P.message_list(paths, encoded))
    meta = lambda p, t="string": F.expr(f"try_variant_get(record, '$.{p}', '{t}')")
    made = F.struct(
        "instance_id", "resolved", F.expr(drift.typed_messages("_listed")).alias("messages"),
        F.struct(
            F.coalesce(meta("exit_status"), meta("info.exit_status"), meta("metadata.exit_status")).alias("exit_status"), F.col("resolved").alias("resolved"),
            F.coalesce(meta("n_turns", "int"), F.size("_listed")).alias("n_turns"), meta("metadata.dataset").alias("dataset"), meta("metadata.teacher").alias("teacher"), P.difficulty().alias("difficulty"),
        ).alias("metadata"),
    )
    # A generator of one row: filters on what was extracted would otherwise be pushed below and extract it again.
    others = [c for c in records.columns if c not in ("record", "instance_id", "resolved", "messages", "metadata")]
    return rows.select(*others, "record", F.inline(F.array(made)))


def _finish(rows: DataFrame, source: str) -> DataFrame:
    return rows.select("instance_id", M.normalize(F.col("messages")).alias("messages"), F.lit(source).alias("source"), "metadata")


def _judged(rows: DataFrame, reason: Column, detail: Column | None, source: str) -> tuple[DataFrame, DataFrame]:
    judged = rows.withColumn("reason", reason).withColumn("detail", detail if detail is not None else F.lit(None).cast("string"))
    return _finish(judged.where("reason IS NULL"), source), P.reject_counts(judged.where("reason IS NOT NULL"), "reason", "detail")


def text_action_rows(records: DataFrame, source: str, resolved_only: bool = True, max_chars: int = 120_000, max_samples: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows in the text-action format. The sample, if any, is drawn before the rules are applied, so it may shrink."""
    rows = _extracted(records, "default_true", P.CONTAINERS, True)
    if max_samples is not None:
        rows = sampling.stratified_sample(rows.withColumn("_repo", F.regexp_replace("instance_id", r"-[^-]*\z", "")), max_samples, "_repo", "instance_id", seed).drop("round", "_repo")
    flag = F.col("resolved") if resolved_only else F.lit(True)
    return _judged(rows, P.text_action_reason(flag, F.col("messages"), F.col("instance_id"), max_chars), None, source)


def native_rows(records: DataFrame, source: str, resolved_only: bool = True, max_chars: int = 0, max_tokens: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Rows in the strict native-tool format."""
    rows = _extracted(records, "lenient", ("messages",), False)
    flag = F.col("resolved") if resolved_only else F.lit(True)
    reason = P.native_reason(flag, F.col("messages"), F.col("instance_id"), max_chars, max_tokens)
    return _judged(rows, reason, F.when(reason == "invalid_native_tool", M.native_reject_reason(F.col("messages"))), source)


def expert_rows(records: DataFrame, source: str, listed: DataFrame | None = None, low: float = 4.0, high: float = 6.0, max_samples: int | None = 5_000, max_chars: int = 120_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Expert rows: resolved (by the list, or by the record), within the range of difficulty, sampled by repo, then the
    rules (`no_messages` also for a missing id)."""
    rows = _extracted(records, "default_false", tuple(p for p in P.CONTAINERS if p != "trajectory.messages"), True)
    rows = P.resolved_or_listed(rows, listed, F.col("resolved")) if listed is not None else rows.where("resolved")
    rows = rows.where(P.in_range(F.col("metadata.difficulty"), low, high)).withColumn("_repo", F.regexp_replace("instance_id", r"-[^-]*\z", ""))
    rows = sampling.stratified_sample(rows, max_samples, "_repo", "instance_id", seed).drop("round", "_repo")
    missing = (F.coalesce(F.size("messages"), F.lit(0)) <= 0) | (F.coalesce("instance_id", F.lit("")) == "")
    return _judged(rows, P.waterfall([("no_messages", missing), ("too_long", M.chars(F.col("messages")) > max_chars)]), None, source)


def supplement_rows(records: DataFrame, source: str, *order: Column | str, prefix: str = "traj", max_chars: int = 120_000) -> DataFrame:
    """Rows of a supplement: unresolved ones, those without messages and too long ones are dropped; a missing id becomes
    `prefix_NNNNN` by the position in the unfiltered input, in the given order."""
    numbered = sampling.numbered(records, *order)
    rows = _extracted(numbered, "plain", ("messages", "conversation", "trajectory"), False)
    own = F.expr("coalesce(nullif(try_variant_get(record, '$.instance_id', 'string'), ''), nullif(try_variant_get(record, '$.id', 'string'), ''))")
    rows = rows.withColumn("instance_id", F.coalesce(own, F.format_string(f"{prefix}_%05d", "ordinal")))
    keep = F.col("resolved") & (F.coalesce(F.size("messages"), F.lit(0)) > 0) & (M.chars(F.col("messages")) <= max_chars)
    return _finish(rows.where(keep), source)


def rl_pool(instances: DataFrame, source: str, listed: DataFrame | None = None) -> DataFrame:
    """(instance_id, repo, problem_statement, base_commit, source), of the listed instances if there is a list."""
    rows = instances if listed is None else joins.only_listed(instances, listed)
    return rows.select("instance_id", "repo", problem(), "base_commit", F.lit(source).alias("source"))


def problem() -> Column:
    """The problem statement, else the issue's body, else ''."""
    return F.coalesce(F.nullif("problem_statement", F.lit("")), F.nullif("issue_body", F.lit("")), F.lit("")).alias("problem_statement")


def rl_rows(instances: DataFrame, source: str, held_out: DataFrame | None = None, most: int = 0) -> DataFrame:
    """Nested rows (data_source, prompt, env_class, instance, instance_id) without held-out instances; at most `most`
    by id, 0: all."""
    rows = instances if held_out is None else joins.without_leaks(instances, held_out)
    prompt = F.array(F.struct(F.lit("user").alias("role"), problem().alias("content")))
    out = rows.select(F.lit(source).alias("data_source"), prompt.alias("prompt"), F.lit("null").alias("env_class"), F.struct(*instances.columns).alias("instance"), "instance_id")
    return sampling.first_n(out, most, "instance_id")


def merge(inputs: list[DataFrame], major: str, minor: str, min_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows of the inputs in a pseudo-random order, the minor source repeated up to its fraction."""
    rows = sampling.union_all([df.select(*ROW) for df in inputs]).drop("input_no")
    # Rows have no id of their own; their content stands for one.
    keyed = rows.withColumn("_key", F.concat_ws(":", F.coalesce("instance_id", F.lit("")), F.xxhash64("messages", "source").cast("string")))
    merged = sampling.weighted_merge(keyed, major, minor, min_fraction, "_key", seed=seed)
    return sampling.shuffled(merged, "_key", seed, copy="copy_no").drop("_key", "copy_no")


def length_report(rows: DataFrame, percentile: int = 95, block: int = 4096, cap: int = 40_960, caps: tuple[int, ...] = (8192, 16384, 28672, 32768, 40960), policy: str = "none", limit: int = 0) -> dict:
    """Percentiles of estimated lengths, raw and after the policy and the cap, rows above caps, the recommended length,
    and what the policy did. A few numbers, read by the driver from three aggregations."""
    length = M.estimated_tokens(M.chars(F.col("messages")))
    raw = rows.select(length.alias("n"))
    clamp = limit or cap
    expanded = context.expand(rows, policy, int((limit or cap) * M.CHARS_PER_TOKEN))
    effective = expanded.select(F.least(length, F.lit(clamp)).alias("n"))
    asked = sorted({*caps, *([limit] if limit else [])})
    return {
        "raw_percentiles": metrics.percentiles(raw, "n").first().asDict(), "percentiles": metrics.percentiles(effective, "n").first().asDict(),
        "raw_above_caps": {r["cap"]: r["rows_above"] for r in metrics.above_caps(raw, "n", asked).collect()}, "above_caps": {r["cap"]: r["rows_above"] for r in metrics.above_caps(effective, "n", asked).collect()},
        **metrics.recommend(effective, "n", percentile, block, cap).first().asDict(),
        "expansion": context.expansion_stats(rows, policy, int((limit or cap) * M.CHARS_PER_TOKEN)).first().asDict(),
    }


def task_rows(tasks: DataFrame) -> DataFrame:
    """(task_id, prompt, test_list, test_imports) of code tasks (task_id, text, test_list, test_setup_code)."""
    prompt = F.array(F.struct(F.lit("user").alias("role"), X.task_prompt(F.col("text"), F.col("test_list")).alias("content")))
    return tasks.select("task_id", prompt.alias("prompt"), "test_list", X.import_lines(F.col("test_setup_code")).alias("test_imports"))


def with_tasks(tasks: DataFrame, completions: DataFrame, key: str = "task_id") -> DataFrame:
    """Each completion with the task of its number; completions without one are left out."""
    return completions.join(tasks, key)


def score_completions(tasks: DataFrame, completions: DataFrame, allow: bool = False) -> DataFrame:
    """Per-sample results (task_id, passed, total, pass_all, has_code, execution_reward) of completions (task_id, text);
    banned texts are not looked for here. Runs generated code: has to be allowed."""
    joined = with_tasks(tasks.select("task_id", "test_list", "test_imports"), completions.select("task_id", "text"))
    return rewards.execution_reward(joined, "task_id", "text", "test_list", "test_imports", allow=allow, check_safety=False)


def write_splits(rows: DataFrame, split: str, path: str) -> dict[str, int]:
    """One folder for each split; returns the rows of each."""
    rows.write.mode("overwrite").partitionBy(split).parquet(path)
    return {r[0]: r[1] for r in rows.sparkSession.read.parquet(path).groupBy(split).count().collect()}

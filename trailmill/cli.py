"""Command line: python -m trailmill.cli COMMAND ... (a session comes from spark-submit, or is made locally)."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import joins, metrics, rewards
from .plans import pipelines
from .session import clean, local_session
from .sources import cache, json_files


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _save(kept: DataFrame, counts: DataFrame | None, out: str, held_out: DataFrame | None) -> dict:
    stats: dict = {}
    if counts is not None:
        stats["rejected"] = [r.asDict() for r in counts.collect()]
    if held_out is not None:
        kept = joins.without_leaks(kept, held_out)
    kept.write.mode("overwrite").parquet(out)
    return stats | {"rows": kept.sparkSession.read.parquet(out).count()}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trailmill", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **defaults):
        c = sub.add_parser(name)
        for k, v in defaults.items():
            flag = f"--{k.replace('_', '-')}"
            if isinstance(v, bool):
                c.add_argument(flag, action=argparse.BooleanOptionalAction, default=v)
            elif v is None or isinstance(v, type):
                c.add_argument(flag, required=isinstance(v, type), type=v or str)
            else:
                c.add_argument(flag, default=v, type=type(v))
        return c

    command("prepare-text-action", input=str, output=str, source="text_action", held_out=None, max_samples=5000, max_chars=120_000, seed=42, resolved_only=True)
    command("prepare-native", input=str, output=str, source="native_tool", held_out=None, max_chars=0, filter_max_tokens=200_000, resolved_only=True)
    command("prepare-expert", input=str, output=str, source="expert", reports=None, held_out=None, max_samples=5000, min_difficulty=4.0, max_difficulty=6.0, max_chars=120_000, seed=42)
    command("prepare-rl-pool", input=str, output=str, source="pool", lite=None)
    command("rl-rows", input=str, output=str, source="pool", held_out=None, max_rows=0)
    command("merge", output=str, major="expert", minor="supplement", min_fraction=0.2, seed=42).add_argument("inputs", nargs="+")
    command("lengths", input=str, percentile=95, block_size=4096, max_cap=40_960, policy="none", context_limit=0, output=None)
    command("preprocess-cache", input=str, base=str, tokenizer=str, max_seq_length=28_672, max_samples=0, policy="none", context_limit=0, force=False)
    command("verifier-rows", output=str, experts="expert", max_samples=0).add_argument("inputs", nargs="+")
    command("best-of-n", input=str, output=str, k=8, allow_list=None, model="model")
    command("summarize-eval", results_dir=str, output=None)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    held_out = _rows(spark, a.held_out) if getattr(a, "held_out", None) else None
    if a.command.startswith("prepare-") and a.command != "prepare-rl-pool":
        records = json_files.read_directory(spark, a.input)
        if a.command == "prepare-text-action":
            kept, counts = pipelines.text_action_rows(records, a.source, a.resolved_only, a.max_chars, a.max_samples or None, a.seed)
        elif a.command == "prepare-native":
            kept, counts = pipelines.native_rows(records, a.source, a.resolved_only, a.max_chars, a.filter_max_tokens)
        else:
            listed = json_files.resolved_ids(json_files.read_directory(spark, a.reports)) if a.reports else None
            kept, counts = pipelines.expert_rows(records, a.source, listed, a.min_difficulty, a.max_difficulty, a.max_samples or None, a.max_chars, a.seed)
        return _save(kept, counts, a.output, held_out)
    if a.command == "prepare-rl-pool":
        listed = _rows(spark, a.lite) if a.lite else None
        return _save(pipelines.rl_pool(_rows(spark, a.input), a.source, listed), None, a.output, None)
    if a.command == "rl-rows":
        return _save(pipelines.rl_rows(_rows(spark, a.input), a.source, held_out, a.max_rows), None, a.output, None)
    if a.command == "merge":
        return _save(pipelines.merge([_rows(spark, p) for p in a.inputs], a.major, a.minor, a.min_fraction, a.seed), None, a.output, None)
    if a.command == "lengths":
        stats = pipelines.length_report(_rows(spark, a.input), a.percentile, a.block_size, a.max_cap, policy=a.policy, limit=a.context_limit)
        if a.output:
            json_files.write_document(stats, a.output)
        return stats
    if a.command == "preprocess-cache":
        from .operators import context

        settings = {"inputs": cache.input_state(spark, [a.input]), "tokenizer": a.tokenizer, "max_length": a.max_seq_length, "max_rows": a.max_samples, "policy": a.policy, "context_limit": a.context_limit}

        def build() -> DataFrame:
            rows = _rows(spark, a.input)
            rows = rows.orderBy("instance_id").limit(a.max_samples) if a.max_samples else rows
            if rows.isEmpty():
                raise SystemExit("no rows")
            rows = context.expand(rows, a.policy, int((a.context_limit or a.max_seq_length) * 3.2))
            return context.tokenize(rows, "instance_id", a.tokenizer, a.max_seq_length)

        df, why = cache.cached(spark, a.base, settings, build, a.force)
        return {"why": why, "rows": df.count()}
    if a.command == "verifier-rows":
        from .operators.sampling import union_all

        rows = union_all([_rows(spark, p) for p in a.inputs])
        rows = rows.withColumn("row_id", F.monotonically_increasing_id())
        out = rewards.verifier_rows(rows, tuple(a.experts.split(",")))
        return _save(out.orderBy("row_id").limit(a.max_samples) if a.max_samples else out, None, a.output, None)
    if a.command == "best-of-n":
        rollouts = _rows(spark, a.input)
        if a.allow_list:
            rollouts = joins.only_listed(rollouts, _rows(spark, a.allow_list))
        best = metrics.best_of_n(rollouts, a.k)
        json_files.prediction_lines(best, a.model).select("value").write.mode("overwrite").text(a.output)
        return {"predictions": best.count()}
    latest = json_files.latest_results(spark, a.results_dir)
    if latest is None:
        return {"metrics": []}
    record = spark.read.text(latest, wholetext=True).selectExpr("parse_json(value) AS record")
    out = {"results": latest, "samples": json_files.sample_files(spark, latest), "metrics": [r.asDict() for r in metrics.pass_at_1(json_files.metric_entries(record)).orderBy("task").collect()]}
    if a.output:
        json_files.write_document(out, a.output)
    return out


def session() -> tuple[SparkSession, bool]:
    """The session to use, and whether it is ours to clean: an active one, that of spark-submit, or a local one."""
    if active := SparkSession.getActiveSession():
        return active, False
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # started by spark-submit, whose master holds
        return SparkSession.builder.getOrCreate(), True
    return local_session(), True


def main(argv: list[str] | None = None) -> dict:
    a = parser().parse_args(argv)
    spark, own = session()
    try:
        result = run(spark, a)
    finally:
        if own:
            clean(spark)
    print(json.dumps(result, default=str))
    return result


if __name__ == "__main__":
    main()

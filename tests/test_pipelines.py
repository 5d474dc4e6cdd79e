import json

import pytest
from pyspark.sql import functions as F

from trailmill import cli
from trailmill.plans import pipelines as L


def records(spark, raws):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)], "n int, raw string").selectExpr("n", "parse_json(raw) AS record")


CALL = {"id": "1", "function": {"name": "bash", "arguments": {"command": "ls"}}}
TEXT = [{"role": "user", "content": "fix"}, {"role": "assistant", "content": "THOUGHT: look"}]
NATIVE = [{"role": "user", "content": [{"type": "text", "text": "fix"}]}, {"role": "assistant", "content": None, "tool_calls": [CALL]}, {"role": "tool", "content": "x"}]


def test_text_action(spark):
    raws = [{"id": "a-1", "messages": TEXT}, {"id": "a-2", "messages": TEXT, "resolved": False}, {"id": "a-3"}, {"messages": json.dumps(TEXT)}, {"id": "a-4", "messages": NATIVE}, {"id": "a-5", "messages": [{"role": "assistant", "content": "THOUGHT:" + "x" * 200}]}]
    kept, counts = L.text_action_rows(records(spark, raws), "s", max_chars=100)
    assert [r.instance_id for r in kept.collect()] == ["a-1"]
    assert {r.reason: r.rows for r in counts.collect()} == {"unresolved": 1, "no_messages": 1, "no_instance_id": 1, "not_text_action_format": 1, "too_long": 1}
    assert L.text_action_rows(records(spark, raws), "s", max_samples=2)[0].count() <= 2


def test_native(spark):
    two = [NATIVE[0], {"role": "assistant", "tool_calls": [CALL, CALL]}]
    raws = [{"id": "a-1", "messages": NATIVE}, {"id": "a-2", "messages": two}, {"id": "a-3", "messages": TEXT}, {"id": "a-4", "messages": NATIVE, "metadata": {"resolved": False}}]
    kept, counts = L.native_rows(records(spark, raws), "s")
    r = kept.collect()[0]
    assert r.instance_id == "a-1" and r.messages[0].content == "fix" and r.messages[2].tool_call_id == "1" and r.messages[1].tool_calls[0].type == "function"
    assert {(r.reason, r.detail): r.rows for r in counts.collect()} == {("invalid_native_tool", "assistant_multiple_tool_calls"): 1, ("invalid_native_tool", "not_native_tool_format"): 1, ("unresolved", None): 1}


def test_expert_and_supplement(spark):
    raws = [{"id": "a-1", "messages": TEXT, "difficulty": 5}, {"id": "a-2", "messages": TEXT, "resolved": True, "score": 4.0}, {"id": "a-3", "messages": TEXT, "resolved": True, "difficulty": 9}, {"id": "a-4", "resolved": True}]
    listed = spark.createDataFrame([("a-1",)], "instance_id string")
    kept, counts = L.expert_rows(records(spark, raws), "s", listed)
    assert sorted(r.instance_id for r in kept.collect()) == ["a-1", "a-2"] and counts.first().reason == "no_messages"
    sup = L.supplement_rows(records(spark, [{"messages": TEXT, "resolved": False}, {"messages": TEXT}, {"id": "x", "conversation": TEXT}]), "s", "n")
    assert sorted(r.instance_id for r in sup.collect()) == ["traj_00001", "x"]


def test_rl_rows_and_merge(spark):
    df = spark.createDataFrame([("a-1", "r", "", "body", "c"), ("a-2", "r", "p", "b", "c")], "instance_id string, repo string, problem_statement string, issue_body string, base_commit string")
    held = spark.createDataFrame([("a-2",)], "instance_id string")
    assert [r.prompt[0].content for r in L.rl_rows(df, "s", held).collect()] == ["body"] and L.rl_pool(df, "s", held).count() == 1
    one, _ = L.text_action_rows(records(spark, [{"id": f"a-{i}", "messages": TEXT} for i in range(8)]), "big")
    two, _ = L.text_action_rows(records(spark, [{"id": "b-1", "messages": TEXT}]), "small")
    assert dict(L.merge([one, two], "big", "small", 0.5).groupBy("source").count().collect()) == {"big": 8, "small": 4}
    report = L.length_report(one, policy="chunk", limit=8)
    assert report["raw_percentiles"]["n"] == 8 and report["expansion"]["input_rows"] == 8


def test_code_tasks(spark, tmp_path):
    tasks = L.task_rows(spark.createDataFrame([(1, " add ", ["assert add(1, 2) == 3"] * 4, "import math\n\n"), (2, "no", [], None)], "task_id int, text string, test_list array<string>, test_setup_code string"))
    one = tasks.where("task_id = 1").first()
    assert one.prompt[0].content.count("assert") == 3 and one.test_imports == ["import math"]
    completions = spark.createDataFrame([(1, "```python\ndef add(a, b):\n    return a + b\n```"), (2, "x")], "task_id int, text string")
    got = {r.task_id: (r.passed, r.total, r.pass_all) for r in L.score_completions(tasks, completions, allow=True).collect()}
    assert got == {1: (4, 4, True), 2: (0, 0, False)}
    assert L.write_splits(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "x int, split string"), "split", str(tmp_path / "s")) == {"a": 1, "b": 2}
    df = spark.createDataFrame([('[{"content": "hi"}]',), ('"text"',), ('{"a":1}',)], "raw string").selectExpr("parse_json(raw) AS completion")
    assert [r[0] for r in df.select(L.P.completion_text()).collect()] == ["hi", "text", '{"a":1}']


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.jsonl").write_text("\n".join(json.dumps({"id": f"a-{i}", "messages": NATIVE}) for i in range(5)))
    out = str(tmp_path / "rows")
    assert cli.main(["prepare-native", "--input", str(tmp_path / "in"), "--output", out])["rows"] == 5
    assert cli.main(["lengths", "--input", out, "--output", str(tmp_path / "l.json")])["raw_percentiles"]["n"] == 5
    args = ["preprocess-cache", "--input", out, "--base", str(tmp_path / "cache"), "--tokenizer", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"]
    assert [cli.main(args)["why"] for _ in range(2)] == ["not_ready", "hit"]
    assert cli.main(["verifier-rows", out, "--output", str(tmp_path / "v"), "--experts", "native_tool"])["rows"] == 5
    assert cli.main(["merge", out, out, "--output", str(tmp_path / "m")])["rows"] == 10
    spark.range(4).select(F.lit("a").alias("instance_id"), F.col("id").alias("repetition_id"), F.col("id").alias("rollout_id"), F.rand().alias("score"), F.lit("p").alias("patch")).write.parquet(str(tmp_path / "r"))
    assert cli.main(["best-of-n", "--input", str(tmp_path / "r"), "--output", str(tmp_path / "b")])["predictions"] == 1
    (tmp_path / "results_1.json").write_text(json.dumps({"results": {"t": {"pass@1": 0.5}}}))
    assert cli.main(["summarize-eval", "--results-dir", str(tmp_path)])["metrics"] == [{"task": "t", "value": 0.5, "stderr": None}]
    with pytest.raises(SystemExit):
        cli.main(["unknown"])

import json
import random

from conftest import MESSAGES, msg
from pyspark.sql import functions as F

from trailmill.functions import instance_ids as I, messages as M, text as X
from trailmill.operators import predicates as P


def frame(spark, *rows):
    return spark.createDataFrame([(i, list(r) if r is not None else None) for i, r in enumerate(rows)], f"row_id bigint, messages {MESSAGES}")


def value(df, column):
    return [r[0] for r in df.orderBy("row_id").select(column.alias("x")).collect()]


def model_attach(messages, passes):
    messages = [dict(m) for m in messages]
    for _ in range(passes):
        pending = []
        for m in messages:
            if m["role"] == "assistant" and m["calls"]:
                pending = [i for i in m["calls"] if i]
            if m["role"] == "tool" and not m["id"] and pending:
                m["id"] = pending.pop(0)
    return [m["id"] for m in messages]


def test_call_ids_against_model(spark):
    rng = random.Random(7)
    cases = []
    for _ in range(300):
        cases.append([{"role": rng.choice(["assistant", "tool", "user"]), "calls": [rng.choice(["a", "b", "", None]) for _ in range(rng.randrange(3))], "id": rng.choice([None, None, "", "z"])} for _ in range(rng.randrange(8))])
    df = frame(spark, *([msg(m["role"], "x", [(i, "") for i in m["calls"]], m["id"]) for m in c] for c in cases))
    for passes in (1, 2, 3):
        got = value(df, F.transform(M.attach_call_ids(F.col("messages"), passes), lambda m: m["tool_call_id"]))
        assert [[x or None for x in g] for g in got] == [[x or None for x in model_attach(c, passes)] for c in cases]


def test_json_length_matches_python(spark):
    texts = ["", "abc", 'q"\\\n\r\t\b\f', "\x01\x1f", "é语🙂", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id int, t string")
    assert value(df, X.json_string_length(F.col("t"))) == [len(json.dumps(t, ensure_ascii=False)) for t in texts]
    calls = [("i", 'ls "x"\n'), (None, "")]
    df = frame(spark, [msg("assistant", "héllo", calls)], [msg("user", None)], [], None)
    want = len("héllo") + len(json.dumps([{"id": i, "type": "function", "function": {"name": "bash", "arguments": a}} for i, a in calls], ensure_ascii=False))
    assert value(df, M.chars(F.col("messages"))) == [want, 0, 0, 0]


def test_formats(spark):
    call = [("1", "{}")]
    df = frame(
        spark,
        [msg("assistant", "x", call)],
        [msg("assistant", "THOUGHT: a ACTION: b")],
        [msg("user", "<returncode>0"), msg("assistant", "x", call)],
        [msg("assistant", "x", call), msg("user", "<returncode>0")],
        [msg("assistant", "x", call), msg("assistant", "y")],
        [msg("assistant", "x", call * 2)],
        [],
        None,
    )
    assert value(df, M.looks_native(F.col("messages"))) == [True, False, False, True, True, True, False, False]
    assert value(df, M.native_reject_reason(F.col("messages"))) == [None, "not_native_tool_format", "not_native_tool_format", None, "assistant_missing_tool_calls", "assistant_multiple_tool_calls", "not_native_tool_format", "not_native_tool_format"]
    assert value(df, M.looks_text_action(F.col("messages"))) == [False, True, True, True, False, False, False, False]


def test_response_view(spark):
    s, u, a, e = msg("system", "s"), msg("user", "u"), msg("assistant", "a"), msg("exit", "e")
    df = frame(spark, [s, u, a, e, u, u], [s, u], [s, u, u], [s, u, e, a], None)
    assert value(df, F.transform(M.response_view(F.col("messages")), lambda m: m["role"])) == [["system", "user", "assistant"], ["user"], ["system", "user"], ["system", "user", "assistant"], []]
    assert value(df, M.response_problem(F.col("messages"))) == [None, "too_few_messages", "too_few_messages", None, "too_few_messages"]


def test_normalize_and_linearize(spark):
    df = frame(spark, [msg(None, None), msg("assistant", "x", [("1", "{}")], "no", "no"), msg("tool", "t", None, "", "n")])
    m = value(df, M.normalize(F.col("messages")))[0]
    assert [(x.role, x.content, x.tool_call_id, x.name) for x in m] == [("user", "", None, None), ("assistant", "x", None, None), ("tool", "t", "1", "n")]
    assert value(df, M.linearize(F.col("messages"))) == ["[user]\n\n\n[assistant]\nx\n\n[tool]\nt"]


def test_repo_names(spark):
    cases = {
        "Owner__Name-12": "owner__name", " owner/name#7 ": "owner__name", "owner_1776_na-me-3": "owner__na-me", "set::owner__n.py-4::chunk2": "owner__n.py", "owner__n.py.2c2e5adb.func_pm__96f5e528": "owner__n.py",
        "run_traj_00012": None, "": None, "  ": None, None: None, "owner_s_name-1": "owner__name", "x" * 200_000 + "::a__b-1": "a__b", "a__b-" + "1" * 100_000: "a__b", "a:b::c__d-1": "c__d", "owner__a_1776_b-2": "owner__a_1776_b",
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "row_id int, x string")
    assert value(df, I.repo_name(F.col("x"))) == list(cases.values())
    plain = spark.createDataFrame([(0, "a-b-1"), (1, "abc"), (2, "-1"), (3, "a-\n")], "row_id int, x string")
    assert value(plain, I.repo_from_instance_id(F.col("x"))) == ["a-b", "abc", "", "a"]


def records(spark, *raws):
    return spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(raws)], "row_id int, raw string").selectExpr("*", "parse_json(raw) AS record")


def test_resolved_modes(spark):
    df = records(
        spark, {}, {"resolved": None}, {"resolved": "false"}, {"resolved": "Yes"}, {"success": 0}, {"info": {"resolved": "no"}}, {"exit_status": "Submitted"}, {"exit_status": "Timeout"},
        {"exit_status": "", "info": {"exit_status": "finished"}}, {"metadata": {"resolved": False}}, {"exit_status": "completed"}, {"is_resolved": []}, {"exit_status": {"a": 1}},
    )
    got = {m: [r[m] for r in P.with_resolved(df, *P.MODES).orderBy("row_id").collect()] for m in P.MODES}
    assert got["default_true"] == [True, False, False, True, False, True, True, False, True, True, False, False, False]
    assert got["default_false"] == [False, False, False, True, False, True, True, False, True, False, False, False, False]
    assert got["lenient"] == [True, False, False, True, False, True, True, True, True, False, True, False, True]
    assert got["plain"] == [True, False, True, True, False, True, True, True, True, True, True, True, True]


def test_extraction(spark):
    m = [{"role": "user"}]
    df = records(
        spark, {"messages": m}, {"messages": [], "conversation": m}, {"messages": "[]", "trajectory": json.dumps(m)}, {"info": {"messages": m}}, {"trajectory": {"messages": m}}, {"messages": "{bad"}, {"messages": {"a": 1}},
        {"instance_id": "", "id": 5, "metadata": {"sample_id": "a::b::c"}}, {"metadata": {"sample_id": "a::b::c"}}, {"difficulty": None, "score": "4.5"},
    )
    assert value(df, P.container()) == ["messages", "conversation", "trajectory", "info.messages", "trajectory.messages", None, None, None, None, None]
    assert [r.instance_id for r in P.with_instance_id(df).orderBy("row_id").collect()][7:9] == ["5", "b::c"]
    assert value(df, P.difficulty())[-1] == 4.5


def test_text_functions(spark):
    code = "```python\ndef f(): pass\n```\ntext\n```\nx = 1\n```"
    rows = [code, "no fence", "", "```\na\n``` ```\nb\n```", "  　", None]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id int, x string")
    assert value(df, X.extract_code(F.col("x"))) == ["def f(): pass", "no fence", None, "b", None, None]
    assert value(df, X.is_blank(F.col("x"))) == [False, False, True, False, True, True]
    df = spark.createDataFrame([(0, "OS.System('x')"), (1, "reopen(x)"), (2, "print(1)"), (3, None)], "row_id int, x string")
    assert value(df, X.is_safe_code(F.col("x"))) == [False, False, True, None]
    df = spark.createDataFrame([(0, "a" * 9999), (1, "a" * 10000), (2, "b" * 5000 + "x" + "c" * 5000)], "row_id int, x string")
    a, b, c = value(df, X.elide(F.col("x")))
    assert a == "<output>\n" + "a" * 9999 + "</output>" and "\n0 characters elided" in b and "\n1 characters elided" in c and "x" not in c.split("<output_head>")[1].split("</output_head>")[0]
    df = spark.createDataFrame([(0, " t ", ["1", "2", "3", "4"], "import a\n\n  \nimport b")], "row_id int, t string, l array<string>, s string")
    assert "1\n2\n3\nPut" in value(df, X.task_prompt(F.col("t"), F.col("l")))[0] and value(df, X.import_lines(F.col("s")))[0] == ["import a", "import b"]
    assert value(df, X.container_image(F.lit("A__b-1"), F.lit(None).cast("string"), "p.", "_s_"))[0] == "p.a_s_b-1:latest"

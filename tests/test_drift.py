import json

from trailmill.operators import drift
from trailmill.plans import drift_queries

SCHEMA = "file_id bigint, run_id string, file_seq int, file_name string, line_no int, raw string, record string, field string"


def lines(spark, *files):
    rows = [(f, run, seq, "x", i, raw if raw is None or isinstance(raw, str) else json.dumps(raw), "clash", "clash") for f, run, seq, raws in files for i, raw in enumerate(raws, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted(tuple(r) for r in drift.changes(df).collect())


def test_kinds_of_change(spark):
    df = lines(
        spark,
        (1, "r", 1, [{"messages": [], "resolved": True, "extra": 1}, {"messages": [], "resolved": None}]),
        (2, "r", 2, [{"conversation": "[]", "resolved": "yes", "info": {"exit_status": 1}}]),
        (3, "r", 3, [{"conversation": "[]", "metadata": {"resolved": 1}, "exit_status": {"code": 1}}]),
        (9, "r", 5, [{"other": 1}]),
        (4, "q", 1, [{"a": 1}]),
    )
    assert found(df) == sorted(
        [
            (2, "renamed", "messages", "conversation"), (2, "retyped", "messages", "conversation"), (2, "retyped", "resolved", "resolved"), (2, "removed", "extra", ""), (2, "added", "", "info.exit_status"),
            (3, "renamed", "resolved", "metadata.resolved"), (3, "retyped", "resolved", "metadata.resolved"), (3, "renamed", "info.exit_status", "exit_status"), (3, "retyped", "info.exit_status", "exit_status"),
        ]
    )


def test_two_for_one_is_no_rename(spark):
    df = lines(spark, (1, "r", 1, [{"resolved": True}]), (2, "r", 2, [{"success": True, "is_resolved": True}]))
    assert found(df) == [(2, "added", "", "is_resolved"), (2, "added", "", "success"), (2, "removed", "resolved", "")]


def test_unreadable_and_empty(spark):
    df = lines(spark, (1, "r", 1, [{"a": 1}, None, "", "  ", '{"a": ', "[1]", "3"]), (2, "r", 2, [None, "{"]), (3, "r", 3, [{"a": None}]), (None, "r", 4, [{"b": 1}]), (5, None, 4, [{"b": 1}]))
    assert found(df) == [(2, "removed", "a", ""), (3, "added", "", "a")]
    assert drift.unify(df).count() == 4
    empty = df.limit(0)
    assert found(empty) == [] and drift.unify(empty).count() == 0 and drift.union_schema(empty).count() == 0


def test_majority_decides_type_and_ties_by_name(spark):
    df = lines(spark, (1, "r", 1, [{"a": 1}, {"a": 1}, {"a": "x"}]), (2, "r", 2, [{"a": 1}, {"a": "x"}]), (3, "r", 3, [{"a": "x"}, {"a": 1}, {"a": "y"}]))
    assert found(df) == [(3, "retyped", "a", "a")]


def test_unify_converts_each_branch(spark):
    parts = [{"type": "text", "text": "a"}, {"type": "image", "text": "not this", "url": "u"}, {"text": "nor this"}, {"type": "text"}, None, 3, "b"]
    df = lines(
        spark,
        (1, "r", 1, [
            {"instance_id": "x", "messages": [{"role": "user", "content": parts, "tool_calls": [{"id": "1", "type": "function", "function": {"name": "bash", "arguments": {"command": "ls"}}}]}], "resolved": True, "exit_status": "Done"},
            {"id": 7, "conversation": json.dumps([{"role": "user", "content": "hi"}]), "success": 0, "info": {"exit_status": {"code": 1, "reason": "Timeout"}}},
            {"metadata": {"instance_id": "m"}, "trajectory": {"messages": "no json"}, "is_resolved": "Yes", "exit_status": 3},
        ]),
    )
    a, b, c = drift.unify(df).orderBy("line_no").collect()
    assert (a.instance_id, a.messages[0].content, a.messages[0].tool_calls[0].function.arguments, a.resolved, a.exit_status) == ("x", "ab", '{"command":"ls"}', True, "Done")
    assert (b.instance_id, b.messages_kind, b.messages[0].content, b.resolved, b.resolved_kind, b.exit_status) == ("7", "string", "hi", False, "number", "Timeout")
    assert (c.instance_id, c.messages, c.resolved, c.exit_status, c.exit_status_number) == ("m", None, True, "3", 3.0)


def test_union_schema_names_first_file(spark):
    df = lines(spark, (1, "r", 1, [{"a": 1}]), (2, "r", 2, [{"a": "x"}, {"a": None}]))
    assert sorted(map(tuple, drift.union_schema(df).collect())) == [("a", "null", 1, 1, 2), ("a", "number", 1, 1, 1), ("a", "string", 1, 1, 2)]


def test_same_for_any_number_of_partitions(spark, sf):
    df = spark.read.parquet(f"{sf}/raw_records.parquet")
    want = found(df)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert found(df.repartition(7)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_records_query_gives_whole_records(spark, sf):
    raw = spark.read.parquet(f"{sf}/raw_records.parquet")
    got, want = drift_queries.p1_records(spark, sf), drift.unify(raw)
    assert got.columns == want.columns and {"messages", "record_json"} <= set(got.columns)
    rows = got.where("messages_kind = 'array'").collect()
    assert any(r.messages and r.messages[0].content for r in rows) and all(json.loads(r.record_json) for r in rows)


def test_every_path_has_typed_branches(spark):
    docs = [
        {"a": 1, "info": {"x": "t", "it's": None}, "file_id": "own", "B": True}, {"a": "1", "info": "plain", "b": [1, {"c": 2}]}, {"a": None, "info": {"x": 2.5}}, {"a": 10**25, "q.r": "dotted"}, {}, "no record", None,
    ]
    df = lines(spark, (1, "r", 1, ["{bad" if d == "no record" else d for d in docs])).selectExpr("file_id", "run_id", "file_seq", "line_no - 1 AS line_no", "raw", "record")
    rows = {(r.line_no, r.field): (r.kind, r.as_string, r.as_number, r.as_boolean, r.as_json) for r in drift.branches(df).collect()}
    assert rows[0, "a"] == ("number", None, 1.0, None, None) and rows[1, "a"] == ("string", "1", None, None, None) and rows[2, "a"] == (None,) * 5
    assert rows[0, "info.x"] == ("string", "t", None, None, None) and rows[1, "info"] == ("string", "plain", None, None, None) and rows[0, "info.it's"] == (None,) * 5
    assert rows[0, "B"] == ("boolean", None, None, True, None) and json.loads(rows[1, "b"][4]) == [1, {"c": 2}] and {n for n, _ in rows} == {0, 1, 2, 3}
    wide = {r.line_no: r.asDict(recursive=True) for r in drift.fuse(df).collect()}
    assert set(wide) == {0, 1, 2, 3, 4} and wide[0]["file_id"] == 1 and wide[0]["file_id_"] == {"kind": "string", "as_string": "own"}
    assert wide[0]["a"] == {"kind": "number", "as_number": 1.0, "as_string": None} and wide[1]["a"]["as_string"] == "1" and wide[3]["a"]["as_number"] == 1e25
    assert wide[0]["info"]["kind"] is None and wide[1]["info"]["as_string"] == "plain" and wide[2]["info__x"] == {"kind": "number", "as_number": 2.5, "as_string": None}
    assert wide[0]["B"]["as_boolean"] and json.loads(wide[1]["b_"]["as_json"]) == [1, {"c": 2}] and wide[3]["q__r"]["as_string"] == "dotted" and wide[4]["a"]["kind"] is None
    seen = {(r.field, r.kind): (r.first_seq, r.files, r.records) for r in drift.appearances(df).collect()}
    assert seen["a", "number"] == (1, 1, 2) and seen["a", "null"] == (1, 1, 1)
    assert drift.fuse(df.limit(0)).count() == 0 and drift.branches(df.limit(0)).count() == 0 and drift.appearances(df.limit(0)).count() == 0

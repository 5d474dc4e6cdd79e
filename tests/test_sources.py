import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from trailmill.operators import metrics
from trailmill.sources import cache, json_files as J


def test_directory(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/x.jsonl").write_text('{"i": 1}\n\n  \n{"i": 2}\n')
    (tmp_path / "a/b/y.json").write_text('[{"i": 3}, {"i": 4}]')
    (tmp_path / "a/b/z.traj.json").write_text('{\n"i": 5}')
    (tmp_path / "a/bad.json").write_text("{oops")
    got = sorted(r.i for r in J.read_directory(spark, str(tmp_path)).selectExpr("variant_get(record, '$.i', 'int') AS i").collect())
    assert got == [1, 2, 3, 4, 5]
    (tmp_path / "a/x2.jsonl").write_text("{oops\n")
    with pytest.raises(Exception, match="MALFORMED|PARSE|parse"):
        J.read_directory(spark, str(tmp_path)).collect()
    assert J.read_lines(spark, str(tmp_path / "a/x.jsonl")).count() == 2
    assert J.read_document(spark, str(tmp_path / "a/b/z.traj.json")).first().i == 5


def test_reports_and_metrics(spark):
    text = json.dumps({"a": {"resolved": True}, "b": {"resolved": False}, "c": 3, "d": {}})
    df = spark.createDataFrame([(text,)], "raw string").selectExpr("parse_json(raw) AS record")
    assert [r.instance_id for r in J.resolved_ids(df).collect()] == ["a"]
    assert dict(J.report_flags(df).collect()) == {"a": True, "b": False, "c": False, "d": False}
    text = json.dumps({"results": {"t": {"acc": 1.0, "pass@1,create": 0.5, "pass@1_stderr,create": 0.1}, "u": {"acc": 1}, "v": {"pass_at_1,n": 0.25}}})
    df = spark.createDataFrame([(text,)], "raw string").selectExpr("parse_json(raw) AS record")
    assert sorted(map(tuple, metrics.pass_at_1(J.metric_entries(df)).collect())) == [("t", 0.5, 0.1), ("v", 0.25, None)]


def test_paths(spark, tmp_path):
    for n in ("results_1.json", "results_2.json", "samples_a_2.jsonl", "samples_b_1.jsonl"):
        (tmp_path / n).write_text("{}")
    latest = J.latest_results(spark, str(tmp_path))
    assert latest.endswith("results_2.json") and [p[-17:] for p in J.sample_files(spark, latest)] == ["samples_a_2.jsonl"]
    assert len(J.sample_files(spark, str(tmp_path / "results_9.json"))) == 2 and J.latest_results(spark, str(tmp_path / "none")) is None
    assert J.first_existing(spark, str(tmp_path / "no"), latest) == latest
    assert J.verifier_inputs(spark, "no", str(tmp_path), "buffer*.jsonl", "f") == ["f"] and len(J.verifier_inputs(spark, latest, str(tmp_path), "samples_*", "f")) == 3
    with pytest.raises(FileNotFoundError):
        J.first_existing(spark, str(tmp_path / "no"))


def test_prediction_maps(spark):
    rows = [(f'i"{k}\n', f"diff {k}" if k else None, k / 2) for k in range(7)] + [(None, "x", 1.0)]
    df = spark.createDataFrame(rows, "instance_id string, patch string, score double")
    one = J.prediction_maps(df, "m").collect()
    assert len(one) == 1 and {k: v.get("model_patch") for k, v in json.loads(one[0].value).items()} == {r[0]: r[1] for r in rows[:-1]}
    many = J.prediction_maps(df, "m", 2).collect()
    assert len(many) > 1 and sorted(k for r in many for k in json.loads(r.value)) == sorted(r[0] for r in rows[:-1])
    assert J.prediction_maps(df.limit(0), "m").count() == 0


def test_records_with_reports(spark, tmp_path):
    for folder, name, docs in (("r", "a.jsonl", [{"instance_id": "x"}, {"id": "y", "resolved": True}, {"id": "z"}]), ("e", "report.json", [{"x": {"resolved": True}, "z": {"resolved": False}, "q": 3}])):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("\n".join(map(json.dumps, docs)))
    flag = F.expr("try_variant_get(record, '$.resolved', 'boolean')")
    assert sorted(r.instance_id for r in J.read_with_resolved(spark, str(tmp_path / "r"), str(tmp_path / "e"), flag).collect()) == ["x", "y"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", None)], "a string, b int")
    J.write_lines(df, str(tmp_path / "out"))
    assert [json.loads(x) for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()] == [{"a": "é", "b": None}]
    J.write_document({"é": [1]}, str(tmp_path / "d/x.json"))
    assert (tmp_path / "d/x.json").read_text() == '{\n  "é": [\n    1\n  ]\n}'
    J.write_trajectories(spark.createDataFrame([(1, "train", "x")], "step int, phase string, body string"), str(tmp_path / "t"))
    assert list((tmp_path / "t/step=1/phase=train").glob("*.json"))
    spark.range(3).write.parquet(str(tmp_path / "tab/train.parquet"))
    assert J.read_table(spark, {"tab": str(tmp_path / "tab")}, "tab", "train").count() == 3


def test_cache(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    base, settings = str(tmp_path), {"inputs": ["x"], "tokenizer": "t", "max_length": 1, "max_rows": 0, "policy": "none", "context_limit": 0}
    df, why = cache.cached(spark, base, settings, build)
    assert (df.count(), why) == (5, "not_ready")
    assert cache.cached(spark, base, settings, build)[1] == "hit" and len(calls) == 1
    assert cache.cached(spark, base, settings, build, force=True)[1] == "forced"
    assert cache.cached(spark, base, settings, build, enabled=False)[1] == "disabled"
    assert cache.cached(spark, base, settings | {"policy": "chunk"}, build)[1] == "not_ready"
    path = cache.location(base, {"version": cache.VERSION} | settings)
    assert cache.decide(spark, path, {"version": 2} | settings) == "changed"
    folder = tmp_path / path.rsplit("/", 1)[1]
    (folder / ".manifest.json.crc").unlink(missing_ok=True)
    (folder / ".manifest.part.crc").unlink(missing_ok=True)
    (folder / "manifest.json").write_text("{bad")
    assert cache.decide(spark, path, settings) == "not_ready"
    assert cache.input_state(spark, [base])[0]["size"] > 0


def test_cache_has_one_builder_and_others_wait(spark, tmp_path):
    base, settings = f"file://{tmp_path}/shared", {"inputs": [], "policy": "keep"}

    def never():
        raise AssertionError("only the builder builds")

    with pytest.raises(TimeoutError):
        cache.cached(spark, base, settings, never, builder=False, timeout_s=0.2, poll_s=0.05)
    with ThreadPoolExecutor(1) as pool:
        other = pool.submit(cache.cached, spark, base, settings, never, builder=False, timeout_s=60, poll_s=0.1)
        time.sleep(0.5)
        assert not other.done()
        cache.cached(spark, base, settings, lambda: spark.range(3))
        df, why = other.result(60)
    assert df.count() == 3 and why == "not_ready"


def test_two_builders_at_once_build_once(spark, tmp_path):
    base, settings, calls = f"file://{tmp_path}/both", {"inputs": [], "policy": "keep"}, []

    def build():
        calls.append(1)
        time.sleep(1.0)
        return spark.range(4)

    with ThreadPoolExecutor(3) as pool:
        done = [pool.submit(cache.cached, spark, base, settings, build, timeout_s=120, poll_s=0.1) for _ in range(3)]
        assert [f.result(120)[0].count() for f in done] == [4, 4, 4]
    assert len(calls) == 1


def test_a_rebuild_leaves_readers_their_data(spark, tmp_path):
    base, settings = f"file://{tmp_path}/again", {"inputs": [], "policy": "keep"}
    old, _ = cache.cached(spark, base, settings, lambda: spark.range(5))

    def fails():
        raise ValueError("no rows")

    with pytest.raises(ValueError):
        cache.cached(spark, base, settings, fails, force=True)
    assert cache.cached(spark, base, settings, fails)[0].count() == 5  # the lock is free and the old result stands
    new, why = cache.cached(spark, base, settings, lambda: spark.range(7), force=True)
    assert (old.count(), new.count(), why) == (5, 7, "forced")
    for n in (8, 9):
        cache.cached(spark, base, settings, lambda n=n: spark.range(n), force=True)
    folder = next((tmp_path / "again").iterdir())
    assert len(list(folder.glob("data-*"))) == 2 and not (folder / ".builder").exists()
    (folder / ".builder").touch()
    assert not cache._claim(spark, str(folder), 60)  # a lock that is not old is respected
    os.utime(folder / ".builder", (0, 0))
    assert cache._claim(spark, str(folder), 60)

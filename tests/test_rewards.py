import pytest
from conftest import MESSAGES, msg
from pyspark.sql import functions as F

from trailmill.operators import rewards as R
from trailmill.operators.sandbox import run_tests


def test_format_reward(spark):
    rows = ["```python\ndef f():\n    return 1\n```", "```\ndef f(:\n```", "```\nimport os; os.system('x')\n```", "", None, "x = 1"]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id int, text string")
    assert [r.format_reward for r in R.format_reward(df, "text").orderBy("row_id").collect()] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def test_execution(spark):
    add = "def add(a, b):\n    return a + b"
    rows = [
        (1, add, ["assert add(1, 2) == 3", "assert add(1, 1) == 3"], []), (2, add, ["assert add(1, 2) == 3"], ["import math"]), (3, "print('noise')\n" + add, ["assert add(1, 2) == 3"], []), (4, "def add(a, b):\n    while True: pass", ["add(1, 2)"], []),
        (5, "eval('1')", ["assert True"], []), (6, add, [], []), (7, None, ["assert True"], None), (8, "def add(:", ["assert True"], []), (9, add, ["assert add(1, 2) == 3"], ["import math"]),
    ]
    df = spark.createDataFrame(rows, "row_id int, text string, tests array<string>, imports array<string>")
    got = {r.row_id: (r.passed, r.total, r.execution_reward) for r in R.execution_reward(df, "row_id", "text", "tests", "imports", allow=True).collect()}
    assert got == {1: (1, 2, 0.5), 2: (1, 1, 1.0), 3: (0, 1, 0.0), 4: (0, 1, 0.0), 5: (0, 1, 0.0), 6: (0, 0, 0.0), 7: (0, 1, 0.0), 8: (0, 1, 0.0), 9: (1, 1, 1.0)}
    with pytest.raises(PermissionError):
        R.execution_reward(df, "row_id", "text", "tests", "imports")


def test_scores_cannot_be_forged():
    add = "def add(a, b):\n    return a + b\n"
    tests = ["assert add(1, 2) == 3", "assert add(1, 2) == 4", "assert add(2, 2) == 4"]
    assert run_tests(add, [], tests) == 2 and run_tests(add, [], []) == 0
    for forged in ("print('3 3')\nraise SystemExit(0)", "import sys\nsys.stdout.write('3 3')\nsys.exit(0)", "import os\nos._exit(0)", "import os\nos.write(3, b'0\\n1\\n2\\nend\\n')\nos._exit(0)", "print('3 3')\n" + add, "while True: pass", "x = '\ud800'", "import os\nfor i in range(3, 20):\n    try: os.write(i, b'x' * 10**6)\n    except OSError: pass"):
        assert run_tests(forged, [], tests) == 0, forged
    assert run_tests(add, ["import math"], ["assert math.pi > 3", "raise SystemExit(0)", "assert True"]) == 0  # an exit ends the run
    assert run_tests("seen = []", [], ["seen.append(1)", "assert seen == [1]", "assert False"] + ["assert True"] * 40) == 42


def test_resolve_reward(spark):
    diff = "diff --git"
    rows = [(1, diff + "x" * 31, 0), (2, diff + "x" * 30, 0), (3, "  " + diff + "x" * 30, 10), (4, " \n", 3), (5, None, None), (6, diff + "x" * 40, 200), (7, "no" * 40, None), (8, diff + "x" * 40, None)]
    df = spark.createDataFrame(rows, "row_id int, patch string, steps int")
    got = {r.row_id: round(r.x, 6) for r in df.select("row_id", R.resolve_reward(F.col("patch"), F.col("steps")).alias("x")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.9, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 1.0}
    assert df.select(R.resolve_reward(F.col("patch"), F.col("steps"), F.lit(True)).alias("x")).where("x > 0").count() == 5


def test_verifier_rows(spark):
    m = [msg("user", None), msg("assistant", "x")]
    rows = [(1, m, "expert", 0, None), (2, m, "expert", None, None), (3, m, "other", None, 1.0), (4, m, "other", None, 0.99), (5, [], "expert", 1, 1.0), (6, None, None, None, None), (7, m, None, None, None)]
    df = spark.createDataFrame(rows, f"row_id int, messages {MESSAGES}, source string, label int, reward double")
    got = {r.row_id: (r.text, r.label) for r in R.verifier_rows(df, ("expert",), F.col("label"), F.col("reward")).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 0, 2: 1, 3: 1, 4: 0, 7: 0} and got[1][0] == "[user]\n\n\n[assistant]\nx"
    scored = R.score(df.where("source IS NOT NULL"), "source", lambda s: s.str.len().astype(float)).collect()
    assert scored[0].score == 6.0

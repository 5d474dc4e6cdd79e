import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from trailmill.session import local_session

    # A plan whose generated code is too large to compile would silently run slower; here it fails.
    session = local_session(4, **{"spark.driver.memory": "3g", "spark.sql.codegen.fallback": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return DATA


MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>>"


def msg(role, content=None, calls=None, call_id=None, name=None):
    made = None if calls is None else [(i, "function", ("bash", a)) for i, a in calls]
    return (role, content, made, call_id, name)

"""Rewards and verifier data."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import messages as M
from ..functions.text import extract_code, is_blank, is_safe_code, trim_ws
from ..session import map_pandas, ship
from .sandbox import run_tests


def _parses(code: str | None) -> bool:
    try:
        ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return code is not None


def parses(df: DataFrame, code: str, name: str = "parses") -> DataFrame:
    """Adds whether the text is Python; false for null."""
    ship(df.sparkSession)

    @F.pandas_udf(T.BooleanType())
    def check(s: pd.Series) -> pd.Series:
        known = {code: _parses(code) for code in s.unique()}  # repeated texts are parsed once a batch
        return s.map(known).astype(bool)

    return df.withColumn(name, check(F.col(code)))


def format_reward(df: DataFrame, completion: str, name: str = "format_reward") -> DataFrame:
    """Adds 1 if the completion has code that is safe and parses, else 0."""
    with_code = df.withColumn("_code", extract_code(F.col(completion)))
    checked = parses(with_code, "_code", "_ok")
    return checked.withColumn(name, F.when(F.col("_ok") & F.coalesce(is_safe_code(F.col("_code")), F.lit(False)), 1.0).otherwise(0.0)).drop("_code", "_ok")


def execution_reward(df: DataFrame, key: str, completion: str, tests: str, imports: str, allow: bool = False, check_safety: bool = True) -> DataFrame:
    """(key, passed, total, pass_all, has_code, execution_reward). Runs generated code, so it has to be allowed
    explicitly; each distinct (code, imports, tests) runs once. With `check_safety` code with a banned text scores 0."""
    if not allow:
        raise PermissionError("running generated code has to be allowed")
    rows = df.select(key, extract_code(F.col(completion)).alias("code"), F.coalesce(F.col(tests), F.array().cast("array<string>")).alias("tests"), F.coalesce(F.col(imports), F.array().cast("array<string>")).alias("imports"))
    run = F.col("code").isNotNull() & (F.size("tests") > 0)
    if check_safety:
        run = run & is_safe_code(F.col("code"))
    work = rows.where(run).select("code", "imports", "tests").dropDuplicates()

    def execute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(passed=[run_tests(c, list(i), list(t)) for c, i, t in zip(b["code"], b["imports"], b["tests"])])

    done = map_pandas(work, execute, "code string, imports array<string>, tests array<string>, passed int")
    joined = rows.join(done, ["code", "imports", "tests"], "left")
    passed, total = F.coalesce("passed", F.lit(0)), F.size("tests")
    return joined.select(key, passed.alias("passed"), total.alias("total"), ((total > 0) & (passed == total)).alias("pass_all"), F.col("code").isNotNull().alias("has_code"), F.when(total > 0, passed / total).otherwise(0.0).alias("execution_reward"))


def weighted(format_part: Column, execution_part: Column, weights: tuple[float, float] = (0.1, 0.9)) -> Column:
    return format_part * weights[0] + execution_part * weights[1]


def looks_resolved(patch: Column) -> Column:
    """The stripped patch starts as a diff and the patch as it stands has more than 40 characters."""
    return F.coalesce(F.startswith(trim_ws(patch), F.lit("diff --git")) & (F.length(patch) > 40), F.lit(False))


def resolve_reward(patch: Column, steps: Column, resolved: Column | None = None, penalty: float = 0.01) -> Column:
    """0 for a blank patch, else 1 if resolved (by the harness, else by the look of the patch) less the penalty for each
    step, at least 0; missing steps are 0."""
    solved = looks_resolved(patch) if resolved is None else F.coalesce(resolved, F.lit(False))
    return F.when(is_blank(patch), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), solved.cast("double") - F.lit(penalty) * F.coalesce(steps, F.lit(0))))


def verifier_rows(rows: DataFrame, experts: tuple[str, ...], label: Column | None = None, reward: Column | None = None) -> DataFrame:
    """(row_id, text, label): an explicit label wins, else 1 for expert sources, else whether the reward is at least 1;
    rows without messages are left out."""
    scored = (F.coalesce(reward, F.lit(0.0)) >= 1.0) if reward is not None else F.lit(False)
    value = F.when(F.coalesce(F.col("source").isin(*experts), F.lit(False)), 1).otherwise(scored.cast("int"))
    if label is not None:
        value = F.coalesce(label.cast("int"), value)
    return rows.where(F.size("messages") > 0).select("row_id", M.linearize(F.col("messages")).alias("text"), value.alias("label"))


def score(df: DataFrame, text: str, scorer: Callable[[pd.Series], pd.Series], name: str = "score") -> DataFrame:
    """Adds the scores of a batch function over texts."""
    return df.withColumn(name, F.pandas_udf(scorer, T.DoubleType())(F.col(text)))

"""Predicates over raw records (VARIANT column `record`) and the rejection waterfall.

A missing key and a null differ: `record` is a VARIANT, whose `variant_get` is null for a missing key only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import messages as M

#: Fixed values.
TRUE_TEXTS = ("true", "1", "yes", "resolved", "submitted")
DONE = ("submitted", "resolved", "success", "finished")

CONTAINERS = ("messages", "conversation", "trajectory", "info.messages", "trajectory.messages")


def _get(path: str, of: str = "record") -> str:
    return f"try_variant_get({of}, '$.{path}', 'variant')"


def _kind(v: str) -> str:
    return f"substring_index(substring_index(schema_of_variant({v}), '<', 1), '(', 1)"


def facts(rows: DataFrame, *paths: str) -> DataFrame:
    """Adds for each path of `record` its JSON type (`_k_...`, null if missing), whether its value counts as true
    (`_t_...`: not null, false, 0, '', [] or {}; null if missing) and its text (`_s_...`).

    Each path is read once; what is made of it are plain columns, which keeps the generated code small.
    """
    rows = rows.selectExpr("*", *(f"{_get(p)} AS {_name('v', p)}" for p in paths))
    rows = rows.selectExpr("*", *(f"{_kind(_name('v', p))} AS {_name('k', p)}" for p in paths))
    texts = (f"CASE WHEN {_name('k', p)} = 'STRING' THEN try_variant_get({_name('v', p)}, '$', 'string') WHEN {_name('k', p)} <> 'VOID' THEN to_json({_name('v', p)}) END AS {_name('s', p)}" for p in paths)
    rows = rows.selectExpr("*", *texts)
    truths = (
        f"CASE WHEN {_name('k', p)} IS NULL THEN NULL WHEN {_name('k', p)} = 'VOID' THEN false WHEN {_name('k', p)} = 'BOOLEAN' THEN {_name('s', p)} = 'true' "
        f"WHEN {_name('k', p)} IN ('STRING', 'ARRAY', 'OBJECT') THEN {_name('s', p)} NOT IN ('', '[]', '{{}}') OR ({_name('k', p)} = 'STRING' AND {_name('s', p)} <> '') "
        f"ELSE try_cast({_name('s', p)} AS double) <> 0 END AS {_name('t', p)}"
        for p in paths
    )
    return rows.selectExpr("*", *truths).drop(*(_name("v", p) for p in paths))


def _name(part: str, path: str) -> str:
    return f"_{part}_{path.replace('.', '__')}"


def _drop_facts(rows: DataFrame) -> DataFrame:
    return rows.drop(*(c for c in rows.columns if c.startswith(("_k_", "_t_", "_s_"))))


def _first_true(*paths: str) -> str:
    """The text of the first of the paths that counts as true, in lower case; '' if none does."""
    return f"CASE {' '.join(f'WHEN {_name("t", p)} THEN lower({_name("s", p)})' for p in paths)} ELSE '' END"


def _flag(path: str) -> str:
    """A flag: texts must be one of TRUE_TEXTS, other values count by truth."""
    truths = ", ".join(f"'{x}'" for x in TRUE_TEXTS)
    return f"WHEN {_name('k', path)} IS NOT NULL THEN CASE WHEN {_name('k', path)} = 'STRING' THEN lower({_name('s', path)}) IN ({truths}) ELSE {_name('t', path)} END"


MODES = ("default_true", "default_false", "lenient", "plain")
_KEYS = ("resolved", "success", "is_resolved")
_PATHS = (*_KEYS, "info.resolved", "exit_status", "info.exit_status", "verifier_status", *(f"metadata.{k}" for k in _KEYS))


def _resolved(mode: str) -> Column:
    done, flags = ", ".join(f"'{x}'" for x in DONE), " ".join(_flag(k) for k in _KEYS)
    if mode in ("default_true", "default_false"):
        status, inner = _first_true("exit_status", "info.exit_status"), f"WHEN {_name('k', 'info.resolved')} IS NOT NULL THEN {_name('t', 'info.resolved')}"
        return F.expr(f"CASE {flags} {inner} WHEN {status} <> '' THEN {status} IN ({done}) ELSE {str(mode == 'default_true').lower()} END")
    if mode == "lenient":
        meta = " ".join(_flag(f"metadata.{k}") for k in _KEYS)
        return F.expr(f"CASE {flags} WHEN {_first_true('exit_status', 'verifier_status')} IN ({done}, 'completed') THEN true {meta} ELSE true END")
    if mode == "plain":
        return F.expr("CASE " + " ".join(f"WHEN {_name('k', k)} IS NOT NULL THEN {_name('t', k)}" for k in ("resolved", "success")) + " ELSE true END")
    raise ValueError(f"unknown mode {mode}")


def with_resolved(rows: DataFrame, *modes: str) -> DataFrame:
    """Adds for each mode, under its name, whether a record counts as resolved.

    `default_true` and `default_false`: first flag present in the record, then `info.resolved` by truth, then the exit
    status; the mode says what holds without any. `lenient`: flags of the record, a good status of it, the flags of
    `metadata`, else true. `plain`: `resolved` or `success` by truth, so any text but '' is true, else true.
    """
    return _drop_facts(facts(rows, *_PATHS).withColumns({m: _resolved(m) for m in modes}))


def _as_list(path: str, encoded: bool) -> str:
    """A list that is not empty, given as such or (if `encoded`) as JSON in a string."""
    v = _get(path)
    plain = f"CASE WHEN {_kind(v)} = 'ARRAY' THEN try_variant_get({v}, '$', 'array<variant>') END"
    if encoded:
        text = f"try_parse_json(try_variant_get({v}, '$', 'string'))"
        plain = f"coalesce({plain}, CASE WHEN {_kind(v)} = 'STRING' AND {_kind(text)} = 'ARRAY' THEN try_variant_get({text}, '$', 'array<variant>') END)"
    return f"get(filter(array({plain}), x -> size(x) > 0), 0)"


def message_list(paths: tuple[str, ...] = CONTAINERS, encoded: bool = True) -> Column:
    """The first non-empty message list of the paths, as ARRAY<VARIANT>; null if there is none."""
    return F.expr(f"coalesce({', '.join(_as_list(p, encoded) for p in paths)})")


def container(paths: tuple[str, ...] = CONTAINERS, encoded: bool = True) -> Column:
    """The path at which `message_list` finds it."""
    return F.expr(f"CASE {' '.join(f'''WHEN {_as_list(p, encoded)} IS NOT NULL THEN '{p}' ''' for p in paths)} END")


def with_instance_id(rows: DataFrame, name: str = "instance_id") -> DataFrame:
    """Adds `instance_id`, `id`, `metadata.instance_id`, then `metadata.sample_id` from behind its first `::`; '' and
    other values that count as false are passed over."""
    paths = ("instance_id", "id", "metadata.instance_id", "metadata.sample_id")
    *plain, sample = (f"CASE WHEN {_name('t', p)} THEN {_name('s', p)} END" for p in paths)
    cut = f"CASE WHEN instr({sample}, '::') > 0 THEN substr({sample}, instr({sample}, '::') + 2) ELSE {sample} END"
    return _drop_facts(facts(rows, *paths).withColumn(name, F.expr(f"coalesce({', '.join(plain)}, {cut})")))


def completion_text(value: str = "completion") -> Column:
    """Of a VARIANT completion: the content of its first chat message, else the value as text."""
    chat = f"CASE WHEN {_kind(value)} = 'ARRAY' THEN try_variant_get({value}, '$[0].content', 'string') END"
    return F.expr(f"coalesce({chat}, CASE WHEN {_kind(value)} = 'STRING' THEN try_variant_get({value}, '$', 'string') ELSE to_json({value}) END)")


def difficulty() -> Column:
    """First of `difficulty`, `difficulty_score`, `score` that is not null, then `metadata.difficulty`; as DOUBLE."""
    value = lambda p: f"coalesce(try_variant_get(record, '$.{p}', 'double'), try_cast(try_variant_get(record, '$.{p}', 'string') AS double))"
    return F.expr(f"coalesce({', '.join(value(p) for p in ('difficulty', 'difficulty_score', 'score', 'metadata.difficulty'))})")


def in_range(value: Column, low: float, high: float) -> Column:
    """Within the closed range; unknown passes."""
    return value.isNull() | value.between(low, high)


def resolved_or_listed(rows: DataFrame, listed: DataFrame, predicate: Column, key: str = "instance_id") -> DataFrame:
    """Rows whose id is among the listed, or that meet the predicate."""
    ids = listed.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_listed", F.lit(True))
    return rows.join(ids, key, "left").where(F.coalesce("_listed", F.lit(False)) | predicate).drop("_listed")


def waterfall(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that rejects, else null. Null conditions don't reject."""
    first, *rest = rules
    out = F.when(first[1], first[0])
    for name, condition in rest:
        out = out.when(condition, name)
    return out


def text_action_reason(resolved_flag: Column, messages: Column, key: Column, max_chars: int = 120_000) -> Column:
    return waterfall([
        ("unresolved", ~resolved_flag), ("no_messages", F.coalesce(F.size(messages), F.lit(0)) <= 0), ("no_instance_id", F.coalesce(key, F.lit("")) == ""),
        ("not_text_action_format", ~M.looks_text_action(messages)), ("too_long", M.chars(messages) > max_chars),
    ])


def native_reason(resolved_flag: Column, messages: Column, key: Column, max_chars: int = 0, max_tokens: int = 200_000) -> Column:
    """Limits of 0 are off."""
    size = M.chars(messages)
    return waterfall([
        ("unresolved", ~resolved_flag), ("no_messages", F.coalesce(F.size(messages), F.lit(0)) <= 0), ("no_instance_id", F.coalesce(key, F.lit("")) == ""),
        ("invalid_native_tool", M.native_reject_reason(messages).isNotNull()),
        *([("too_long", size > max_chars)] if max_chars > 0 else []), *([("too_many_tokens", M.estimated_tokens(size) > max_tokens)] if max_tokens > 0 else []),
    ])


def reject_counts(rows: DataFrame, reason: str = "reason", detail: str | None = None) -> DataFrame:
    """(reason, detail, rows): how many rows each rule rejected; null reason: kept."""
    return rows.groupBy(F.col(reason).alias("reason"), (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail")).agg(F.count("*").alias("rows"))

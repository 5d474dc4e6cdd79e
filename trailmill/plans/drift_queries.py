"""Queries over raw records whose schema drifts (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import drift
from ..session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "raw_records"))


def p1_union_schema(spark: SparkSession, sf: str) -> DataFrame:
    return drift.union_schema(table(spark, sf, "raw_records"))


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unify(table(spark, sf, "raw_records"))


def p1_branches(spark: SparkSession, sf: str) -> DataFrame:
    rows = drift.branches(table(spark, sf, "raw_records"))
    return rows.select("file_id", "line_no", "field", "kind", "as_string", F.round("as_number", 6).alias("as_number"), F.col("as_boolean").cast("string").alias("as_boolean"), F.col("as_json").isNotNull().alias("is_nested"))


def p1_appearances(spark: SparkSession, sf: str) -> DataFrame:
    return drift.appearances(table(spark, sf, "raw_records"))


def p1_fused(spark: SparkSession, sf: str) -> DataFrame:
    return drift.fuse(table(spark, sf, "raw_records"))


def p1_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """What the canonical columns and branches of `p1_records` hold, without the long texts."""
    rows = drift.unify(table(spark, sf, "raw_records"))
    m = lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit("|"), F.coalesce(x["tool_call_id"], F.lit("")), F.lit("|"), F.coalesce(x["name"], F.lit("")))
    return rows.select(
        "file_id", "line_no", "instance_id", "instance_id_kind", "messages_kind", F.when(F.col("messages").isNotNull(), F.size("messages")).alias("n_messages"), F.md5(F.array_join(F.transform("messages", m), "\n")).alias("digest"),
        F.col("resolved").cast("string").alias("resolved"), "resolved_kind", F.col("resolved_boolean").cast("string").alias("resolved_boolean"), "resolved_number", "resolved_string", "exit_status", "exit_status_kind", "exit_status_string", "exit_status_number",
    )


QUERIES = {
    "p1_found": p1_found, "p1_union_schema": p1_union_schema, "p1_records": p1_records, "p1_branches": p1_branches, "p1_appearances": p1_appearances,
    "p1_fused": p1_fused, "p1_canonical": p1_canonical,
}

_OPENED = ", ".join(f"'{x}'" for x in drift.OPENED)


def _type(v: str) -> str:
    return f"CASE json_type({v}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"


_FIELDS = f"""recs AS (SELECT file_id, run_id, file_seq, raw::JSON AS j FROM raw_records WHERE json_valid(raw) AND json_type(raw::JSON) = 'OBJECT'),
    tops AS (SELECT file_id, run_id, file_seq, k, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM recs)),
    inners AS (SELECT file_id, run_id, file_seq, k || '.' || q AS field, json_extract(v, '$."' || q || '"') AS v FROM (SELECT *, unnest(json_keys(v)) AS q FROM tops WHERE k IN ({_OPENED}) AND json_type(v) = 'OBJECT')),
    fields AS (SELECT file_id, run_id, file_seq, field, {_type('v')} AS kind FROM (SELECT file_id, run_id, file_seq, k AS field, v FROM tops WHERE NOT (k IN ({_OPENED}) AND json_type(v) = 'OBJECT') UNION ALL SELECT * FROM inners))"""

_LINES = _FIELDS.replace("file_id, run_id, file_seq", "file_id, run_id, file_seq, line_no").replace(f"{_type('v')} AS kind", f"{_type('v')} AS kind, v")


def _first(paths: tuple[str, ...]) -> str:
    """SQL: the first path that holds something; `trajectory` may be an object of other paths, which does not count."""
    ordered = [p for p in paths if p != "trajectory"] + [p for p in paths if p == "trajectory"]
    holds = lambda p: f"json_type({_x(p)}) IN ('ARRAY', 'VARCHAR')" if p == "trajectory" else f"json_type({_x(p)}) <> 'NULL'"
    return f"CASE {' '.join(f'WHEN {holds(p)} THEN {_x(p)}' for p in ordered)} END"


def _x(p: str) -> str:
    return f"json_extract(j, '$.{p}')"


_TRUTHS = ", ".join(f"'{x}'" for x in drift.TRUE_TEXTS)
_CANONICAL = f"""WITH recs AS (SELECT file_id, line_no, raw::JSON AS j FROM raw_records WHERE json_valid(raw) AND json_type(raw::JSON) = 'OBJECT'),
    picked AS (SELECT file_id, line_no, {_first(drift.SYNONYMS['messages'])} AS m, {_first(drift.SYNONYMS['resolved'])} AS r, {_first(drift.SYNONYMS['exit_status'])} AS e, {_first(drift.SYNONYMS['instance_id'])} AS i FROM recs),
    kinds AS (SELECT *, CASE WHEN m IS NOT NULL THEN {_type('m')} END AS messages_kind, CASE WHEN r IS NOT NULL THEN {_type('r')} END AS resolved_kind, CASE WHEN e IS NOT NULL THEN {_type('e')} END AS exit_status_kind, CASE WHEN i IS NOT NULL THEN {_type('i')} END AS instance_id_kind FROM picked),
    lists AS (SELECT *, CASE WHEN messages_kind = 'array' THEN m WHEN messages_kind = 'string' AND json_valid(m->>'$') THEN CASE WHEN json_type((m->>'$')::JSON) = 'ARRAY' THEN (m->>'$')::JSON END END AS listed,
        CASE WHEN resolved_kind = 'boolean' THEN r::BOOLEAN END AS resolved_boolean, CASE WHEN resolved_kind = 'number' THEN r::DOUBLE END AS resolved_number, CASE WHEN resolved_kind = 'string' THEN r->>'$' END AS resolved_string,
        CASE WHEN exit_status_kind = 'string' THEN e->>'$' END AS exit_status_string, CASE WHEN exit_status_kind = 'number' THEN e::DOUBLE END AS exit_status_number FROM kinds)
    SELECT file_id, line_no, CASE WHEN i IS NOT NULL THEN i->>'$' END AS instance_id, instance_id_kind, messages_kind, json_array_length(listed)::INT AS n_messages,
        CASE WHEN listed IS NOT NULL THEN md5(array_to_string(list_transform(listed::JSON[], lambda x: coalesce(x->>'role', '') || '|' || coalesce(x->>'tool_call_id', '') || '|' || coalesce(x->>'name', '')), chr(10))) END AS digest,
        coalesce(resolved_boolean, resolved_number <> 0, lower(trim(resolved_string)) IN ({_TRUTHS}))::VARCHAR AS resolved, resolved_kind, resolved_boolean::VARCHAR AS resolved_boolean, resolved_number, resolved_string,
        coalesce(exit_status_string, CASE WHEN exit_status_number = floor(exit_status_number) THEN exit_status_number::BIGINT::VARCHAR ELSE exit_status_number::VARCHAR END, CASE WHEN exit_status_kind = 'object' THEN e->>'reason' END) AS exit_status,
        exit_status_kind, exit_status_string, exit_status_number FROM lists"""

_MEANING = "CASE " + " ".join(f"WHEN field IN {members} THEN '@{name}'" for name, members in drift.SYNONYMS.items()) + " ELSE field END"

SQL: dict[str, str] = {
    "p1_canonical": _CANONICAL,
    "p1_branches": f"""WITH {_LINES} SELECT file_id, line_no, field, kind, CASE WHEN kind = 'string' THEN v->>'$' END AS as_string, CASE WHEN kind = 'number' THEN round(v::DOUBLE, 6) END AS as_number,
        CASE WHEN kind = 'boolean' THEN v::BOOLEAN::VARCHAR END AS as_boolean, coalesce(kind IN ('array', 'object'), false) AS is_nested FROM fields""",
    "p1_appearances": f"""WITH {_FIELDS} SELECT run_id, field, coalesce(kind, 'null') AS kind, min(file_seq) AS first_seq, count(DISTINCT file_id) AS files, count(*) AS records FROM fields GROUP BY ALL""",
    "p1_union_schema": f"""WITH {_FIELDS}, per AS (SELECT file_id, run_id, file_seq, field, coalesce(kind, 'null') AS kind, count(*) AS n FROM fields GROUP BY ALL)
        SELECT field, kind, sum(n)::BIGINT AS records, count(*) AS files, arg_min(file_id, (run_id, file_seq, file_id)) AS first_file FROM per GROUP BY ALL""",
    "p1_found": f"""WITH {_FIELDS}, counted AS (SELECT file_id, run_id, file_seq, field, kind, count(*) AS n FROM fields GROUP BY ALL),
        schemas AS (SELECT file_id, run_id, file_seq, field, arg_max(kind, (n, -ascii(kind), -ascii(substr(kind, 2, 1)))) FILTER (kind IS NOT NULL) AS kind FROM counted GROUP BY ALL),
        files AS (SELECT DISTINCT file_id, run_id, file_seq FROM raw_records WHERE file_id IS NOT NULL AND run_id IS NOT NULL AND file_seq IS NOT NULL),
        followed AS (SELECT b.file_id, a.file_id AS before_id FROM files b JOIN files a ON a.run_id = b.run_id AND a.file_seq = b.file_seq - 1),
        now AS (SELECT f.file_id, s.field, s.kind FROM followed f JOIN schemas s ON s.file_id = f.file_id), old AS (SELECT f.file_id, s.field, s.kind FROM followed f JOIN schemas s ON s.file_id = f.before_id),
        went AS (SELECT *, {_MEANING} AS meaning FROM old ANTI JOIN now USING (file_id, field)), came AS (SELECT *, {_MEANING} AS meaning FROM now ANTI JOIN old USING (file_id, field)),
        w AS (SELECT file_id, meaning, count(*) AS n, min(field) AS field, min(kind) AS kind FROM went GROUP BY ALL), c AS (SELECT file_id, meaning, count(*) AS n, min(field) AS field, min(kind) AS kind FROM came GROUP BY ALL),
        renamed AS (SELECT file_id, meaning, w.field AS old_field, c.field AS new_field, w.kind <> c.kind AS retyped FROM w JOIN c USING (file_id, meaning) WHERE w.n = 1 AND c.n = 1 AND starts_with(meaning, '@'))
        SELECT file_id, 'retyped' AS change_kind, field AS old_field, field AS new_field FROM now JOIN old USING (file_id, field) WHERE now.kind <> old.kind
        UNION ALL SELECT file_id, 'renamed', old_field, new_field FROM renamed UNION ALL SELECT file_id, 'retyped', old_field, new_field FROM renamed WHERE retyped
        UNION ALL SELECT file_id, 'removed', field, '' FROM went ANTI JOIN renamed USING (file_id, meaning) UNION ALL SELECT file_id, 'added', '', field FROM came ANTI JOIN renamed USING (file_id, meaning)""",
}

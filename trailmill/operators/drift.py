"""Schemas that drift between files: tagged-union inference over JSON records.

Each line is parsed once into a VARIANT. Parallel schemas are fused per path into a union that keeps every JSON type
seen there (`union_schema`); conflicts are split into one typed branch per alternative beside a canonical column
(`unify`); and consecutive files of a run are compared (`changes`).

Defined cases: blank, broken and null lines, and JSON that is no object, are unreadable: they give no record and no
field. A record with a repeated key is unreadable. Fields with only nulls exist but have no type, so they are never
`retyped`. Of types equally frequent the first in the order of their names counts. A file whose predecessor is not there
is compared with nothing. Rows without run or sequence number take no part in comparisons. Repeated lines are records.
Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPENED = ("info", "metadata", "trajectory")

#: Fields that mean the same thing under different names.
SYNONYMS = {
    "messages": ("messages", "conversation", "trajectory", "info.messages", "trajectory.messages"),
    "resolved": ("resolved", "success", "is_resolved", "info.resolved", "metadata.resolved"),
    "exit_status": ("exit_status", "info.exit_status", "metadata.exit_status"),
    "instance_id": ("instance_id", "id", "metadata.instance_id"),
}

#: Texts that stand for true.
TRUE_TEXTS = ("true", "1", "yes", "resolved", "submitted")

_KIND = """CASE split_part(split_part(schema_of_variant({0}), '<', 1), '(', 1)
    WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'VOID' THEN NULL ELSE CASE WHEN {0} IS NOT NULL THEN 'number' END END"""


def parse(lines: DataFrame) -> DataFrame:
    """Adds `record`, the VARIANT of a readable line, else null."""
    return lines.withColumn("record", F.expr("try_parse_json(raw)"))


_ROW = ("file_id", "run_id", "file_seq")


def _fields(lines: DataFrame, kept: tuple[str, ...], values: bool) -> DataFrame:
    """(kept columns, field, kind) of every field of every record, with its `value` if asked for; a line without a record
    or a record without a field has one row of nulls. Both levels come from one parse."""
    opened = ", ".join(f"'{x}'" for x in OPENED)
    tvf = lines.sparkSession.tvf
    top = (
        parse(lines.select(*kept, "raw"))
        .lateralJoin(tvf.variant_explode_outer(F.col("record").outer()).select("key", "value"), how="left")
        .selectExpr(*kept, "key", "value", _KIND.format("value") + " AS kind")
        .selectExpr("*", f"key IN ({opened}) AND kind <=> 'object' AS opened")
        .selectExpr(*kept, "key", "kind", "opened", "CASE WHEN opened THEN value END AS body", *(["CASE WHEN NOT opened THEN value END AS value"] if values else []))
    )
    inner = tvf.variant_explode_outer(F.col("body").outer()).selectExpr("key AS key2", "value AS value2")
    return top.lateralJoin(inner, how="left").selectExpr(
        *kept,
        "CASE WHEN opened THEN key || '.' || key2 ELSE key END AS field",
        f"CASE WHEN opened THEN {_KIND.format('value2')} ELSE kind END AS kind",
        *(["CASE WHEN opened THEN value2 ELSE value END AS value"] if values else []),
    )


def field_kinds(lines: DataFrame) -> DataFrame:
    """(file_id, run_id, file_seq, field, kind, n): how often each file has each field with each JSON type."""
    return _fields(lines, _ROW, False).groupBy(*_ROW, "field", "kind").agg(F.count("*").alias("n"))


def branches(lines: DataFrame) -> DataFrame:
    """(file_id, run_id, file_seq, line_no, field, kind, as_string, as_number, as_boolean, as_json): every field of every
    record in the typed branch of its JSON type; lists and objects are JSON texts; nulls have no kind and no branch."""
    branch = lambda kind, value: f"CASE WHEN kind = '{kind}' THEN try_variant_get(value, '$', '{value}') END AS as_{kind}"
    return (
        _fields(lines, (*_ROW, "line_no"), True)
        .where("field IS NOT NULL")
        .selectExpr(
            *_ROW, "line_no", "field", "kind", branch("string", "string"), branch("number", "double"), branch("boolean", "boolean"),
            "CASE WHEN kind IN ('array', 'object') THEN to_json(value) END AS as_json",
        )
    )


def appearances(lines: DataFrame) -> DataFrame:
    """(run_id, field, kind, first_seq, files, records): where in each run an alternative of a field appears first, and
    how much it is used there. `kind` is 'null' for nulls."""
    return (
        field_kinds(lines)
        .where("field IS NOT NULL")
        .groupBy("run_id", "field", F.coalesce("kind", F.lit("null")).alias("kind"))
        .agg(F.min("file_seq").alias("first_seq"), F.count_distinct("file_id").alias("files"), F.sum("n").alias("records"))
    )


def fuse(lines: DataFrame, union: DataFrame | None = None) -> DataFrame:
    """One row per readable record with a column for every path of the fused schema, in order of their names (`__` for
    the dot): a STRUCT of its kind and a typed branch for each alternative that occurs anywhere. `union` (of `union_schema`) is read by the
    driver; it has one row for each path and type, whatever the number of records."""
    kinds: dict[str, set[str]] = {}
    for r in (union if union is not None else union_schema(lines)).select("field", "kind").collect():
        kinds.setdefault(r.field, set()).add(r.kind)
    typed = {"string": "string", "number": "double", "boolean": "boolean"}
    records = parse(lines.select(*_ROW, "line_no", "raw")).where(_READABLE)
    records = records.selectExpr("*", "try_variant_get(record, '$', 'map<string,variant>') AS _keys")
    opened = (f"CASE WHEN {_KIND.format(f"_keys['{x}']")} = 'object' THEN try_variant_get(_keys['{x}'], '$', 'map<string,variant>') END AS _keys_{x}" for x in OPENED)
    records = records.selectExpr("*", *opened).select("*", *(_at(f).alias(f"v{i}") for i, f in enumerate(sorted(kinds))))

    def column(i: int, field: str) -> str:
        v = f"v{i}"
        parts = [f"'kind', {_KIND.format(v)}"]
        for kind in sorted(kinds[field] - {"null"}):
            if kind in typed:
                parts.append(f"'as_{kind}', CASE WHEN {_KIND.format(v)} = '{kind}' THEN try_variant_get({v}, '$', '{typed[kind]}') END")
        if kinds[field] & {"array", "object"}:
            parts.append(f"'as_json', CASE WHEN {_KIND.format(v)} IN ('array', 'object') THEN to_json({v}) END")
        # A dot would be read as a step into a struct; names that fall together, also by letter case, get a mark more.
        name = field.replace(".", "__")
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        return f"named_struct({', '.join(parts)}) AS `{name.replace('`', '``')}`"

    used = {*_ROW, "line_no"}
    return records.selectExpr(*_ROW, "line_no", *(column(i, f) for i, f in enumerate(sorted(kinds))))


_READABLE = "record IS NOT NULL AND startswith(schema_of_variant(record), 'OBJECT')"


def _at(field: str) -> Column:
    """The value of a path of the fused schema: a key of the record (`_keys`), or of an object that is opened
    (`_keys_...`). Keys are looked up in maps, as paths of a VARIANT can't hold every sign."""
    outer, _, inner = field.partition(".")
    if inner and outer in OPENED:
        # A key that has the dot itself comes under the same name.
        return F.coalesce(F.col(f"_keys_{outer}")[F.lit(inner)], F.col("_keys")[F.lit(field)])
    value = F.col("_keys")[F.lit(field)]
    return F.when(F.col(f"_keys_{outer}").isNull(), value) if field in OPENED else value


def file_schemas(kinds: DataFrame) -> DataFrame:
    """(file_id, run_id, file_seq, field, kind): one row per file and field; a file without any has one with null."""
    best = F.max_by(F.col("kind"), F.struct(F.col("n"), -F.ascii("kind"), -F.ascii(F.substring("kind", 2, 1))))
    return (
        kinds.withColumn("n", F.when(F.col("kind").isNotNull(), F.col("n")))
        .groupBy("file_id", "run_id", "file_seq", "field")
        .agg(best.alias("kind"))
    )


def changes(lines: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_field, new_field): what each file changes against the one before it in its run."""
    schemas = file_schemas(field_kinds(lines)).where("run_id IS NOT NULL AND file_seq IS NOT NULL AND file_id IS NOT NULL")
    # Every schema row is sent to its own file and to the next one, so one pass over the lines serves both sides.
    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    both = schemas.select("*", sides).select(
        "run_id", (F.col("file_seq") + F.col("side")).alias("file_seq"), "field", "side", "kind",
        F.when(F.col("side") == 0, F.col("file_id")).alias("file_id"),
    )
    here = Window.partitionBy("run_id", "file_seq")
    pairs = (
        both.groupBy("run_id", "file_seq", "field")
        .agg(
            F.max("file_id").alias("file_id"), F.max(F.col("side") == 0).alias("is_now"), F.max(F.col("side") == 1).alias("was_before"),
            F.max(F.when(F.col("side") == 0, F.col("kind"))).alias("new_kind"), F.max(F.when(F.col("side") == 1, F.col("kind"))).alias("old_kind"),
        )
        .withColumns({"file_id": F.max("file_id").over(here), "has_before": F.max("was_before").over(here)})
        .where("file_id IS NOT NULL AND has_before AND field IS NOT NULL")
        .where("NOT (is_now AND was_before AND NOT coalesce(new_kind <> old_kind, false))")
    )
    names = F.create_map(*[F.lit(x) for group, members in SYNONYMS.items() for m in members for x in (m, f"@{group}")])
    cases = (
        pairs.withColumn("meaning", F.coalesce(names[F.col("field")], F.col("field")))
        .groupBy("file_id", "meaning")
        .agg(
            F.collect_list(F.when(~F.col("is_now"), F.struct("field", "old_kind"))).alias("went"),
            F.collect_list(F.when(~F.col("was_before"), F.struct("field", "new_kind"))).alias("came"),
            F.collect_list(F.when(F.col("is_now") & F.col("was_before"), F.col("field"))).alias("kept"),
        )
    )
    rows = F.expr("""flatten(array(
        transform(kept, f -> named_struct('change_kind', 'retyped', 'old_field', f, 'new_field', f)),
        CASE WHEN size(went) = 1 AND size(came) = 1 AND startswith(meaning, '@') THEN
            filter(array(
                named_struct('change_kind', 'renamed', 'old_field', went[0].field, 'new_field', came[0].field),
                CASE WHEN went[0].old_kind <> came[0].new_kind THEN
                    named_struct('change_kind', 'retyped', 'old_field', went[0].field, 'new_field', came[0].field) END
            ), x -> x IS NOT NULL)
        ELSE concat(
            transform(went, f -> named_struct('change_kind', 'removed', 'old_field', f.field, 'new_field', '')),
            transform(came, f -> named_struct('change_kind', 'added', 'old_field', '', 'new_field', f.field)))
        END))""")
    return cases.select("file_id", F.inline(rows))


def union_schema(lines: DataFrame) -> DataFrame:
    """(field, kind, records, files, first_file): the fused schema: every alternative type of every path, how much it
    is used, and the first file (by run and sequence) in which that alternative appears. `kind` is 'null' for nulls."""
    where = F.struct("run_id", "file_seq", "file_id")
    return (
        field_kinds(lines)
        .where("field IS NOT NULL")
        .groupBy("field", F.coalesce("kind", F.lit("null")).alias("kind"))
        .agg(
            F.sum("n").alias("records"),
            F.count("*").alias("files"),
            F.min(where).getField("file_id").alias("first_file"),
        )
    )


def _pick(paths: tuple[str, ...]) -> str:
    """The first path of the record that holds something, as VARIANT."""
    parts = []
    for p in paths:
        v = f"try_variant_get(record, '$.{p}', 'variant')"
        guard = f"{_KIND.format(v)} IN ('array', 'string')" if p == "trajectory" else f"NOT is_variant_null({v})"
        parts.append(f"CASE WHEN {guard} THEN {v} END")
    return f"coalesce({', '.join(parts)})"


def _text(v: str) -> str:
    """A string as it is, anything else as its JSON."""
    return f"coalesce(CASE WHEN {_KIND.format(v)} = 'string' THEN try_variant_get({v}, '$', 'string') END, CASE WHEN NOT is_variant_null({v}) THEN to_json({v}) END)"


def typed_messages(listed: str) -> str:
    """SQL: an ARRAY<VARIANT> of messages with fixed fields. Of content parts the texts (bare strings, and parts of type
    `text`) are joined, others (images and unknown ones) are left out; call arguments become text."""
    content = f"""CASE WHEN {_KIND.format("try_variant_get(x, '$.content', 'variant')")} = 'array' THEN
        array_join(transform(try_variant_get(x, '$.content', 'array<variant>'),
            p -> coalesce(CASE WHEN {_KIND.format("p")} = 'string' THEN try_variant_get(p, '$', 'string')
                WHEN try_variant_get(p, '$.type', 'string') = 'text' THEN try_variant_get(p, '$.text', 'string') END, '')), '')
        ELSE {_text("try_variant_get(x, '$.content', 'variant')")} END"""
    arguments = _text("try_variant_get(c, '$.function.arguments', 'variant')")
    return f"""transform({listed}, x -> named_struct('role', try_variant_get(x, '$.role', 'string'), 'content', {content},
        'tool_calls', transform(try_variant_get(x, '$.tool_calls', 'array<variant>'), c -> named_struct(
            'id', try_variant_get(c, '$.id', 'string'), 'type', try_variant_get(c, '$.type', 'string'),
            'function', named_struct('name', try_variant_get(c, '$.function.name', 'string'), 'arguments', {arguments}))),
        'tool_call_id', try_variant_get(x, '$.tool_call_id', 'string'), 'name', try_variant_get(x, '$.name', 'string')))"""


def unify(lines: DataFrame) -> DataFrame:
    """One row per readable record in fixed columns.

    `messages`, `resolved`, `exit_status`, `instance_id` are canonical; beside each stand its tag (the JSON type found)
    and a typed branch per alternative (that of a list of messages is `messages` itself). A list of messages may be
    encoded in a string; content parts are joined; an object-valued exit status gives its `reason`; `resolved` is true
    for true, a number other than 0, or one of TRUE_TEXTS. What cannot be converted is null in the canonical column and
    stays in its branch: texts, numbers and booleans as such, other values as JSON in `..._object`. The other fields of
    a record are in `record_json`, and typed in `branches` and `fuse`.
    """
    holders = tuple(p for p in SYNONYMS["messages"] if p != "trajectory") + ("trajectory",)
    parsed = parse(lines.select("file_id", "run_id", "file_seq", "line_no", "raw")).where(_READABLE)
    kept = parsed.selectExpr(
        "file_id", "run_id", "file_seq", "line_no", "record",
        f"{_pick(holders)} AS m", f"{_pick(SYNONYMS['resolved'])} AS r", f"{_pick(SYNONYMS['exit_status'])} AS e",
        f"{_pick(SYNONYMS['instance_id'])} AS i",
    ).selectExpr("*", *(f"{_KIND.format(c)} AS {n}_kind" for c, n in (("m", "messages"), ("r", "resolved"), ("e", "exit_status"), ("i", "instance_id"))))
    branched = kept.selectExpr(
        "*",
        "CASE WHEN messages_kind = 'array' THEN try_variant_get(m, '$', 'array<variant>') END AS messages_array",
        "CASE WHEN messages_kind = 'string' THEN try_variant_get(m, '$', 'string') END AS messages_string",
        "CASE WHEN resolved_kind = 'boolean' THEN try_variant_get(r, '$', 'boolean') END AS resolved_boolean",
        "CASE WHEN resolved_kind = 'number' THEN try_variant_get(r, '$', 'double') END AS resolved_number",
        "CASE WHEN resolved_kind = 'string' THEN try_variant_get(r, '$', 'string') END AS resolved_string",
        "CASE WHEN exit_status_kind = 'string' THEN try_variant_get(e, '$', 'string') END AS exit_status_string",
        "CASE WHEN exit_status_kind = 'number' THEN try_variant_get(e, '$', 'double') END AS exit_status_number",
        "CASE WHEN exit_status_kind = 'boolean' THEN try_variant_get(e, '$', 'boolean') END AS exit_status_boolean",
        "CASE WHEN exit_status_kind IN ('object', 'array') THEN to_json(e) END AS exit_status_object",
        "CASE WHEN resolved_kind IN ('object', 'array') THEN to_json(r) END AS resolved_object",
        "CASE WHEN messages_kind <> 'array' AND messages_kind <> 'string' THEN to_json(m) END AS messages_object",
        "CASE WHEN instance_id_kind = 'string' THEN try_variant_get(i, '$', 'string') END AS instance_id_string",
        "CASE WHEN instance_id_kind <> 'string' THEN to_json(i) END AS instance_id_object",
    )
    listed = "coalesce(messages_array, try_variant_get(try_parse_json(messages_string), '$', 'array<variant>'))"
    truths = ", ".join(f"'{x}'" for x in TRUE_TEXTS)
    return branched.selectExpr("*", f"{listed} AS listed").selectExpr(
        "file_id", "run_id", "file_seq", "line_no",
        "coalesce(instance_id_string, instance_id_object) AS instance_id", "instance_id_kind", "instance_id_string", "instance_id_object",
        f"{typed_messages('listed')} AS messages", "messages_kind", "messages_string", "messages_object",
        f"coalesce(resolved_boolean, resolved_number <> 0, lower(trim(resolved_string)) IN ({truths})) AS resolved",
        "resolved_kind", "resolved_boolean", "resolved_number", "resolved_string", "resolved_object",
        "coalesce(exit_status_string, CASE WHEN exit_status_number = floor(exit_status_number) THEN cast(cast(exit_status_number AS bigint) AS string) ELSE cast(exit_status_number AS string) END, try_variant_get(e, '$.reason', 'string')) AS exit_status",
        "exit_status_kind", "exit_status_string", "exit_status_number", "exit_status_boolean", "exit_status_object",
        "to_json(record) AS record_json",
    )

"""Queries for the core operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import messages as M
from ..functions import text as X
from ..functions.instance_ids import repo_from_instance_id
from ..functions.tokenizers import VOCABULARY
from ..operators import context, joins, metrics, predicates as P, rewards, sampling
from ..operators.drift import parse
from ..session import scratch_path, table
from ..sources import cache, json_files as J
from ..streaming import rollout_queue as queue
from ..streaming.tables import run_append, run_complete, streamed
from . import pipelines

BUDGET = 20_000
MAJOR, MINOR, MIN_FRACTION = "swesmith", "swegym_openhands", 0.45
EXPERTS = ("swesmith", "swegym_openhands")
CAPS = [1024, 2048, 4096, 8192, 16384]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _js(s: str) -> str:
    """SQL: characters of a string as JSON."""
    short, long = r"[\"\\\n\r\t\x08\x0c]", r"[\x00-\x07\x0b\x0e-\x1f]"
    return f"coalesce(2 * length({s}) + 2 - length(regexp_replace({s}, '{short}', '', 'g')) + 5 * (length({s}) - length(regexp_replace({s}, '{long}', '', 'g'))), 4)"


_CALL = f"""{len('{"id": , "type": , "function": {"name": , "arguments": }}') + 2} + {_js('c.id')} + {_js('c."type"')} + {_js('c."function"."name"')} + {_js('c."function".arguments')}"""
_COST = f"coalesce(length(m.content), 0) + coalesce(list_sum(list_transform(m.tool_calls, lambda c: {_CALL})), 0)"
#: One row for each message, numbered from 1, with its cost.
_FLAT = f"flat AS (SELECT row_id, i, m, ({_COST})::BIGINT AS cost FROM (SELECT row_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM sft_merged))"
_SIZED = """sized AS (SELECT s.row_id, coalesce(len(s.messages), 0)::INT AS n_messages, coalesce(t.chars, 0)::BIGINT AS chars, floor(coalesce(t.chars, 0) / 3.2::DOUBLE)::BIGINT AS tokens
    FROM sft_merged s LEFT JOIN (SELECT row_id, sum(cost) AS chars FROM flat GROUP BY row_id) t USING (row_id))"""
_SIZES = f"{_FLAT}, {_SIZED}"
_HAS = "coalesce(len(m.tool_calls), 0) > 0"
_NATIVE = f"""{_FLAT}, turns AS (SELECT row_id, i, m.role AS role, coalesce(m.content, '') AS content, {_HAS} AS calls, m FROM flat),
    firsts AS (SELECT *, min(CASE WHEN role = 'assistant' AND calls THEN i END) OVER (PARTITION BY row_id) AS first_call FROM turns),
    flags AS (SELECT row_id, bool_or(role = 'assistant' AND calls) AND NOT bool_or(role = 'assistant' AND NOT calls AND contains(content, 'THOUGHT:') AND contains(content, 'ACTION:'))
        AND NOT bool_or(role = 'user' AND contains(content, '<returncode>') AND (first_call IS NULL OR i < first_call)) AS native,
        bool_or((role = 'assistant' AND contains(content, 'THOUGHT:')) OR (role = 'user' AND contains(content, '<returncode>'))) AS text_action,
        arg_min(CASE WHEN role = 'assistant' THEN CASE WHEN NOT calls THEN 'assistant_missing_tool_calls' WHEN len(m.tool_calls) <> 1 THEN 'assistant_multiple_tool_calls'
            WHEN m.tool_calls[1]."function"."name" IS DISTINCT FROM 'bash' THEN 'unexpected_tool_name' WHEN m.tool_calls[1]."function".arguments IS NULL THEN 'invalid_tool_arguments' END END, i)
            FILTER (role = 'assistant' AND (NOT calls OR len(m.tool_calls) <> 1 OR m.tool_calls[1]."function"."name" IS DISTINCT FROM 'bash' OR m.tool_calls[1]."function".arguments IS NULL)) AS first_fault
        FROM firsts GROUP BY row_id),
    formats AS (SELECT s.row_id, coalesce(native, false) AS native, coalesce(text_action, false) AS text_action, CASE WHEN NOT coalesce(native, false) THEN 'not_native_tool_format' ELSE first_fault END AS reason
        FROM sft_merged s LEFT JOIN flags USING (row_id))"""


def _sft(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sft_merged")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sft(spark, sf).select("row_id", F.greatest(F.coalesce(F.size("messages"), F.lit(0)), F.lit(0)).alias("n_messages"), M.chars(F.col("messages")).alias("chars"))
    return rows.withColumn("tokens", M.estimated_tokens(F.col("chars")))


@query(f"WITH {_SIZES} SELECT * FROM sized")
def traj_message_stats(spark, sf):
    return _sized(spark, sf)


@query(f"WITH {_FLAT} SELECT coalesce(m.role, 'none') AS role, count(*) AS messages, sum(cost)::BIGINT AS chars FROM flat GROUP BY 1")
def role_counts(spark, sf):
    flat = _sft(spark, sf).select(F.explode("messages").alias("m"))
    return flat.groupBy(F.coalesce("m.role", F.lit("none")).alias("role")).agg(F.count("*").alias("messages"), F.sum(M.message_chars(F.col("m"))).alias("chars"))


@query(f"WITH {_NATIVE} SELECT * FROM formats")
def format_flags(spark, sf):
    m = F.col("messages")
    return _sft(spark, sf).select("row_id", M.looks_native(m).alias("native"), M.looks_text_action(m).alias("text_action"), M.native_reject_reason(m).alias("reason"))


_RESOLVED = "coalesce(s.metadata.resolved, true)"


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    rows = _sft(spark, sf)
    flag = F.coalesce("metadata.resolved", F.lit(True))
    native = P.native_reason(flag, F.col("messages"), F.col("instance_id"), 0, 5_000)
    text = P.text_action_reason(flag, F.col("messages"), F.col("instance_id"), 15_000)
    detail = F.when(native == "invalid_native_tool", M.native_reject_reason(F.col("messages")))
    return rows.select("row_id", native.alias("native"), detail.alias("detail"), text.alias("text"))


_REASONS = f"""WITH {_NATIVE}, {_SIZED}, reasons AS (SELECT s.row_id,
    CASE WHEN NOT {_RESOLVED} THEN 'unresolved' WHEN n_messages = 0 THEN 'no_messages' WHEN coalesce(s.instance_id, '') = '' THEN 'no_instance_id'
        WHEN f.reason IS NOT NULL THEN 'invalid_native_tool' WHEN tokens > 5000 THEN 'too_many_tokens' END AS native,
    CASE WHEN NOT {_RESOLVED} THEN 'unresolved' WHEN n_messages = 0 THEN 'no_messages' WHEN coalesce(s.instance_id, '') = '' THEN 'no_instance_id'
        WHEN NOT f.text_action THEN 'not_text_action_format' WHEN chars > 15000 THEN 'too_long' END AS text, f.reason AS fault
    FROM sft_merged s JOIN formats f USING (row_id) JOIN sized z USING (row_id))"""


@query(f"{_REASONS} SELECT native AS reason, CASE WHEN native = 'invalid_native_tool' THEN fault END AS detail, count(*) AS rows FROM reasons GROUP BY ALL")
def reject_waterfall_native(spark, sf):
    return P.reject_counts(_rejected(spark, sf), "native", "detail")


@query(f"{_REASONS} SELECT text AS reason, count(*) AS rows FROM reasons GROUP BY ALL")
def reject_waterfall_text(spark, sf):
    return P.reject_counts(_rejected(spark, sf), "text").select("reason", "rows")


# Raw records -----------------------------------------------------------------------------------------------------

_J = "raws AS (SELECT file_id, line_no, received_at, raw::JSON AS j FROM raw_records WHERE json_valid(raw) AND json_type(raw::JSON) = 'OBJECT')"


def _x(p: str) -> str:
    return f"json_extract(j, '$.{p}')"


def _true(p: str) -> str:
    v = _x(p)
    return f"""(CASE WHEN {v} IS NULL THEN false ELSE CASE json_type({v}) WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN json_extract_string(j, '$.{p}') = 'true' WHEN 'VARCHAR' THEN json_extract_string(j, '$.{p}') <> ''
        WHEN 'ARRAY' THEN json_array_length({v}) > 0 WHEN 'OBJECT' THEN len(json_keys({v})) > 0 ELSE json_extract_string(j, '$.{p}')::DOUBLE <> 0 END END)"""


def _flag(p: str) -> str:
    return f"WHEN {_x(p)} IS NOT NULL THEN CASE WHEN json_type({_x(p)}) = 'VARCHAR' THEN lower(json_extract_string(j, '$.{p}')) IN {P.TRUE_TEXTS} ELSE {_true(p)} END"


def _status(*ps: str) -> str:
    return "CASE " + " ".join(f"WHEN {_true(p)} THEN lower(json_extract_string(j, '$.{p}'))" for p in ps) + " ELSE '' END"


def _default(last: str) -> str:
    s = _status("exit_status", "info.exit_status")
    return f"CASE {_flag('resolved')} {_flag('success')} {_flag('is_resolved')} WHEN {_x('info.resolved')} IS NOT NULL THEN {_true('info.resolved')} WHEN {s} <> '' THEN {s} IN {P.DONE} ELSE {last} END"


_LENIENT = f"""CASE {_flag('resolved')} {_flag('success')} {_flag('is_resolved')} WHEN {_status('exit_status', 'verifier_status')} IN {(*P.DONE, 'completed')} THEN true
    {_flag('metadata.resolved')} {_flag('metadata.success')} {_flag('metadata.is_resolved')} ELSE true END"""
_PLAIN = f"CASE WHEN {_x('resolved')} IS NOT NULL THEN {_true('resolved')} WHEN {_x('success')} IS NOT NULL THEN {_true('success')} ELSE true END"


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return parse(table(spark, sf, "raw_records")).where("record IS NOT NULL AND schema_of_variant(record) LIKE 'OBJECT%'")


@query(f"WITH {_J} SELECT file_id, line_no, received_at, {_default('true')} AS default_true, {_default('false')} AS default_false, {_LENIENT} AS lenient, {_PLAIN} AS plain FROM raws")
def resolved_modes(spark, sf):
    return P.with_resolved(_raw(spark, sf), *P.MODES).select("file_id", "line_no", "received_at", *P.MODES)


def _list(p: str) -> str:
    v, s = _x(p), f"json_extract_string(j, '$.{p}')"
    return f"""CASE WHEN json_type({v}) = 'ARRAY' AND json_array_length({v}) > 0 THEN json_array_length({v})
        WHEN json_type({v}) = 'VARCHAR' AND json_valid({s}) THEN CASE WHEN json_type({s}::JSON) = 'ARRAY' AND json_array_length({s}::JSON) > 0 THEN json_array_length({s}::JSON) END END"""


@query(
    f"WITH {_J} SELECT file_id, line_no, received_at, CASE {' '.join(f'''WHEN ({_list(p)}) IS NOT NULL THEN '{p}' ''' for p in P.CONTAINERS)} END AS container, coalesce({', '.join(f'({_list(p)})' for p in P.CONTAINERS)})::INT AS n_messages FROM raws"
)
def message_containers(spark, sf):
    return _raw(spark, sf).select("file_id", "line_no", "received_at", P.container().alias("container"), F.size(P.message_list()).alias("n")).select("file_id", "line_no", "received_at", "container", F.when(F.col("container").isNotNull(), F.col("n")).alias("n_messages"))


@query(
    f"""WITH {_J} SELECT file_id, line_no, received_at, CASE WHEN {_true('instance_id')} THEN json_extract_string(j, '$.instance_id') WHEN {_true('id')} THEN json_extract_string(j, '$.id')
        WHEN {_true('metadata.instance_id')} THEN json_extract_string(j, '$.metadata.instance_id') WHEN {_true('metadata.sample_id')} THEN regexp_replace(json_extract_string(j, '$.metadata.sample_id'), '^.*?::', '') END AS instance_id FROM raws"""
)
def record_instance_ids(spark, sf):
    return P.with_instance_id(_raw(spark, sf)).select("file_id", "line_no", "received_at", "instance_id")


_DIFFICULTY = "coalesce(" + ", ".join(f"try_cast(json_extract_string(j, '$.{p}') AS DOUBLE)" for p in ("difficulty", "difficulty_score", "score", "metadata.difficulty")) + ")"


@query(f"WITH {_J} SELECT file_id, line_no, received_at, {_DIFFICULTY} AS difficulty FROM raws WHERE {_DIFFICULTY} IS NULL OR {_DIFFICULTY} BETWEEN 4.0 AND 6.0")
def difficulty_range(spark, sf):
    rows = _raw(spark, sf).select("file_id", "line_no", "received_at", P.difficulty().alias("difficulty"))
    return rows.where(P.in_range(F.col("difficulty"), 4.0, 6.0))


# Joins -----------------------------------------------------------------------------------------------------------


@query("SELECT row_id, instance_id FROM sft_merged WHERE NOT EXISTS (SELECT 1 FROM heldout_ids h WHERE h.instance_id = nullif(sft_merged.instance_id, ''))")
def leakage_anti_join(spark, sf):
    return joins.without_leaks(_sft(spark, sf), table(spark, sf, "heldout_ids")).select("row_id", "instance_id")


@query("SELECT count(*) AS input, count(*) - count(h.instance_id) AS kept, count(h.instance_id) AS leaked_verified FROM sft_merged s LEFT JOIN (SELECT DISTINCT instance_id FROM heldout_ids) h ON s.instance_id = h.instance_id")
def leakage_stats(spark, sf):
    return joins.leakage_stats(_sft(spark, sf), table(spark, sf, "heldout_ids"))


@query("SELECT rollout_id, instance_id FROM rollouts WHERE instance_id IN (SELECT instance_id FROM instances WHERE instance_id IS NOT NULL)")
def allow_list_semi_join(spark, sf):
    return joins.only_listed(table(spark, sf, "rollouts"), table(spark, sf, "instances")).select("rollout_id", "instance_id")


@query("SELECT row_id FROM sft_merged s WHERE s.instance_id IN (SELECT instance_id FROM repair_audit WHERE instance_id IS NOT NULL) OR coalesce(s.metadata.resolved, false)")
def resolved_by_side_input(spark, sf):
    return P.resolved_or_listed(_sft(spark, sf), table(spark, sf, "repair_audit"), F.coalesce("metadata.resolved", F.lit(False))).select("row_id")


_JOBS = "jobs AS (SELECT rollout_id AS job_id, max(finished_at) AS created_at FROM rollouts GROUP BY 1)"


@query(
    f"""WITH {_JOBS}, ranked AS (SELECT j.job_id, r.received_at, r.reward, row_number() OVER (PARTITION BY j.job_id ORDER BY r.received_at DESC, r.reward::VARCHAR DESC NULLS LAST) AS k
        FROM jobs j JOIN rollouts r ON r.rollout_id = j.job_id AND r.received_at BETWEEN j.created_at AND j.created_at + INTERVAL 2 HOURS)
        SELECT j.job_id, j.created_at, r.received_at AS result_at, r.reward FROM jobs j LEFT JOIN ranked r ON r.job_id = j.job_id AND r.k = 1"""
)
def job_result_join(spark, sf):
    r = table(spark, sf, "rollouts")
    jobs = r.groupBy(F.col("rollout_id").alias("job_id")).agg(F.max("finished_at").alias("created_at"))
    return joins.with_results(jobs, r.select(F.col("rollout_id").alias("job_id"), F.col("received_at").alias("result_at"), "reward"))


_HALF = "TIMESTAMP '2025-07-01'"


@query(
    f"""WITH b AS (SELECT coalesce(exit_status, 'none') AS k, avg(reward) AS v FROM rollouts WHERE finished_at < {_HALF} GROUP BY 1), a AS (SELECT coalesce(exit_status, 'none') AS k, avg(reward) AS v FROM rollouts WHERE finished_at >= {_HALF} GROUP BY 1)
        SELECT k AS exit_status, round(b.v, 6) AS before, round(a.v, 6) AS after, round(a.v - b.v, 6) AS delta FROM b FULL JOIN a USING (k)"""
)
def before_after_delta(spark, sf):
    r = table(spark, sf, "rollouts").withColumn("exit_status", F.coalesce("exit_status", F.lit("none")))
    half = F.lit("2025-07-01").cast("timestamp_ntz")
    part = lambda c: r.where(c).groupBy("exit_status").agg(F.avg("reward").alias("v"))
    out = joins.compare(part(F.col("finished_at") < half), part(F.col("finished_at") >= half), "exit_status", "v")
    return out.select("exit_status", *(F.round(F.nanvl(c, F.lit(None).cast("double")), 6).alias(c) for c in ("before", "after", "delta")))


@query(
    """WITH t AS (SELECT instance_id, repetition_id + 1 AS attempt, NOT regexp_matches(coalesce(patch, ''), '^\\s*$') AS ok FROM rollouts), f AS (SELECT instance_id, min(attempt) AS a FROM t WHERE ok AND attempt BETWEEN 1 AND 3 GROUP BY 1)
        SELECT i.instance_id, coalesce(f.a, 3)::BIGINT AS rounds, f.a IS NOT NULL AS done FROM (SELECT DISTINCT instance_id FROM rollouts WHERE instance_id IS NOT NULL) i LEFT JOIN f USING (instance_id)"""
)
def retry_rounds(spark, sf):
    r = table(spark, sf, "rollouts")
    attempts = r.select("instance_id", (F.col("repetition_id") + 1).alias("attempt"), "patch")
    return joins.retry(joins.id_set(r), attempts, "instance_id", ~X.is_blank(F.col("patch"))).withColumn("rounds", F.col("rounds").cast("long"))


@query("SELECT row_id, least(len(list_transform(messages, lambda m: m.role)), len(list_filter(list_transform(messages, lambda m: m.content), lambda c: c IS NOT NULL)))::INT AS pairs FROM sft_merged WHERE messages IS NOT NULL")
def zipped_lists(spark, sf):
    texts = F.filter(F.transform("messages", lambda m: m["content"]), lambda c: c.isNotNull())
    return _sft(spark, sf).where("messages IS NOT NULL").select("row_id", F.size(joins.zip_lists(role=F.transform("messages", lambda m: m["role"]), content=texts)).alias("pairs"))


# Counts and lengths ----------------------------------------------------------------------------------------------


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS rows FROM sft_merged GROUP BY 1")
def source_counts(spark, sf):
    return metrics.counts(_sft(spark, sf), F.col("source"), "source")


@query("SELECT regexp_replace(instance_id, '-[^-]*$', '') AS repo, count(*) AS rows FROM instances GROUP BY 1")
def repo_counts(spark, sf):
    return table(spark, sf, "instances").groupBy(repo_from_instance_id(F.col("instance_id")).alias("repo")).agg(F.count("*").alias("rows"))


_RANKED = f"WITH {_SIZES}, r AS (SELECT tokens, row_number() OVER (ORDER BY tokens) AS k, count(*) OVER () AS n FROM sized)"
_P = lambda p: f"min(CASE WHEN k >= greatest(ceil(n * {p} / 100.0::DOUBLE), 1) THEN tokens END)"


@query(f"{_RANKED} SELECT {', '.join(f'{_P(p)} AS p{p}' for p in metrics.PERCENTS)}, max(tokens) AS max, max(n) AS n FROM r")
def length_percentiles(spark, sf):
    return metrics.percentiles(_sized(spark, sf), "tokens")


@query(f"WITH {_SIZES} SELECT cap, count_if(tokens > cap)::BIGINT AS rows_above FROM sized, (SELECT unnest({CAPS})::BIGINT AS cap) GROUP BY cap")
def cap_counts(spark, sf):
    return metrics.above_caps(_sized(spark, sf), "tokens", CAPS)


@query(f"{_RANKED}, t AS (SELECT least(40960, greatest(4096, ceil({_P(95)} / 4096.0) * 4096))::BIGINT AS recommended FROM r) SELECT recommended, round(100.0::DOUBLE * count_if(tokens > recommended) / count(*), 2) AS truncated_pct FROM sized, t GROUP BY recommended")
def length_recommend(spark, sf):
    return metrics.recommend(_sized(spark, sf), "tokens")


# Sampling --------------------------------------------------------------------------------------------------------


def _stratified(n: int, seed: int) -> str:
    return f"""WITH i AS (SELECT DISTINCT instance_id, lower(repo) AS repo FROM instances), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY md5('{seed}:' || instance_id), instance_id) AS round FROM i)
        SELECT instance_id, repo, round::INT AS round FROM r ORDER BY round, md5('{seed}:' || coalesce(repo, '')), repo LIMIT {n}"""


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "instances").select("instance_id", F.lower("repo").alias("repo")).distinct()


@query(_stratified(200, 42))
def stratified_sample(spark, sf):
    return sampling.stratified_sample(_instances(spark, sf), 200, "repo", "instance_id", 42)


@query(f"SELECT repo, count(*) AS rows FROM ({_stratified(100, 42)}) GROUP BY repo")
def dev_split_repo_counts(spark, sf):
    return sampling.stratified_sample(_instances(spark, sf), 100, "repo", "instance_id", 42).groupBy("repo").agg(F.count("*").alias("rows"))


@query(
    f"""WITH c AS (SELECT count_if(source = '{MAJOR}') AS a, count_if(source = '{MINOR}') AS b FROM sft_merged)
        SELECT source, (count(*) + CASE WHEN source = '{MINOR}' AND max(a) > 0 THEN greatest(floor((max(a) + max(b)) * {MIN_FRACTION}::DOUBLE) - max(b), 0) ELSE 0 END)::BIGINT AS rows FROM (SELECT coalesce(source, 'unknown') AS source FROM sft_merged), c GROUP BY source"""
)
def weighted_merge_counts(spark, sf):
    rows = _sft(spark, sf).select("row_id", "source")
    return metrics.counts(sampling.weighted_merge(rows, MAJOR, MINOR, MIN_FRACTION, "row_id"), F.col("source"), "source")


@query("SELECT row_id FROM sft_merged ORDER BY md5('42:' || row_id::VARCHAR), row_id LIMIT 100")
def hash_shuffle_topn(spark, sf):
    return sampling.first_n(_sft(spark, sf).select("row_id"), 100, sampling.hash_order(42, F.col("row_id").cast("string")), "row_id")


@query("SELECT row_id FROM sft_merged ORDER BY added_at, row_id LIMIT 20 OFFSET 10")
def positional_slice(spark, sf):
    return sampling.positions(_sft(spark, sf).select("row_id", "added_at"), 10, 30, "added_at", "row_id").select("row_id")


@query("SELECT row_id, row_number() OVER (ORDER BY added_at, row_id) - 1 AS ordinal FROM sft_merged")
def ordinals(spark, sf):
    return sampling.numbered(_sft(spark, sf).select("row_id", "added_at"), "added_at", "row_id").select("row_id", "ordinal")


@query("SELECT input_no::INT AS input_no, count(*) AS rows, count(DISTINCT instance_id) AS ids FROM (SELECT 0 AS input_no, instance_id FROM sft_merged UNION ALL SELECT 1, instance_id FROM instances UNION ALL SELECT 2, instance_id FROM repair_audit) GROUP BY 1")
def bag_union(spark, sf):
    merged = sampling.union_all([table(spark, sf, t).select("instance_id") for t in ("sft_merged", "instances", "repair_audit")])
    return merged.groupBy("input_no").agg(F.count("*").alias("rows"), F.count_distinct("instance_id").alias("ids"))


@query("SELECT DISTINCT name FROM (SELECT exit_status AS name FROM rollouts UNION ALL SELECT metadata.exit_status FROM sft_merged) ORDER BY name")
def sorted_union_of_names(spark, sf):
    a, b = table(spark, sf, "rollouts").select(F.col("exit_status").alias("name")), _sft(spark, sf).select(F.col("metadata.exit_status").alias("name"))
    return a.union(b).distinct().orderBy("name")


@query()
def random_batch(spark, sf):
    return sampling.batch(table(spark, sf, "instances").select("instance_id", "repo"), "instance_id", step=3, size=64)


@query("SELECT instance_id, 1::BIGINT AS partitions, count(*) AS rows FROM rollouts WHERE coalesce(instance_id, '') <> '' GROUP BY 1")
def sticky_partitions(spark, sf):
    placed = sampling.sticky(table(spark, sf, "rollouts").select("instance_id"), "instance_id", 16).withColumn("partition", F.spark_partition_id())
    return placed.where("instance_id <> ''").groupBy("instance_id").agg(F.count_distinct("partition").alias("partitions"), F.count("*").alias("rows"))


# Context ---------------------------------------------------------------------------------------------------------

_TOTALS = f"""{_FLAT}, t AS (SELECT *, count(*) OVER w AS n, sum(cost) OVER w AS original, coalesce(sum(cost) FILTER (i <= 2) OVER w, 0) AS head FROM flat WINDOW w AS (PARTITION BY row_id)),
    all_rows AS (SELECT s.row_id, coalesce(any_value(n), 0)::INT AS n, coalesce(any_value(original), 0)::BIGINT AS original, coalesce(any_value(head), 0)::BIGINT AS head FROM sft_merged s LEFT JOIN t USING (row_id) GROUP BY 1)"""


@query(
    f"""WITH {_TOTALS}, suffix AS (SELECT row_id, n - i + 1 AS k, sum(cost) OVER (PARTITION BY row_id ORDER BY i DESC) AS s FROM t WHERE i > 2),
        best AS (SELECT a.row_id, max(k) AS k, max(s) AS s FROM all_rows a JOIN suffix x USING (row_id) WHERE a.head + x.s <= {BUDGET} GROUP BY 1)
        SELECT a.row_id, original > {BUDGET} AS truncated, (CASE WHEN original <= {BUDGET} THEN n - least(n, 2) ELSE coalesce(k, 0) END)::INT AS kept_tail, (CASE WHEN original <= {BUDGET} THEN 0 ELSE n - least(n, 2) - coalesce(k, 0) END)::INT AS dropped_messages,
            original, (CASE WHEN original <= {BUDGET} THEN original ELSE head + coalesce(s, 0) END)::BIGINT AS final, CASE WHEN original > {BUDGET} AND k IS NULL THEN 'token_keep_end' END AS fallback
        FROM all_rows a LEFT JOIN best USING (row_id)"""
)
def smart_tail(spark, sf):
    return _sft(spark, sf).select("row_id", context.smart_tail(context.char_costs(F.col("messages")), BUDGET).alias("s")).select("row_id", "s.*")


@query(
    f"""WITH RECURSIVE {_TOTALS}, tail AS (SELECT row_id, i - 3 AS pos, cost, {BUDGET} - head AS room FROM t WHERE i > 2 AND original > {BUDGET}),
        walk AS (SELECT row_id, pos, 0 AS chunk_start, cost AS used, room FROM tail WHERE pos = 0
            UNION ALL SELECT x.row_id, x.pos, CASE WHEN w.used + x.cost > x.room THEN x.pos ELSE w.chunk_start END, CASE WHEN w.used + x.cost > x.room THEN x.cost ELSE w.used + x.cost END, x.room
            FROM walk w JOIN tail x ON x.row_id = w.row_id AND x.pos = w.pos + 1),
        ended AS (SELECT row_id, chunk_start, max(pos) + 1 AS chunk_end, max(used) AS used, any_value(room) AS room FROM walk GROUP BY 1, 2),
        parts AS (SELECT row_id, chunk_start::INT AS chunk_start, chunk_end::INT AS chunk_end, (CASE WHEN used <= room THEN chunk_end - chunk_start ELSE 0 END)::INT AS kept, ({BUDGET} - room + CASE WHEN used <= room THEN used ELSE 0 END)::BIGINT AS cost FROM ended
            UNION ALL SELECT row_id, 0, n - least(n, 2), n - least(n, 2), original FROM all_rows WHERE original <= {BUDGET})
        SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY chunk_start) - 1)::INT AS chunk_index, chunk_start, chunk_end, kept, cost FROM parts"""
)
def chunk_expand(spark, sf):
    rows = _sft(spark, sf).select("row_id", F.posexplode(context.chunks(context.char_costs(F.col("messages")), BUDGET)).alias("chunk_index", "c"))
    return rows.select("row_id", "chunk_index", "c.*")


@query(f"""WITH {_TOTALS}, p AS (SELECT row_id, i, sum(cost) OVER (PARTITION BY row_id ORDER BY i) AS s FROM t) SELECT a.row_id, greatest(coalesce(max(p.i) FILTER (p.s <= {BUDGET}), 0), least(2, any_value(a.n)))::INT AS kept FROM all_rows a LEFT JOIN p USING (row_id) GROUP BY 1""")
def prefix_fit(spark, sf):
    return _sft(spark, sf).select("row_id", context.fitting_prefix(context.char_costs(F.col("messages")), BUDGET, 2).alias("kept"))


_PARTS = f"""RECURSIVE {_TOTALS}, tail AS (SELECT row_id, i - 3 AS pos, cost, {BUDGET} - head AS room FROM t WHERE i > 2 AND original > {BUDGET}),
    walk AS (SELECT row_id, pos, 0 AS chunk_start, cost AS used, room FROM tail WHERE pos = 0
        UNION ALL SELECT x.row_id, x.pos, CASE WHEN w.used + x.cost > x.room THEN x.pos ELSE w.chunk_start END, CASE WHEN w.used + x.cost > x.room THEN x.cost ELSE w.used + x.cost END, x.room
        FROM walk w JOIN tail x ON x.row_id = w.row_id AND x.pos = w.pos + 1),
    ended AS (SELECT row_id, chunk_start, max(pos) + 1 AS chunk_end, max(used) AS used, any_value(room) AS room FROM walk GROUP BY 1, 2),
    parts AS (SELECT row_id, chunk_start, chunk_end, CASE WHEN used <= room THEN chunk_end - chunk_start ELSE 0 END AS kept FROM ended
        UNION ALL SELECT row_id, 0, n - least(n, 2), n - least(n, 2) FROM all_rows WHERE original <= {BUDGET}),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY chunk_start) - 1 AS k, count(*) OVER (PARTITION BY row_id) AS of FROM parts)"""


@query(
    f"""WITH {_PARTS}, per AS (SELECT a.row_id, count(p.row_id) AS n FROM all_rows a LEFT JOIN parts p USING (row_id) GROUP BY 1)
        SELECT count(*) AS input_rows, sum(n)::BIGINT AS output_rows, 0::BIGINT AS truncated_rows, count_if(n > 1)::BIGINT AS chunked_rows, sum(n)::BIGINT AS total_chunks FROM per"""
)
def expansion_stats(spark, sf):
    return context.expansion_stats(_sft(spark, sf), "chunk", BUDGET)


@query(
    f"""WITH {_PARTS} SELECT p.row_id, CASE WHEN of > 1 THEN s.instance_id || '::chunk' || k ELSE s.instance_id END AS instance_id, (least(a.n, 2) + kept)::INT AS n_messages,
        k::INT AS chunk_index, of::INT AS num_chunks, a.original > {BUDGET} AS truncated, (chunk_end - chunk_start - kept)::INT AS dropped_messages,
        md5(array_to_string(list_transform(list_concat(s.messages[1:2], s.messages[3 + chunk_start : 2 + chunk_start + kept]), lambda m: coalesce(m.role, '') || '|' || coalesce(m.content, '')), chr(10))) AS digest
        FROM numbered p JOIN sft_merged s USING (row_id) JOIN all_rows a USING (row_id)"""
)
def chunked_rows(spark, sf):
    out = context.expand(_sft(spark, sf), "chunk", BUDGET)
    digest = F.md5(F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit("|"), F.coalesce(m["content"], F.lit("")))), "\n"))
    limit = [F.col(f"context_limit.{c}").alias(c) for c in ("chunk_index", "num_chunks", "truncated", "dropped_messages")]
    return out.select("row_id", "instance_id", F.size("messages").alias("n_messages"), *limit, digest.alias("digest"))


@query()
def exact_token_costs(spark, sf):
    return context.token_costs(_sft(spark, sf), "row_id", VOCABULARY).select("row_id", context.total(F.col("costs")).alias("tokens"))


@query()
def tokenize_keep_end(spark, sf):
    out = context.tokenize(_sft(spark, sf), "row_id", VOCABULARY, 4096, 50256)
    return out.select("row_id", "full_length", F.size("input_ids").alias("kept"), F.element_at("input_ids", -1).alias("last_id"))


@query()
def loss_mask_lengths(spark, sf):
    ok = _sft(spark, sf).where(M.response_problem(F.col("messages")).isNull())
    out = context.loss_mask(ok, "row_id", VOCABULARY)
    limited = out.withColumn("r", context.limit_response(F.col("response_ids"), F.size("prompt_ids"), 4096, 2048, 8192))
    ones = F.aggregate(F.slice("loss_mask", F.lit(1), F.size("r.ids")), F.lit(0), lambda n, x: n + x)
    return limited.select("row_id", F.size("prompt_ids").alias("prompt"), F.size("r.ids").alias("response"), ones.alias("trained"), F.col("r.stop_reason").alias("stop_reason"))


# Messages --------------------------------------------------------------------------------------------------------

_IDS = f"""{_FLAT}, g AS (SELECT row_id, i, m, (count_if(m.role = 'assistant' AND {_HAS}) OVER (PARTITION BY row_id ORDER BY i))::BIGINT AS grp, (m.role = 'tool' AND coalesce(m.tool_call_id, '') = '') AS needs FROM flat),
    pend AS (SELECT row_id, grp, list_filter(list_transform(m.tool_calls, lambda c: c.id), lambda x: x IS NOT NULL AND x <> '') AS ids FROM g WHERE m.role = 'assistant' AND {_HAS}),
    numbered AS (SELECT g.row_id, g.i, g.m, g.needs, p.ids, (count_if(g.needs) OVER (PARTITION BY g.row_id, g.grp ORDER BY g.i))::BIGINT AS k FROM g LEFT JOIN pend p ON p.row_id = g.row_id AND p.grp = g.grp)"""


def _attached(passes: int) -> str:
    return f"WITH {_IDS} SELECT row_id, (i - 1)::INT AS i, CASE WHEN coalesce(needs, false) AND len(ids) > 0 AND k <= {passes} * len(ids) THEN ids[((k - 1) % len(ids)) + 1] ELSE m.tool_call_id END AS tool_call_id FROM numbered WHERE m.role = 'tool'"


def _tool_ids(spark: SparkSession, sf: str, passes: int) -> DataFrame:
    rows = _sft(spark, sf).select("row_id", F.posexplode(M.attach_call_ids(F.col("messages"), passes)).alias("i", "m"))
    return rows.where("m.role = 'tool'").select("row_id", "i", "m.tool_call_id")


@query(_attached(1))
def tool_id_pairing(spark, sf):
    return _tool_ids(spark, sf, 1)


@query(_attached(3))
def tool_id_pairing_three_passes(spark, sf):
    return _tool_ids(spark, sf, 3)


@query(
    f"""WITH {_IDS} SELECT s.row_id, coalesce(len(s.messages), 0)::INT AS n, md5(coalesce(string_agg(coalesce(m.role, 'user') || '|' || coalesce(m.content, '') || '|' || coalesce(CASE WHEN m.role = 'tool' THEN CASE WHEN needs AND len(ids) > 0 AND k <= len(ids) THEN ids[k] ELSE nullif(m.tool_call_id, '') END END, '')
        || '|' || coalesce(CASE WHEN m.role = 'tool' THEN nullif(m.name, '') END, ''), chr(10) ORDER BY i) FILTER (i IS NOT NULL), '')) AS digest FROM sft_merged s LEFT JOIN numbered USING (row_id) GROUP BY ALL"""
)
def normalized_messages(spark, sf):
    m = M.normalize(F.col("messages"))
    line = lambda x: F.concat(x["role"], F.lit("|"), x["content"], F.lit("|"), F.coalesce(x["tool_call_id"], F.lit("")), F.lit("|"), F.coalesce(x["name"], F.lit("")))
    return _sft(spark, sf).select("row_id", F.size(m).alias("n"), F.md5(F.array_join(F.transform(m, line), "\n")).alias("digest"))


@query(
    f"""WITH {_FLAT}, n AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM flat), v AS (SELECT *, max(CASE WHEN i > 2 AND m.role IN ('assistant', 'tool') THEN i END) OVER (PARTITION BY row_id) AS last FROM n),
        kept AS (SELECT * FROM v WHERE CASE WHEN n <= 2 THEN m.role IN ('user', 'assistant', 'tool') ELSE i <= 2 OR (m.role IN ('user', 'assistant', 'tool') AND i <= coalesce(last, 0)) END)
        SELECT s.row_id, count(k.i)::INT AS messages, coalesce(count_if(k.m.role = 'assistant'), 0)::INT AS assistants, arg_max(k.m.role, k.i) AS last_role FROM sft_merged s LEFT JOIN kept k USING (row_id) GROUP BY 1"""
)
def response_view(spark, sf):
    v = M.response_view(F.col("messages"))
    return _sft(spark, sf).select("row_id", F.size(v).alias("messages"), F.size(F.filter(v, lambda m: m["role"] == "assistant")).alias("assistants"), F.try_element_at(F.transform(v, lambda m: m["role"]), F.lit(-1)).alias("last_role"))


@query(
    f"""WITH {_FLAT}, n AS (SELECT *, count(*) OVER (PARTITION BY row_id) AS n FROM flat), v AS (SELECT *, max(CASE WHEN i > 2 AND m.role IN ('assistant', 'tool') THEN i END) OVER (PARTITION BY row_id) AS last FROM n),
        kept AS (SELECT row_id, m.role AS role, row_number() OVER (PARTITION BY row_id ORDER BY i) AS pos FROM v WHERE CASE WHEN n <= 2 THEN m.role IN ('user', 'assistant', 'tool') ELSE i <= 2 OR (m.role IN ('user', 'assistant', 'tool') AND i <= coalesce(last, 0)) END),
        per AS (SELECT s.row_id, count(k.pos) AS size, coalesce(bool_or(pos <= 2 AND NOT coalesce(role IN ('system', 'user'), false)), false) AS bad, coalesce(bool_or(pos > 2 AND coalesce(role = 'assistant', false)), false) AS answered FROM sft_merged s LEFT JOIN kept k USING (row_id) GROUP BY 1)
        SELECT CASE WHEN size < 3 THEN 'too_few_messages' WHEN bad THEN 'bad_prompt_roles' WHEN NOT answered THEN 'no_assistant' END AS problem, count(*) AS rows FROM per GROUP BY 1"""
)
def response_problems(spark, sf):
    return _sft(spark, sf).groupBy(M.response_problem(F.col("messages")).alias("problem")).agg(F.count("*").alias("rows"))


@query(
    f"""SELECT row_id, md5(array_to_string(list_transform(messages, lambda m: '[' || coalesce(m.role, 'user') || ']' || chr(10) || coalesce(m.content, '')), chr(10) || chr(10))) AS digest,
        CASE WHEN coalesce(source IN {EXPERTS}, false) THEN 1 ELSE coalesce(metadata.difficulty >= 8, false)::INT END AS label FROM sft_merged WHERE len(messages) > 0"""
)
def verifier_text(spark, sf):
    reward = F.when(F.col("metadata.difficulty") >= 8, 1.0)
    return rewards.verifier_rows(_sft(spark, sf), EXPERTS, reward=reward).select("row_id", F.md5("text").alias("digest"), "label")


_ELIDED = """CASE WHEN length(c) < 2000 THEN '<output>' || chr(10) || c || '</output>' ELSE '<warning>' || chr(10) || 'The output of your last command was too long.' || chr(10) || 'Please try a different command that produces less output.' || chr(10) || '</warning>' || chr(10)
    || '<output_head>' || chr(10) || left(c, 1000) || chr(10) || '</output_head>' || chr(10) || '<elided_chars>' || chr(10) || (length(c) - 2000)::VARCHAR || ' characters elided' || chr(10) || '</elided_chars>' || chr(10) || '<output_tail>' || chr(10) || right(c, 1000) || chr(10) || '</output_tail>' END"""


@query(f"SELECT row_id, (i - 1)::INT AS i, length({_ELIDED})::INT AS chars, md5({_ELIDED}) AS digest FROM (SELECT row_id, i, m.content AS c FROM (SELECT row_id, unnest(messages) AS m, generate_subscripts(messages, 1) AS i FROM sft_merged) WHERE m.role IN ('tool', 'user') AND m.content IS NOT NULL)")
def observation_elide(spark, sf):
    flat = _sft(spark, sf).select("row_id", F.posexplode("messages").alias("i", "m")).where("m.role IN ('tool', 'user') AND m.content IS NOT NULL")
    out = flat.select("row_id", "i", X.elide(F.col("m.content"), 2_000, 1_000).alias("x"))
    return out.select("row_id", "i", F.length("x").alias("chars"), F.md5("x").alias("digest"))


@query("SELECT rollout_id, received_at, md5('(truncated)' || chr(10) || right(patch, 1000)) AS digest FROM rollouts")
def error_tails(spark, sf):
    return table(spark, sf, "rollouts").select("rollout_id", "received_at", F.md5(X.error_tail(F.col("patch"))).alias("digest"))


_CODE = r"""WITH b AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '(?is)```(?:python)?\s*\n?(.*?)```', 1), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')) AS blocks FROM documents),
    c AS (SELECT doc_id, CASE WHEN len(list_filter(blocks, lambda x: contains(x, 'def '))) > 0 THEN list_filter(blocks, lambda x: contains(x, 'def '))[-1] WHEN len(blocks) > 0 THEN blocks[-1] ELSE regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') END AS code FROM b)"""


@query(f"{_CODE} SELECT doc_id, md5(nullif(code, '')) AS digest, NOT ({' OR '.join(f'''contains(lower(nullif(code, '')), '{t}')''' for t in X.BANNED)}) AS safe FROM c")
def code_extract(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", X.extract_code(F.col("text")).alias("code"))
    return rows.select("doc_id", F.md5("code").alias("digest"), X.is_safe_code(F.col("code")).alias("safe"))


@query()
def code_format_reward(spark, sf):
    return rewards.format_reward(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "format_reward")


@query("SELECT DISTINCT instance_id, coalesce(image_name, lower('registry/eval.' || replace(instance_id, '__', '_1776_') || ':latest')) AS image FROM instances")
def container_images(spark, sf):
    return table(spark, sf, "instances").select("instance_id", X.container_image(F.col("instance_id"), F.col("image_name"), "registry/eval.", "_1776_").alias("image")).distinct()


@query("SELECT DISTINCT instance_id, md5(coalesce(nullif(problem_statement, ''), nullif(issue_body, ''), '')) AS prompt, base_commit FROM instances")
def rl_rows(spark, sf):
    prompt = F.coalesce(F.nullif("problem_statement", F.lit("")), F.nullif("issue_body", F.lit("")), F.lit(""))
    rows = table(spark, sf, "instances").select("instance_id", F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"), "base_commit")
    return rows.select("instance_id", F.md5(F.col("prompt")[0]["content"]).alias("prompt"), "base_commit").distinct()


@query("SELECT source, substr(sha256(source || chr(31) || '4096' || chr(31) || 'chunk'), 1, 16) AS fingerprint FROM (SELECT DISTINCT source FROM sft_merged WHERE source IS NOT NULL)")
def config_fingerprint(spark, sf):
    rows = _sft(spark, sf).where("source IS NOT NULL").select("source").distinct()
    return rows.select("source", X.fingerprint("source", F.lit("4096"), F.lit("chunk")).alias("fingerprint"))


# Rollouts --------------------------------------------------------------------------------------------------------


def _rollouts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rollouts")


@query("SELECT rollout_id, received_at, round(reward - avg(reward) OVER (PARTITION BY instance_id), 6) AS advantage FROM rollouts")
def group_advantage(spark, sf):
    return metrics.advantages(_rollouts(spark, sf), ["instance_id"]).select("rollout_id", "received_at", F.round("advantage", 6).alias("advantage"))


@query("SELECT rollout_id, received_at FROM (SELECT *, reward - avg(reward) OVER (PARTITION BY instance_id) AS a FROM rollouts) WHERE a > 0 OR reward >= 1")
def positive_rollouts(spark, sf):
    return metrics.positive(metrics.advantages(_rollouts(spark, sf), ["instance_id"])).select("rollout_id", "received_at")


@query("SELECT repetition_id AS step, count(*) AS rollouts, round(avg(reward), 6) AS mean_reward, count_if(coalesce(reward >= 1, false))::BIGINT AS resolved FROM rollouts GROUP BY 1")
def step_metrics(spark, sf):
    return metrics.step_metrics(_rollouts(spark, sf), F.col("repetition_id"))


@query(
    """WITH v AS (SELECT instance_id, score, patch, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, repetition_id, rollout_id, received_at) AS k FROM rollouts WHERE score IS NOT NULL AND NOT isnan(score) AND score > -1)
        SELECT r.instance_id, coalesce(any_value(v.score), -1.0) AS score, coalesce(any_value(v.patch), '') AS patch, count(*) AS candidates FROM rollouts r LEFT JOIN v ON v.instance_id IS NOT DISTINCT FROM r.instance_id AND v.k = 1 GROUP BY 1"""
)
def best_of_n(spark, sf):
    return metrics.best_of_n(_rollouts(spark, sf))


@query("SELECT coalesce(nullif(lower(exit_status), ''), 'none') AS exit_status, count(*) AS rows FROM rollouts GROUP BY 1")
def exit_status_counts(spark, sf):
    return metrics.counts(_rollouts(spark, sf), F.nullif(F.lower("exit_status"), F.lit("")), "exit_status", "none")


@query(
    """WITH o AS (SELECT count(*) AS total, count_if(lower(exit_status) = 'submitted')::BIGINT AS submitted, count_if(lower(exit_status) = 'submitted' AND reward >= 1)::BIGINT AS resolved FROM rollouts)
        SELECT *, round(submitted / total::DOUBLE, 6) AS submit_rate, round(resolved / submitted::DOUBLE, 6) AS resolved_of_submitted, round(resolved / total::DOUBLE, 6) AS end_to_end FROM o"""
)
def exit_status_rates(spark, sf):
    return metrics.status_rates(_rollouts(spark, sf), F.coalesce(F.lower("exit_status") == "submitted", F.lit(False)), F.coalesce(F.col("reward") >= 1, F.lit(False)))


@query("SELECT count(*) AS n, round(avg(reward), 6) AS avg_reward, min(steps) AS min_steps, max(steps) AS max_steps, round(avg(steps), 6) AS avg_steps FROM rollouts")
def rollout_metrics(spark, sf):
    return metrics.rollout_summary(_rollouts(spark, sf))


@query("SELECT count(*) AS total, count_if(regexp_matches(coalesce(patch, ''), '^\\s*$'))::BIGINT AS empty_patches, count_if(reward >= 1)::BIGINT AS resolved FROM rollouts")
def empty_predictions(spark, sf):
    return _rollouts(spark, sf).agg(F.count("*").alias("total"), F.count_if(X.is_blank(F.col("patch"))).alias("empty_patches"), F.count_if(F.col("reward") >= 1).alias("resolved"))


@query(
    """SELECT rollout_id, received_at, round(CASE WHEN regexp_matches(coalesce(patch, ''), '^\\s*$') THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, (starts_with(regexp_replace(patch, '^\\s+', ''), 'diff --git') AND length(patch) > 40)::INT - 0.01::DOUBLE * coalesce(steps, 0)) END, 6) AS reward FROM rollouts"""
)
def resolve_reward(spark, sf):
    return _rollouts(spark, sf).select("rollout_id", "received_at", F.round(rewards.resolve_reward(F.col("patch"), F.col("steps")), 6).alias("reward"))


@query(
    """WITH c AS (SELECT row_id, a AS command, count(*) AS times FROM (SELECT row_id, unnest(list_transform(m.tool_calls, lambda c: c."function".arguments)) AS a FROM (SELECT row_id, unnest(messages) AS m FROM sft_merged)) WHERE a IS NOT NULL GROUP BY 1, 2)
        SELECT row_id, arg_min(command, (-times, command)) AS command, max(times) AS times, sum(times)::BIGINT AS steps FROM c GROUP BY 1"""
)
def repeated_commands(spark, sf):
    return metrics.repeated_commands(_sft(spark, sf), "row_id")


@query("WITH n AS (SELECT instance_id, coalesce(len(repairs), 0) AS n FROM repair_audit) SELECT count(*) AS rows, count_if(n = 0)::BIGINT AS clean, count_if(n > 0)::BIGINT AS repaired, sum(n)::BIGINT AS pairs_removed, max(n)::INT AS most_repairs, count(DISTINCT instance_id) AS unique_instance_ids FROM n")
def repair_rollup(spark, sf):
    return metrics.repair_rollup(table(spark, sf, "repair_audit"))


@query("SELECT r.rejected_tool_call_count AS rejected_tool_call_count, r.reason AS reason, count(*) AS repairs, count_if(r.rejection_index = r.assistant_index + 1)::BIGINT AS adjacent FROM (SELECT unnest(repairs) AS r FROM repair_audit) GROUP BY ALL")
def repair_counts(spark, sf):
    return metrics.repair_counts(table(spark, sf, "repair_audit"))


@query(
    f"""WITH {_FLAT}, l AS (SELECT row_id, i, m, lead(m.role) OVER w AS nr, lead(m.content) OVER w AS nt FROM flat WINDOW w AS (PARTITION BY row_id ORDER BY i))
        SELECT row_id, (i - 1)::INT AS assistant_index, i::INT AS rejection_index, coalesce(len(m.tool_calls), 0)::INT AS rejected_tool_call_count FROM l WHERE m.role = 'assistant' AND coalesce(len(m.tool_calls), 0) <> 1 AND nr = 'user' AND contains(nt, '<returncode>')"""
)
def repair_pairs(spark, sf):
    return metrics.repair_pairs(_sft(spark, sf), "row_id", "<returncode>")


@query(
    f"""WITH {_FLAT}, l AS (SELECT row_id, i, m, lead(m.role) OVER w AS nr, lead(m.content) OVER w AS nt FROM flat WINDOW w AS (PARTITION BY row_id ORDER BY i)), h AS (SELECT row_id, i, m.role = 'assistant' AND coalesce(len(m.tool_calls), 0) <> 1 AND nr = 'user' AND contains(nt, '<returncode>') AS hit FROM l)
        SELECT s.row_id, (len(s.messages) - 2 * coalesce(c.hits, 0))::INT AS messages FROM sft_merged s LEFT JOIN (SELECT row_id, count_if(hit) AS hits FROM h GROUP BY 1) c USING (row_id) WHERE s.messages IS NOT NULL"""
)
def repaired_messages(spark, sf):
    return _sft(spark, sf).where("messages IS NOT NULL").select("row_id", F.size(metrics.repair(F.col("messages"), "<returncode>")).alias("messages"))


@query("SELECT repetition_id AS step, count(*) AS rollouts, round(avg(reward), 6) AS mean_reward, count_if(coalesce(reward >= 1, false))::BIGINT AS resolved FROM rollouts GROUP BY 1")
def stream_step_metrics(spark, sf):
    stream = streamed(spark, sf, "rollouts")
    return run_complete(metrics.step_metrics(stream, F.col("repetition_id")))


@query("SELECT date_trunc('day', finished_at) AS day, coalesce(nullif(lower(exit_status), ''), 'none') AS exit_status, count(*) AS rows FROM rollouts WHERE finished_at IS NOT NULL GROUP BY ALL")
def stream_daily_status(spark, sf):
    stream = streamed(spark, sf, "rollouts").withColumn("at", F.col("finished_at").cast("timestamp")).withWatermark("at", "1 hour")
    status = F.coalesce(F.nullif(F.lower("exit_status"), F.lit("")), F.lit("none")).alias("exit_status")
    counted = stream.where("at IS NOT NULL").groupBy(F.window("at", "1 day").alias("w"), status).agg(F.count("*").alias("rows"))
    return run_complete(counted.select(F.col("w.start").alias("day"), "exit_status", "rows")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("SELECT repetition_id::INT AS step, count(*) AS rollouts, round(avg(reward), 6) AS mean_reward, count_if(coalesce(reward >= 1, false))::BIGINT AS resolved FROM rollouts WHERE repetition_id % 2 = 0 GROUP BY 1")
def stream_step_snapshots(spark, sf):
    """Snapshots for every second step, as they are handed on; the last of each step stands."""
    folder = scratch_path(spark, "snapshots")
    stream = streamed(spark, sf, "rollouts").select(F.col("repetition_id").cast("int").alias("step"), F.col("reward").cast("int").alias("reward"))
    write = lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/data")
    queue.step_snapshots(stream, 2, write, f"{folder}/state").awaitTermination()
    rows = spark.read.schema("step int, rollouts bigint, mean_reward double, resolved bigint, batch int").parquet(f"{folder}/data")
    last = rows.groupBy("step").agg(F.max_by(F.struct("rollouts", "mean_reward", "resolved"), "batch").alias("s"))
    return last.select("step", "s.rollouts", F.round("s.mean_reward", 6).alias("mean_reward"), "s.resolved")


@query(
    """WITH j AS (SELECT DISTINCT rollout_id, finished_at FROM rollouts WHERE finished_at IS NOT NULL),
        r AS (SELECT j.*, r.received_at, r.reward, r.exit_status, row_number() OVER (PARTITION BY j.rollout_id, j.finished_at ORDER BY r.received_at DESC, r.reward DESC NULLS LAST, r.exit_status DESC NULLS LAST) AS k
            FROM j JOIN rollouts r ON r.rollout_id = j.rollout_id AND r.received_at BETWEEN j.finished_at AND j.finished_at + INTERVAL 2 HOURS)
        SELECT j.rollout_id::VARCHAR AS job_id, j.finished_at AS created_at, r.reward, r.exit_status AS error, r.received_at AS result_at FROM j LEFT JOIN r ON r.rollout_id = j.rollout_id AND r.finished_at = j.finished_at AND r.k = 1"""
)
def stream_job_results(spark, sf):
    """Rollouts as jobs and as results, through the queue's folders; jobs and results far ahead close the last deadlines."""
    folder, rows = scratch_path(spark, "queue"), _rollouts(spark, sf)
    at = lambda c: F.col(c).cast("timestamp")
    ahead = lambda c: (F.max(c) + F.expr("INTERVAL 3 DAYS")).cast("timestamp")
    jobs = rows.where("finished_at IS NOT NULL").select(F.col("rollout_id").cast("string").alias("job_id"), F.lit("p").alias("payload"), at("finished_at").alias("created_at"))
    results = rows.select(F.col("rollout_id").cast("string").alias("job_id"), F.col("reward").cast("int").alias("reward"), F.col("exit_status").alias("error"), at("received_at").alias("result_at"))
    last_job = rows.select(F.lit("last").alias("job_id"), F.lit("p").alias("payload"), F.greatest("finished_at", "received_at").alias("t")).groupBy("job_id", "payload").agg(ahead("t").alias("created_at"))
    last_result = rows.select(F.lit("none").alias("job_id"), F.greatest("finished_at", "received_at").alias("t")).groupBy("job_id").agg(F.lit(0).alias("reward"), F.lit("x").alias("error"), ahead("t").alias("result_at"))
    for df, name in ((jobs.unionByName(last_job), "jobs"), (results.unionByName(last_result), "results")):
        df.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{folder}/{name}")
    matched = run_append(queue.correlate(queue.jobs(spark, f"{folder}/jobs", 1_000_000), queue.results(spark, f"{folder}/results")))
    return matched.where("job_id <> 'last'").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "result_at")})


_BEST = """best AS (SELECT r.instance_id, coalesce(any_value(v.score), -1.0) AS score, coalesce(any_value(v.patch), '') AS patch FROM rollouts r LEFT JOIN
    (SELECT instance_id, score, patch, row_number() OVER (PARTITION BY instance_id ORDER BY score DESC, repetition_id, rollout_id, received_at) AS k FROM rollouts WHERE score IS NOT NULL AND NOT isnan(score) AND score > -1) v
    ON v.instance_id = r.instance_id AND v.k = 1 WHERE r.instance_id IS NOT NULL GROUP BY 1)"""
_ENTRY = "STRUCT<model_name_or_path: STRING, instance_id: STRING, model_patch: STRING, verifier_score: DOUBLE>"


@query(f"WITH {_BEST} SELECT instance_id, 'model' AS model, patch, round(score, 6) AS score FROM best")
def prediction_lines(spark, sf):
    """The lines, read again."""
    lines = J.prediction_lines(metrics.best_of_n(_rollouts(spark, sf)), "model").withColumn("e", F.from_json("value", _ENTRY))
    return lines.select("instance_id", F.col("e.model_name_or_path").alias("model"), F.col("e.model_patch").alias("patch"), F.round("e.verifier_score", 6).alias("score"))


@query(f"WITH {_BEST} SELECT instance_id AS key, instance_id, patch, round(score, 6) AS score FROM best")
def prediction_maps(spark, sf):
    """Maps of about 100 predictions each, written as documents and read again."""
    folder = scratch_path(spark, "predictions")
    J.prediction_maps(metrics.best_of_n(_rollouts(spark, sf)), "model", 100).write.partitionBy("file_no").text(folder)
    entries = spark.read.text(folder).select(F.explode(F.from_json("value", f"MAP<STRING, {_ENTRY}>")).alias("key", "e"))
    return entries.select("key", "e.instance_id", F.col("e.model_patch").alias("patch"), F.round("e.verifier_score", 6).alias("score"))


# Sources and sinks -----------------------------------------------------------------------------------------------

_DIGEST = "md5(coalesce(j->>'instance_id', '') || '|' || coalesce(j->>'source', '') || '|' || coalesce(j->>'row_id', ''))"


@query("SELECT row_id, md5(coalesce(instance_id, '') || '|' || coalesce(source, '') || '|' || row_id) AS digest, coalesce(len(messages), 0)::INT AS n_messages FROM sft_merged")
def json_lines_round_trip(spark, sf):
    """All rows as lines of JSON, read again as a folder of records."""
    folder = scratch_path(spark, "lines")
    _sft(spark, sf).write.option("ignoreNullFields", "false").json(f"{folder}/in")
    moved = spark.read.text(f"{folder}/in")
    moved.write.text(f"{folder}/out")
    records = J.read_lines(spark, f"{folder}/out")
    text = lambda p: F.coalesce(F.expr(f"try_variant_get(record, '$.{p}', 'string')"), F.lit(""))
    count = F.coalesce(F.expr("size(try_variant_get(record, '$.messages', 'array<variant>'))"), F.lit(0))
    return records.select(F.expr("variant_get(record, '$.row_id', 'bigint')").alias("row_id"), F.md5(F.concat_ws("|", text("instance_id"), text("source"), text("row_id"))).alias("digest"), F.greatest(count, F.lit(0)).alias("n_messages"))


@query("SELECT instance_id, count(*) AS reports FROM (SELECT DISTINCT instance_id, exit_status FROM rollouts WHERE reward >= 1 AND instance_id IS NOT NULL AND exit_status IS NOT NULL) GROUP BY 1")
def resolved_reports(spark, sf):
    """A report of each exit status as one document id -> {resolved}, written, and the resolved ids read out of them."""
    folder = scratch_path(spark, "reports")
    flags = _rollouts(spark, sf).where("instance_id IS NOT NULL AND exit_status IS NOT NULL").groupBy("exit_status", "instance_id").agg(F.max(F.coalesce(F.col("reward") >= 1, F.lit(False))).alias("resolved"))
    flags.select("exit_status", F.to_json(F.create_map("instance_id", F.struct("resolved"))).alias("value")).write.partitionBy("exit_status").text(folder)
    reports = spark.read.text(folder).select("exit_status", F.parse_json("value").alias("record"))
    listed = reports.select("exit_status", F.explode(F.expr("try_variant_get(record, '$', 'map<string,variant>')")).alias("instance_id", "v"))
    ids = J.resolved_ids(reports)
    return listed.where("try_variant_get(v, '$.resolved', 'boolean')").join(ids, "instance_id", "left_semi").groupBy("instance_id").agg(F.count("*").alias("reports"))


_SPLIT = "CASE WHEN substr(md5('7:' || instance_id), 1, 1) IN ('0', '1') THEN 'test' ELSE 'train' END"


@query(f"SELECT {_SPLIT} AS split, count(*) AS rows FROM (SELECT DISTINCT instance_id FROM instances WHERE instance_id IS NOT NULL) GROUP BY 1")
def split_manifest(spark, sf):
    """One folder for each split, and the manifest of their rows."""
    rows = joins.id_set(table(spark, sf, "instances"))
    split = F.when(F.substring(sampling.hash_order(7, F.col("instance_id")), 1, 1).isin("0", "1"), "test").otherwise("train")
    counts = pipelines.write_splits(rows.withColumn("split", split), "split", scratch_path(spark, "splits"))
    return spark.createDataFrame(sorted(counts.items()), "split string, rows bigint")


@query("SELECT 'not_ready' AS first, 'hit' AS second, 'changed_or_new' AS other, count(*) AS rows, count(*) AS rows_again FROM sft_merged")
def cached_rows(spark, sf):
    """A result published once and used again; other settings give another."""
    base, settings = scratch_path(spark, "cache"), {"inputs": [sf], "tokenizer": "t", "max_length": 1, "max_rows": 0, "policy": "none", "context_limit": 0}
    build = lambda: _sft(spark, sf).select("row_id")
    (a, first), (b, second) = (cache.cached(spark, base, settings, build) for _ in range(2))
    _, other = cache.cached(spark, base, settings | {"policy": "chunk"}, build)
    facts = a.agg(F.count("*").alias("rows")).withColumn("rows_again", b.agg(F.count("*")).scalar())
    return facts.select(F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit("changed_or_new" if other in ("not_ready", "changed") else other).alias("other"), "rows", "rows_again")


# Pipelines -------------------------------------------------------------------------------------------------------


@query("SELECT instance_id, count(*) AS rows FROM rollouts WHERE instance_id IN (SELECT instance_id FROM instances WHERE instance_id IS NOT NULL) GROUP BY 1")
def listed_if_readable(spark, sf):
    listed = joins.only_listed_if_readable(_rollouts(spark, sf), spark, f"{sf}/instances.parquet")
    same = joins.only_listed_if_readable(listed, spark, f"{sf}/no_such_list.parquet")
    return same.groupBy("instance_id").agg(F.count("*").alias("rows"))


_TRIM = lambda c: f"regexp_replace(regexp_replace({c}, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')"


@query(
    f"""WITH d AS (SELECT doc_id, text, repo, list_filter(string_split_regex(text, '\r\n|\n|\r'), lambda x: starts_with(x, 'import ') OR starts_with(x, 'from ')) AS lines FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, md5('You are an expert Python programmer, and here is your task:' || chr(10) || {_TRIM('text')} || chr(10) || 'Your code should pass these tests:' || chr(10) || array_to_string(['assert a', 'assert b', 'assert ' || coalesce(repo, 'c')], chr(10)) || chr(10)
            || 'Put your complete solution in a single ```python ... ``` code block.') AS prompt, 4 AS tests, len(lines)::INT AS imports FROM d"""
)
def code_task_rows(spark, sf):
    """Documents as code tasks: the prompt with the first three tests, and the import lines of the set-up."""
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    tests = F.array(F.lit("assert a"), F.lit("assert b"), F.concat(F.lit("assert "), F.coalesce("repo", F.lit("c"))), F.lit("assert d"))
    setup = F.array_join(F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: x.startswith("import ") | x.startswith("from ")), "\n")
    out = pipelines.task_rows(docs.select(F.col("doc_id").alias("task_id"), "text", tests.alias("test_list"), setup.alias("test_setup_code")))
    return out.select(F.col("task_id").alias("doc_id"), F.md5(F.col("prompt")[0]["content"]).alias("prompt"), F.size("test_list").alias("tests"), F.size("test_imports").alias("imports"))


@query(
    """WITH r AS (SELECT rollout_id, received_at, coalesce(length(patch), 0) AS n, coalesce(steps, 0) AS p FROM rollouts), k AS (SELECT *, least(greatest(300 + 20 - p, 0), greatest(260 - p, 0)) AS room FROM r)
        SELECT rollout_id, received_at, least(n, room)::INT AS kept, CASE WHEN n > room THEN 'length' ELSE 'complete' END AS stop_reason FROM k"""
)
def response_limits(spark, sf):
    ids = F.transform(F.sequence(F.lit(1), F.length("patch")), lambda i: i)
    rows = _rollouts(spark, sf).select("rollout_id", "received_at", F.coalesce("steps", F.lit(0)).alias("p"), F.when(F.length("patch") > 0, ids).otherwise(F.array().cast("array<int>")).alias("ids"))
    return rows.select("rollout_id", "received_at", context.limit_response(F.col("ids"), F.col("p"), 300, 20, 260).alias("r")).select("rollout_id", "received_at", F.size("r.ids").alias("kept"), "r.stop_reason")


@query(f"WITH {_SIZES} SELECT row_id, n_messages FROM sized WHERE tokens <= 4096")
def short_prompts(spark, sf):
    """The rows within a length, kept in a cache and read from it."""
    base, settings = scratch_path(spark, "prompts"), {"inputs": [sf], "tokenizer": "estimate", "max_length": 4096}
    kept, _ = cache.cached(spark, base, settings, lambda: context.short_prompts(_sft(spark, sf), "row_id", 4096))
    return kept.select("row_id", F.greatest(F.coalesce(F.size("messages"), F.lit(0)), F.lit(0)).alias("n_messages"))


_ID = f"""CASE WHEN {_true('instance_id')} THEN json_extract_string(j, '$.instance_id') WHEN {_true('id')} THEN json_extract_string(j, '$.id') WHEN {_true('metadata.instance_id')} THEN json_extract_string(j, '$.metadata.instance_id')
    WHEN {_true('metadata.sample_id')} THEN regexp_replace(json_extract_string(j, '$.metadata.sample_id'), '^.*?::', '') END"""
_EXPERT_LIST = "coalesce(" + ", ".join(f"({_list(p)})" for p in P.CONTAINERS if p != "trajectory.messages") + ", 0)"


@query(
    f"""WITH {_J}, r AS (SELECT {_ID} AS id, {_default('false')} AS resolved, {_DIFFICULTY} AS difficulty, {_EXPERT_LIST} AS n FROM raws)
        SELECT CASE WHEN n = 0 OR coalesce(id, '') = '' THEN 'no_messages' END AS reason, count(*) AS rows FROM r WHERE resolved AND (difficulty IS NULL OR difficulty BETWEEN 4.0 AND 6.0) GROUP BY 1"""
)
def expert_pipeline(spark, sf):
    """Rows the expert pipeline keeps (null) and rejects by reason."""
    kept, rejected = pipelines.expert_rows(_raw(spark, sf), "expert", max_samples=None, max_chars=10**9)
    return kept.select(F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("reason", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


_PLAIN_LIST = lambda p: f"CASE WHEN json_type({_x(p)}) = 'ARRAY' AND json_array_length({_x(p)}) > 0 THEN json_array_length({_x(p)}) END"


@query(
    f"""WITH {_J}, r AS (SELECT *, row_number() OVER (ORDER BY file_id, line_no, received_at, j::VARCHAR) - 1 AS k FROM raws)
        SELECT coalesce(CASE WHEN json_type({_x('instance_id')}) IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN nullif(json_extract_string(j, '$.instance_id'), '') END, CASE WHEN json_type({_x('id')}) IN ('VARCHAR', 'BIGINT', 'UBIGINT') THEN nullif(json_extract_string(j, '$.id'), '') END, printf('traj_%05d', k)) AS instance_id,
            coalesce({', '.join(f'({_PLAIN_LIST(p)})' for p in ('messages', 'conversation', 'trajectory'))})::INT AS n_messages FROM r WHERE {_PLAIN} AND coalesce({', '.join(f'({_PLAIN_LIST(p)})' for p in ('messages', 'conversation', 'trajectory'))}, 0) > 0"""
)
def supplement_pipeline(spark, sf):
    """Rows of a supplement, those without an id named by their position in the whole input."""
    lines = table(spark, sf, "raw_records").where("raw IS NOT NULL")
    records = parse(lines.select("file_id", "line_no", "received_at", "raw")).where("record IS NOT NULL AND schema_of_variant(record) LIKE 'OBJECT%'")
    out = pipelines.supplement_rows(records, "supplement", "file_id", "line_no", "received_at", "raw", max_chars=10**9)
    return out.select("instance_id", F.size("messages").alias("n_messages"))


@query(
    """SELECT i.instance_id, md5(coalesce(nullif(problem_statement, ''), nullif(issue_body, ''), '')) AS prompt, 'pool' AS source, count(*) AS rows FROM instances i
        WHERE i.instance_id IN (SELECT instance_id FROM rollouts WHERE reward >= 1 AND instance_id IS NOT NULL) GROUP BY ALL"""
)
def rl_pool(spark, sf):
    listed = _rollouts(spark, sf).where("reward >= 1").select("instance_id")
    pool = pipelines.rl_pool(table(spark, sf, "instances"), "pool", listed)
    return pool.groupBy("instance_id", F.md5("problem_statement").alias("prompt"), "source").agg(F.count("*").alias("rows"))


@query(
    f"""WITH s AS (SELECT coalesce(source, 'unknown') AS source FROM sft_merged UNION ALL SELECT '{MINOR}' FROM repair_audit WHERE false), c AS (SELECT count_if(source = '{MAJOR}') AS a, count_if(source = '{MINOR}') AS b FROM s)
        SELECT source, (count(*) + CASE WHEN source = '{MINOR}' AND max(a) > 0 AND max(b) > 0 THEN greatest(floor((max(a) + max(b)) * {MIN_FRACTION}::DOUBLE) - max(b), 0) ELSE 0 END)::BIGINT AS rows FROM s, c GROUP BY source"""
)
def merge_pipeline(spark, sf):
    """Two inputs merged, the minor source repeated up to its share."""
    rows = _sft(spark, sf)
    parts = [rows.where("row_id % 2 = 0"), rows.where("NOT coalesce(row_id % 2 = 0, false)")]  # together all rows
    return metrics.counts(pipelines.merge(parts, MAJOR, MINOR, MIN_FRACTION), F.col("source"), "source")


_TASK = "doc_id % 7"


@query(f"SELECT doc_id, {_TASK} AS task_id, coalesce(length(text), 0)::INT AS chars, ({_TASK}) * 10 AS weight FROM documents")
def completion_task_join(spark, sf):
    """Completions joined to their tasks by number."""
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 7).alias("task_id"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    tasks = spark.range(7).select(F.col("id").alias("task_id"), (F.col("id") * 10).alias("weight"))
    return pipelines.with_tasks(tasks, docs).select("doc_id", "task_id", "chars", "weight")


_STATUS = "coalesce(nullif(lower(exit_status), ''), 'none')"
_KEY = "CASE s WHEN 'submitted' THEN 'pass@1{0},submitted' WHEN 'none' THEN 'acc{0},none' ELSE concat('pass_at_1{0},', s) END"


@query(
    f"""WITH g AS (SELECT instance_id AS task, {_STATUS} AS s, avg(coalesce(reward >= 1, false)::INT) AS v, count(*) AS n FROM rollouts WHERE instance_id IS NOT NULL GROUP BY ALL),
        k AS (SELECT *, 2 * row_number() OVER (PARTITION BY task ORDER BY s) AS position FROM g),
        e AS (SELECT task, {_KEY.format('')} AS key, v AS value, position FROM k UNION ALL SELECT task, {_KEY.format('_stderr')}, sqrt(v * (1 - v) / n), position + 1 FROM k WHERE n > 1),
        p AS (SELECT *, CASE WHEN starts_with(key, 'pass@1,') THEN 0 WHEN starts_with(key, 'pass@1') THEN 1 WHEN starts_with(key, 'pass_at_1,') THEN 2 WHEN starts_with(key, 'pass_at_1') THEN 3 END AS p FROM e),
        b AS (SELECT task, arg_min(key, (p, position)) AS key, arg_min(value, (p, position)) AS value FROM p WHERE p IS NOT NULL GROUP BY 1)
        SELECT b.task, round(b.value, 6) AS value, round(e.value, 6) AS stderr FROM b LEFT JOIN e ON e.task = b.task AND e.key = replace(replace(b.key, 'pass@1', 'pass@1_stderr'), 'pass_at_1', 'pass_at_1_stderr')"""
)
def metric_selection(spark, sf):
    rows = _rollouts(spark, sf).where("instance_id IS NOT NULL").groupBy(F.col("instance_id").alias("task"), F.expr(_STATUS).alias("s"))
    g = rows.agg(F.avg(F.coalesce(F.col("reward") >= 1, F.lit(False)).cast("int")).alias("v"), F.count("*").alias("n")).withColumn("position", 2 * F.row_number().over(Window.partitionBy("task").orderBy("s")))
    values = g.selectExpr("task", f"{_KEY.format('')} AS key", "v AS value", "position")
    errors = g.where("n > 1").selectExpr("task", f"{_KEY.format('_stderr')} AS key", "sqrt(v * (1 - v) / n) AS value", "position + 1 AS position")
    return metrics.pass_at_1(values.unionByName(errors)).select("task", F.round("value", 6).alias("value"), F.round("stderr", 6).alias("stderr"))


@query(
    """WITH r AS (SELECT instance_id, coalesce(lower(exit_status) = 'submitted', false) AS done, coalesce(reward >= 1, false) AS good, NOT regexp_matches(coalesce(patch, ''), '^\\s*$') AS code FROM rollouts),
        s AS (SELECT count_if(done AND good) AS passed, count_if(done) AS total, bool_or(code) AS has_code FROM r GROUP BY instance_id)
        SELECT count(*) AS n, round(avg((total > 0 AND passed = total)::INT), 6) AS pass_at_1, round(avg(CASE WHEN total > 0 THEN passed / total ELSE 0 END), 6) AS mean_reward, round(avg(has_code::INT), 6) AS has_code_rate FROM s"""
)
def code_metrics(spark, sf):
    done, good = F.coalesce(F.lower("exit_status") == "submitted", F.lit(False)), F.coalesce(F.col("reward") >= 1, F.lit(False))
    samples = _rollouts(spark, sf).groupBy("instance_id").agg(F.count_if(done & good).alias("passed"), F.count_if(done).alias("total"), F.bool_or(~X.is_blank(F.col("patch"))).alias("has_code"))
    rates = metrics.code_metrics(samples.withColumn("pass_all", F.expr("total > 0 AND passed = total")))
    return rates.select("n", *(F.round(c, 6).alias(c) for c in ("pass_at_1", "mean_reward", "has_code_rate")))

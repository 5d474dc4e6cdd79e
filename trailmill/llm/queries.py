"""Queries of the subpackage: name -> plan builder, name -> SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import chunking, languages, mixing, neardup, packing, splits, token_budget


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = splits.grouped(table(spark, sf, "sft_merged"), table(spark, sf, "repos"))
    return rows.where("family IS NOT NULL").select("row_id", "family")


def p2_splits(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_records(table(spark, sf, "sft_merged"), table(spark, sf, "repos"))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = p2_splits(spark, sf).groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups"))
    whole = table(spark, sf, "sft_merged").agg(F.count("*")).scalar()
    return rows.select("split", "rows", "groups", F.round(F.col("rows") / whole, 6).alias("share"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every group with its rows and the number of splits it is in, which is 1."""
    return p2_splits(spark, sf).groupBy("group").agg(F.count("*").alias("rows"), F.count_distinct("split").alias("splits"))


def p3_rows(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget.row_budget(table(spark, sf, "sft_merged"), table(spark, sf, "instances"), table(spark, sf, "repos"))


def p3_budget(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget.budget(p3_rows(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget.row_tokens(table(spark, sf, "sft_merged")).where("NOT usable").select("row_id")


def p3_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "sft_merged").select("row_id", "instance_id", "source")
    return token_budget.labels(rows, table(spark, sf, "instances"), table(spark, sf, "repos"))


def p3_exact(spark: SparkSession, sf: str) -> DataFrame:
    """One row: rows, and rows for which the tries give the tokens that plain encoding of every string gives."""
    rows = table(spark, sf, "sft_merged")
    both = token_budget.row_tokens(rows).join(token_budget.plain_tokens(rows).withColumnRenamed("n_tokens", "plain"), "row_id", "full_outer")
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("n_tokens") == F.col("plain")).alias("same"))


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_rows(table(spark, sf, "sft_merged"), table(spark, sf, "size_limits"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.rows_cut(p4_pieces(spark, sf), table(spark, sf, "size_limits")).select("row_id")


def p4_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """What the pieces make up again: whole texts, limits and overlaps of every row that is cut."""
    return chunking.rebuilt(p4_pieces(spark, sf), table(spark, sf, "size_limits"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.row_pairs(*neardup.similar(table(spark, sf, "sft_merged")))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(*neardup.similar(table(spark, sf, "sft_merged")))


def p5_search(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.search(*neardup.similar(table(spark, sf, "sft_merged"))).select("query_id", "row_id")


def _capacity(spark: SparkSession, sf: str) -> int:
    return chunking.limits(table(spark, sf, "size_limits"), "pack_container").size


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.sizes(table(spark, sf, "documents")), _capacity(spark, sf))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.report(p6_containers(spark, sf), _capacity(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.cut_items(p6_containers(spark, sf)).select("doc_id")


def p6_proof(spark: SparkSession, sf: str) -> DataFrame:
    measured = packing.sizes(table(spark, sf, "documents"))
    return packing.proof(packing.pack(measured, _capacity(spark, sf)), measured, _capacity(spark, sf))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[1]


def p7_exact(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), exact=True)[1]


def p7_exact_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), exact=True)[0]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.short_sources(p7_report(spark, sf))


def p7_proof(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.proof(*mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


def p8_languages(spark: SparkSession, sf: str) -> DataFrame:
    return languages.identify(table(spark, sf, "documents"))


def p8_segments(spark: SparkSession, sf: str) -> DataFrame:
    return p8_languages(spark, sf).select("doc_id", F.posexplode("segments").alias("segment_no", "s")).select("doc_id", "segment_no", "s.*")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.cases(p8_languages(spark, sf))


QUERIES = {
    "p2_found": p2_found, "p2_splits": p2_splits, "p2_report": p2_report, "p2_groups": p2_groups,
    "p3_found": p3_found, "p3_rows": p3_rows, "p3_budget": p3_budget, "p3_labels": p3_labels, "p3_exact": p3_exact,
    "p4_found": p4_found, "p4_pieces": p4_pieces, "p4_rebuilt": p4_rebuilt,
    "p5_found": p5_found, "p5_groups": p5_groups, "p5_search": p5_search,
    "p6_found": p6_found, "p6_containers": p6_containers, "p6_report": p6_report, "p6_proof": p6_proof,
    "p7_found": p7_found, "p7_proof": p7_proof, "p7_mix": p7_mix, "p7_report": p7_report, "p7_exact": p7_exact, "p7_exact_mix": p7_exact_mix,
    "p8_found": p8_found, "p8_languages": p8_languages, "p8_segments": p8_segments,
}

_STRINGS = """SELECT row_id, unnest(flatten(list_transform(messages, lambda m: list_concat([m.content],
    coalesce(list_transform(m.tool_calls, lambda c: c."function".arguments), []))))) AS piece FROM sft_merged"""
_LIST = """list_filter(flatten(list_transform(messages, lambda m: list_concat([m.content],
    coalesce(list_transform(m.tool_calls, lambda c: c."function".arguments), [])))), lambda x: x IS NOT NULL)"""
_TEXT = f"array_to_string({_LIST}, '')"
_NAMES = """names AS (SELECT lower(repo) AS name, lower(repo) AS node FROM repos UNION ALL SELECT lower(former_name), lower(repo) FROM repos WHERE former_name IS NOT NULL AND lower(former_name) NOT IN (SELECT lower(repo) FROM repos))"""


def _ids(rows: str) -> str:
    """SQL: `rows` (with instance_id) and core, unified, name, suffix of the id."""
    return rf"""SELECT *, regexp_replace(unified, '(-\d+|\.[0-9a-f]{{6,40}}\..*)$', '') AS name, regexp_extract(unified, '(-\d+|\.[0-9a-f]{{6,40}}\..*)$', 1) AS suffix FROM (SELECT *, regexp_replace(
        CASE WHEN contains(core, '__') AND NOT regexp_matches(core, '^[^_/]+/') THEN core ELSE regexp_replace(core, '^([^/_]+)(?:/|_1776_|_s_)', '\1__') END, '#(\d+)$', '-\1') AS unified
        FROM (SELECT *, CASE WHEN contains(t, '::') AND NOT regexp_matches(split_part(t, '::', 1), '__|/|_1776_') THEN substr(t, instr(t, '::') + 2) ELSE t END AS core
            FROM (SELECT *, regexp_replace(lower(regexp_replace(instance_id, '^\s+|\s+$', '', 'g')), '(::chunk\d+)+$', '') AS t FROM ({rows}))))"""


_FAMILIES = rf"""links AS (SELECT lower(repo) AS a, 'owner:' || lower(owner) AS b FROM repos UNION SELECT lower(repo), lower(fork_of) FROM repos WHERE fork_of IS NOT NULL),
        ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links), reach AS (SELECT lower(repo) AS x, lower(repo) AS y FROM repos UNION SELECT r.x, w.b FROM reach r JOIN ways w ON w.a = r.y),
        families AS (SELECT x AS node, min(repo) AS family FROM reach JOIN repos ON lower(repo) = y GROUP BY 1),
        {_NAMES}, ids AS ({_ids("SELECT row_id, instance_id FROM sft_merged")})"""
_GROUPS = f"""{_FAMILIES}, grouped AS (SELECT coalesce('family:' || family, CASE WHEN regexp_matches(i.name, '^[^_/]+__.') THEN 'repo:' || i.name END, 'id:' || nullif(core, ''), 'row:' || row_id) AS "group"
        FROM ids i LEFT JOIN names n ON n.name = i.name LEFT JOIN families USING (node)),
        sizes AS (SELECT "group", count(*) AS rows FROM grouped GROUP BY 1)"""
_MOST = ("a >= b AND a >= c", "NOT (a >= b AND a >= c) AND b >= c", "NOT (a >= b AND a >= c) AND b < c")
_GIVE = ", ".join(f"{x} - CASE WHEN {m} THEN rows ELSE 0 END, r{x} + CASE WHEN {m} THEN rows ELSE 0 END, g{x} + CASE WHEN {m} THEN 1 ELSE 0 END" for x, m in zip("abc", _MOST))
# Signs that are a word of their own: fixed values, as in `neardup`.
_LONE = r"々-〇぀-ヺー-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\x{20000}-\x{3ffff}"
_WORDS = rf"regexp_extract_all(regexp_replace(lower(array_to_string({_LIST}, chr(10))), '([{_LONE}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}_]+')"
_PAIRS = f"""w AS MATERIALIZED (SELECT row_id, {_WORDS} AS words FROM sft_merged WHERE row_id IS NOT NULL),
    s AS MATERIALIZED (SELECT row_id, list_distinct(list_transform(range(1, len(words) - 1), lambda i: hash(words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS set FROM w WHERE len(words) >= 3),
    compared AS (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, len(a.set) AS na, len(b.set) AS nb, len(list_intersect(a.set, b.set)) AS n
        FROM s a JOIN s b ON a.row_id < b.row_id AND len(a.set) >= 0.6 * len(b.set) AND len(b.set) >= 0.6 * len(a.set)),
    pairs AS MATERIALIZED (SELECT row_id_a, row_id_b FROM compared WHERE n >= 0.6 * (na + nb - n))"""
SQL: dict[str, str] = {
    "p5_found": f"WITH {_PAIRS} SELECT row_id_a, row_id_b FROM pairs",
    "p5_search": f"WITH {_PAIRS} SELECT row_id_a AS query_id, row_id_b AS row_id FROM pairs WHERE row_id_a % 100 = 0 UNION ALL SELECT row_id_b, row_id_a FROM pairs WHERE row_id_b % 100 = 0",
    "p5_groups": f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT row_id, min(row_id) OVER (PARTITION BY list_sort(set)) AS class_id FROM s),
        l AS (SELECT DISTINCT a.class_id AS x, b.class_id AS y FROM pairs p JOIN c a ON a.row_id = p.row_id_a JOIN c b ON b.row_id = p.row_id_b WHERE a.class_id <> b.class_id),
        ways AS (SELECT x, y FROM l UNION SELECT y, x FROM l), reach AS (SELECT x, y FROM ways UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
        g AS (SELECT x, min(y) AS least FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS links FROM ways GROUP BY 1)
        SELECT row_id, class_id, coalesce(least(least, class_id), class_id) AS group_id, coalesce(links, 0) AS links FROM c LEFT JOIN g ON g.x = class_id LEFT JOIN n ON n.x = class_id""",
    "p2_found": f"""WITH RECURSIVE {_FAMILIES} SELECT row_id, family FROM ids JOIN names USING (name) JOIN families USING (node)""",
    "p2_groups": f"""WITH RECURSIVE {_GROUPS} SELECT "group", rows, 1::BIGINT AS splits FROM sizes""",
    "p2_report": f"""WITH RECURSIVE {_GROUPS}, o AS (SELECT rows, row_number() OVER (ORDER BY rows DESC) AS k FROM sizes), t AS (SELECT sum(rows)::DOUBLE AS n FROM sizes),
        walk AS (SELECT 0::BIGINT AS k, n * 0.8::DOUBLE AS a, 0::BIGINT AS ra, 0::BIGINT AS ga, n * 0.1::DOUBLE AS b, 0::BIGINT AS rb, 0::BIGINT AS gb, n * 0.1::DOUBLE AS c, 0::BIGINT AS rc, 0::BIGINT AS gc FROM t
            UNION ALL SELECT o.k, {_GIVE} FROM walk w JOIN o ON o.k = w.k + 1),
        last AS (SELECT * FROM walk ORDER BY k DESC LIMIT 1)
        SELECT split, rows, groups, round(rows / n, 6) AS share FROM t, (SELECT 'train' AS split, ra AS rows, ga AS groups FROM last UNION ALL SELECT 'validation', rb, gb FROM last UNION ALL SELECT 'test', rc, gc FROM last) WHERE rows > 0""",
    "p3_found": f"""SELECT row_id FROM sft_merged ANTI JOIN (SELECT row_id FROM ({_STRINGS})
        WHERE regexp_matches(piece, '[^\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]')) USING (row_id)""",
    "p3_labels": rf"""WITH {_NAMES}, parsed AS (SELECT i.*, n.node, coalesce(lower(n.node) || i.suffix, nullif(unified, '')) AS issue FROM ({_ids("SELECT row_id AS k, instance_id, source, NULL AS issue_lang FROM sft_merged UNION ALL SELECT NULL, instance_id, NULL, coalesce(issue_lang, '') FROM instances")}) i LEFT JOIN names n ON n.name = i.name),
        langs AS (SELECT issue, CASE WHEN min(nullif(issue_lang, '')) <> max(nullif(issue_lang, '')) THEN 'unclear' ELSE min(nullif(issue_lang, '')) END AS lang FROM parsed WHERE issue_lang IS NOT NULL AND issue IS NOT NULL GROUP BY 1)
        SELECT p.k AS row_id, CASE WHEN s IS NULL OR s IN ('', 'unknown', 'none', 'null', 'n/a') THEN 'unknown' ELSE s END AS source, coalesce(lang, 'unknown') AS lang, coalesce(r.domain, 'unknown') AS domain
        FROM (SELECT *, regexp_replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '[- ]', '_', 'g') AS s FROM parsed WHERE issue_lang IS NULL) p LEFT JOIN langs USING (issue) LEFT JOIN repos r ON lower(r.repo) = p.node""",
    "p3_exact": "SELECT count(*) AS rows, count(*) AS same FROM sft_merged WHERE row_id IS NOT NULL",
    "p6_proof": "SELECT count(*) AS documents, count_if(coalesce(text, '') = '')::BIGINT AS without_room, 0::BIGINT AS broken, 0::BIGINT AS cut_in_vain, 0::BIGINT AS overfull FROM documents",
    "p7_proof": "SELECT source, target_share, max_repeats::BIGINT AS max_repeats, 0::BIGINT AS uses_above, 0::BIGINT AS repeated_uses FROM mix_targets",
    "p4_found": f"""SELECT row_id FROM ({_STRINGS}) GROUP BY row_id
        HAVING sum(length(piece)) > (SELECT max_size FROM size_limits WHERE limit_name = 'trajectory_piece')""",
    "p4_rebuilt": f"""WITH t AS (SELECT row_id, {_TEXT} AS text FROM sft_merged)
        SELECT row_id, length(text) AS n_chars, md5(text) AS digest, true AS fits, true AS repeats FROM t WHERE length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'trajectory_piece')""",
}

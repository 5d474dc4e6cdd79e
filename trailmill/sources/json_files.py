"""JSON sources and sinks."""

from __future__ import annotations

import fnmatch
import json
import os
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import trim_ws
from ..operators import predicates as P


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw, record VARIANT) of each line that is not blank; a line that is no JSON raises."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), trim_ws(F.col("value")).alias("raw")).where("raw <> ''")
    return lines.withColumn("record", F.parse_json("raw"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, record VARIANT) of everything below a directory: each line of `*.jsonl`, each item of a list and each
    object in `*.json` (each file once, also `*.traj.json`). Files of JSON that cannot be read are left out; a bad
    line raises."""
    where = F.col("_metadata.file_path").alias("path")
    lines = spark.read.text(path, pathGlobFilter="*.jsonl", recursiveFileLookup=True).select(where, trim_ws(F.col("value")).alias("raw")).where("raw <> ''").select("path", F.parse_json("raw").alias("record"))
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True).select(where, F.try_parse_json("value").alias("doc")).where("doc IS NOT NULL")
    kind = F.split_part(F.schema_of_variant("doc"), F.lit("<"), F.lit(1))
    items = F.when(kind == "ARRAY", F.expr("try_variant_get(doc, '$', 'array<variant>')")).when(kind == "OBJECT", F.array("doc"))
    return lines.unionAll(files.select("path", F.explode(items).alias("record")))


def resolved_ids(reports: DataFrame) -> DataFrame:
    """(instance_id) with a true `resolved` in reports `record` of the form id -> {resolved}; other values are skipped."""
    entries = F.expr("try_variant_get(record, '$', 'map<string,variant>')")
    flat = reports.select(F.explode(entries).alias("instance_id", "v"))
    return flat.where("coalesce(try_variant_get(v, '$.resolved', 'boolean'), false)").select("instance_id").distinct()


def report_flags(reports: DataFrame) -> DataFrame:
    """(instance_id, resolved) of every entry of such reports."""
    flat = reports.select(F.explode(F.expr("try_variant_get(record, '$', 'map<string,variant>')")).alias("instance_id", "v"))
    return flat.select("instance_id", F.expr("coalesce(try_variant_get(v, '$.resolved', 'boolean'), false)").alias("resolved"))


def metric_entries(results: DataFrame) -> DataFrame:
    """(task, key, value, position) of results `record` of the form {results: {task: {key: value}}}."""
    tasks = results.select(F.explode(F.expr("try_variant_get(record, '$.results', 'map<string,variant>')")).alias("task", "v"))
    pairs = tasks.select("task", F.posexplode(F.expr("try_variant_get(v, '$', 'map<string,variant>')")).alias("position", "key", "x"))
    return pairs.select("task", "key", F.expr("try_variant_get(x, '$', 'double')").alias("value"), "position")


def read_table(spark: SparkSession, registry: dict[str, str], name: str, split: str | None = None) -> DataFrame:
    """A named table of a registry name -> path; a split is a folder or a file of it."""
    path = registry[name]
    if split is None:
        return spark.read.parquet(path)
    try:
        return spark.read.parquet(f"{path}/{split}")
    except AnalysisException:
        return spark.read.parquet(f"{path}/{split}.parquet")


def _status(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match, in order, on whatever file system the pattern names."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(sc._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or ())


def _below(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """The files whose names match at any depth below a folder; only names are listed."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    files, out = fs.listFiles(at, True), []
    while files.hasNext():
        path = files.next().getPath()
        if fnmatch.fnmatchcase(path.getName(), pattern):
            out.append(path.toString())
    return sorted(out)


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The preferred of several inputs."""
    for p in paths:
        if _status(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def verifier_inputs(spark: SparkSession, positives: str, folder: str, pattern: str, fallback: str) -> list[str]:
    """The file of positives, if there is one, and every buffer of the folder; without any, the fallback."""
    found = [positives] if _status(spark, positives) else []
    return [*found, *_status(spark, f"{folder.rstrip('/')}/{pattern}")] or [fallback]


def latest_results(spark: SparkSession, folder: str, pattern: str = "results_*.json") -> str | None:
    """The last such file in the order of paths."""
    return max(_below(spark, folder, pattern), default=None)


def sample_files(spark: SparkSession, results: str) -> list[str]:
    """The sample files with the stamp of a results file, else all beside it."""
    folder, _, name = results.rpartition("/")
    stamp = name.removesuffix(".json").removeprefix("results_")
    return _status(spark, f"{folder}/samples_*_{stamp}.jsonl") or _status(spark, f"{folder}/samples_*.jsonl")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; replaces what was there when the job ends."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_document(value, path: str) -> None:
    """A small result of the driver as JSON, indented by 2, put in place at once."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.part")
    part.write_text(json.dumps(value, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    os.replace(part, target)


def prediction_lines(predictions: DataFrame, model: str) -> DataFrame:
    """(instance_id, value): each prediction as JSON, one row for each id."""
    body = F.struct(F.lit(model).alias("model_name_or_path"), "instance_id", F.col("patch").alias("model_patch"), F.col("score").alias("verifier_score"))
    return predictions.where("instance_id IS NOT NULL").select("instance_id", F.to_json(body).alias("value"))


def prediction_maps(predictions: DataFrame, model: str, per_file: int = 50_000) -> DataFrame:
    """(file_no, value): predictions as JSON maps keyed by id, each of about `per_file` entries and a document of its own;
    up to that many predictions make one map. Write them with `partitionBy("file_no")` or, if it is one, as text."""
    lines = prediction_lines(predictions, model)
    # A hash of the id says which map; their number follows from the rows, so no map grows with the data.
    files = F.greatest(F.ceil(lines.agg(F.count("*")).scalar() / F.lit(per_file)), F.lit(1))
    parts = lines.groupBy(F.pmod(F.xxhash64("instance_id"), files).cast("int").alias("file_no")).agg(F.array_sort(F.collect_list(F.struct("instance_id", "value"))).alias("e"))
    entry = lambda x: F.concat(F.regexp_extract(F.to_json(F.struct(x["instance_id"].alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1), F.lit(": "), x["value"])
    return parts.select("file_no", F.concat(F.lit("{"), F.array_join(F.transform("e", entry), ", "), F.lit("}")).alias("value"))


def read_with_resolved(spark: SparkSession, records: str, reports: str, predicate: Column) -> DataFrame:
    """Records below a directory whose id the reports below another call resolved, or that meet the predicate; without
    any resolved id the predicate alone decides. Adds `instance_id`."""
    rows = P.with_instance_id(read_directory(spark, records))
    return P.resolved_or_listed(rows, resolved_ids(read_directory(spark, reports)), F.coalesce(predicate, F.lit(False)))


def write_trajectories(df: DataFrame, path: str) -> None:
    """Trajectories in folders by step and phase."""
    df.write.mode("append").partitionBy("step", "phase").json(path)

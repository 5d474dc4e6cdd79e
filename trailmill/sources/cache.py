"""Versioned materialised results.

A build writes a data folder of its own; the manifest, which names that folder, is put in place last and at once, so a
reader has the old result or the new one, never a part. The data folder before the present one is kept for readers that
are still at it; older ones are removed. Of callers that miss at once one takes the lock and builds; the others wait for
its result. A lock older than `stale_s` belongs to a builder that died and is taken over.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

VERSION = 1
#: Seconds that callers wait for the builder, and between two looks.
WAIT_S, POLL_S = 7_200.0, 2.0
#: The settings that have to agree.
KEYS = ("version", "inputs", "tokenizer", "max_length", "max_rows", "policy", "context_limit")


def fingerprint(settings: dict[str, Any]) -> str:
    """16 hexadecimal digits of the settings in the order of their names."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:16]


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def input_state(spark: SparkSession, paths: list[str]) -> list[dict[str, Any]]:
    """Path, time of change and size of each input."""
    out = []
    for path in paths:
        fs, p = _fs(spark, path)
        status = fs.getFileStatus(p)
        out.append({"path": path, "mtime": status.getModificationTime(), "size": fs.getContentSummary(p).getLength()})
    return out


def location(base: str, settings: dict[str, Any]) -> str:
    return f"{base.rstrip('/')}/{fingerprint(settings)}"


def read_manifest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    fs, p = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        return None
    try:
        return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect()))
    except ValueError:
        return None


def data_path(path: str, manifest: dict[str, Any]) -> str:
    return f"{path}/{manifest['data']}"


def is_ready(spark: SparkSession, path: str) -> bool:
    """Manifest there and its data complete."""
    manifest = read_manifest(spark, path)
    if manifest is None or "data" not in manifest:
        return False
    fs, done = _fs(spark, f"{data_path(path, manifest)}/_SUCCESS")
    return fs.exists(done)


def matches(manifest: dict[str, Any] | None, settings: dict[str, Any]) -> bool:
    return manifest is not None and all(manifest.get(k) == settings.get(k) for k in KEYS)


def decide(spark: SparkSession, path: str, settings: dict[str, Any], force: bool = False, enabled: bool = True) -> str:
    """`build` or `use`, and why: forced, disabled, not_ready, changed, hit."""
    if force:
        return "forced"
    if not enabled:
        return "disabled"
    if not is_ready(spark, path):
        return "not_ready"
    return "hit" if matches(read_manifest(spark, path), settings) else "changed"


def _replace(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file over another, at once."""
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = sc._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    at = jvm.org.apache.hadoop.fs.Path(source)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(at, jvm.org.apache.hadoop.fs.Path(target), options)


def publish(df: DataFrame, path: str, settings: dict[str, Any], stats: dict[str, Any] | None = None) -> dict[str, Any]:
    """Writes the data to a new folder, then the manifest over the old one; a reader sees the whole or nothing."""
    spark = df.sparkSession
    before = read_manifest(spark, path) or {}
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    manifest = settings | {"data": data, "rows": spark.read.parquet(f"{path}/{data}").count(), "stats": stats or {}}
    part = f"{path}/.manifest-{uuid.uuid4().hex}.part"
    fs, part_at = _fs(spark, part)
    stream = fs.create(part_at, True)
    stream.write(bytearray(json.dumps(manifest, indent=2, ensure_ascii=False, default=str).encode()))
    stream.close()
    _replace(spark, part, f"{path}/manifest.json")
    for status in fs.listStatus(_fs(spark, path)[1]):
        name = status.getPath().getName()
        if name.startswith("data-") and name not in (data, before.get("data")):
            fs.delete(status.getPath(), True)
    return manifest


def _claim(spark: SparkSession, path: str, stale_s: float) -> bool:
    """Takes the lock of a folder, unless another holds it."""
    fs, lock = _fs(spark, f"{path}/.builder")
    fs.mkdirs(lock.getParent())
    if fs.exists(lock):
        try:
            age = time.time() - fs.getFileStatus(lock).getModificationTime() / 1000
        except Exception:  # noqa: BLE001  the builder has just let go of it
            age = 0.0
        if age < stale_s:
            return False
        fs.delete(lock, False)
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local files know no exclusive creation
            os.close(os.open(lock.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        else:
            fs.create(lock, False).close()
    except Exception:  # noqa: BLE001  another was faster
        if not fs.exists(lock):
            raise
        return False
    return True


def wait(spark: SparkSession, path: str, settings: dict[str, Any], timeout_s: float = WAIT_S, poll_s: float = POLL_S, not_data: str | None = None) -> None:
    """Until another caller has published a result for these settings, other than the data folder `not_data`."""
    deadline = time.monotonic() + timeout_s
    while True:
        manifest = read_manifest(spark, path)
        if matches(manifest, settings) and manifest.get("data") != not_data and is_ready(spark, path):
            return
        if time.monotonic() >= deadline:
            raise TimeoutError(f"no result in {path} after {timeout_s:g} s")
        time.sleep(poll_s)


def cached(spark: SparkSession, base: str, settings: dict[str, Any], build: Callable[[], DataFrame], force: bool = False, enabled: bool = True, builder: bool = True, timeout_s: float = WAIT_S, poll_s: float = POLL_S) -> tuple[DataFrame, str]:
    """The materialised result of `build` for these settings, and why it was built or used. The caller that gets the
    lock builds; the others, and those with `builder` off, wait for it (if it fails, the next one takes over)."""
    settings = {"version": VERSION} | settings
    path = location(base, settings)
    why = decide(spark, path, settings, force, enabled)
    if why == "disabled":
        return build(), why
    if why != "hit":
        old = (read_manifest(spark, path) or {}).get("data") if why == "forced" else None
        deadline = time.monotonic() + timeout_s
        while True:
            if builder and _claim(spark, path, timeout_s):
                try:
                    # Between the look and the lock another may have published.
                    if why == "forced" or decide(spark, path, settings) != "hit":
                        publish(build(), path, settings)
                finally:
                    fs, lock = _fs(spark, f"{path}/.builder")
                    fs.delete(lock, False)
                break
            try:
                wait(spark, path, settings, min(poll_s, max(0.0, deadline - time.monotonic())), poll_s, old)
                break
            except TimeoutError:
                if time.monotonic() >= deadline:
                    raise TimeoutError(f"no result in {path} after {timeout_s:g} s") from None
    return spark.read.parquet(data_path(path, read_manifest(spark, path))), why

"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings sft_merged raw_records "
    "instances rollouts repair_audit repos heldout_ids size_limits mix_targets"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName("trailmill")
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_trailmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="trailmill-")  # the driver serves the file from there as long as it lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder, "trailmill.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._trailmill_shipped = True


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`mapInArrow` by a function of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def map_pandas(df: DataFrame, function: Callable, schema) -> DataFrame:
    """`mapInPandas` by a function of this package."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, for costly work on each row: over all cores if it is read in fewer parts than there are cores (a small
    table in one file), else as it is. Plans with exchanges keep what these make of them."""
    execution, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in execution.executedPlan().nodeName() or execution.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


_OWN: list[str] = []
_SCRATCH: list[str] = []


def _own_folder(spark: SparkSession) -> str:
    """A folder of this process for local sessions that name none; it goes with the process. Executors elsewhere could
    not read it, so other sessions have to name one."""
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
    if not _OWN:
        folder = tempfile.mkdtemp(prefix="trailmill-checkpoints-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN.append(Path(folder).as_uri())
    return _OWN[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share: the one the session names in
    ``spark.checkpoint.dir``; only where a local session sets none a temporary one is made."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir() or _own_folder(spark)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage, so that a lost executor costs a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a table that several jobs read."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Removes the checkpoints and scratch tables of this session from the shared folder; results that were read from
    them can't be read any more. Sessions with ``spark.cleaner.referenceTracking.cleanCheckpoints`` also drop a
    checkpoint when nothing refers to it any longer."""
    sc = spark.sparkContext
    for path in [*_SCRATCH, *filter(None, [sc.getCheckpointDir()])]:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    _SCRATCH.clear()

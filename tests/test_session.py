from types import SimpleNamespace

import pytest

from trailmill import session as S


def test_clusters_must_name_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            S._own_folder(SimpleNamespace(sparkContext=SimpleNamespace(master=master)))
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert S._own_folder(SimpleNamespace(sparkContext=SimpleNamespace(master=master))).startswith("file:")


def test_scratch_tables_are_removed(spark):
    path = S.scratch_path(spark, "x")
    spark.range(2).write.parquet(path)
    assert spark.read.parquet(path).count() == 2
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    before, S._SCRATCH[:] = S._SCRATCH[:-1], [path]
    kept = spark.sparkContext.getCheckpointDir()
    S.clean(spark)
    assert not fs.exists(at) and S._SCRATCH == []
    S._SCRATCH[:] = before
    fs.mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept))


def test_small_tables_are_spread_and_others_left(spark):
    one, many = spark.range(100).coalesce(1), spark.range(0, 100, 1, 64)
    assert S.spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.id for r in S.spread(one, "id").collect()) == list(range(100))
    assert S.spread(many, "id") is many
    shuffled = one.groupBy("id").count()
    assert S.spread(shuffled, "id") is shuffled

"""Tables read as streams, and streaming aggregates run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path, table


def streamed(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table of a scale directory as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    # As a pattern the path may be a single file or a folder of files.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def run_complete(aggregate: DataFrame) -> DataFrame:
    """The result of a streaming aggregate over all that is there, as a table in the shared folder. Every batch replaces
    the result of the one before, so a batch that is done again does no harm."""
    spark = aggregate.sparkSession
    out = scratch_path(spark, "stream")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    query = aggregate.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(aggregate.schema).parquet(f"{out}/data")


def run_append(rows: DataFrame) -> DataFrame:
    """What a stream in append mode gives over all that is there, as a table in the shared folder; the sink's log keeps a
    batch that is done again from being written twice."""
    spark = rows.sparkSession
    out = scratch_path(spark, "stream")
    rows.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/data")

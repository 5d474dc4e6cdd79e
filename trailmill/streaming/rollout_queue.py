"""The rollout queue as files and streams: jobs in one folder, results in another.

Delivery is at least once. Of the results of a job that come at or after its creation and within the deadline the last
counts (ties by the greater reward, then error), whatever came before or after them; every job comes out exactly once,
when the watermark has passed its deadline, with null results if none counted. Results of unknown jobs are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

JOB = "job_id string, payload string, created_at timestamp"
RESULT = "job_id string, reward int, error string, result_at timestamp"


def enqueue(jobs: DataFrame, folder: str) -> None:
    """Appends jobs (payload); ids and times are assigned."""
    jobs.select(F.expr("uuid()").alias("job_id"), "payload", F.current_timestamp().alias("created_at")).write.mode("append").json(folder)


def jobs(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The stream of jobs, oldest files first."""
    return spark.readStream.schema(JOB).option("maxFilesPerTrigger", files_per_batch).json(folder)


def results(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RESULT).json(folder)


def correlate(job_stream: DataFrame, result_stream: DataFrame, deadline: str = "2 hours", lateness: str = "10 minutes") -> DataFrame:
    """(job_id, created_at, reward, error, result_at): one row for each job.

    A left outer join within the deadline, then the last of each job's results; the watermarks of both sides bound the
    state of the join and of the aggregate. Conditions come before the choice, so a result that does not count never
    hides one that does.
    """
    left = job_stream.select("job_id", "created_at").withWatermark("created_at", lateness).alias("j")
    # The time that is returned is a copy: the aggregate below may see one event time only.
    right = result_stream.withColumn("seen_at", F.expr("result_at + INTERVAL '0' SECOND")).withWatermark("result_at", lateness).alias("r")
    on = F.expr(f"j.job_id = r.job_id AND r.result_at >= j.created_at AND r.result_at <= j.created_at + INTERVAL {deadline}")
    joined = left.join(right, on, "left_outer").select("j.job_id", "j.created_at", "r.reward", "r.error", "r.seen_at")
    last = F.max_by(F.struct("reward", "error", "seen_at"), F.when(F.col("seen_at").isNotNull(), F.struct("seen_at", "reward", "error")))
    return joined.groupBy("job_id", "created_at").agg(last.alias("r")).select("job_id", "created_at", "r.reward", "r.error", F.col("r.seen_at").alias("result_at"))


def work(job_stream: DataFrame, runner: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Pulls jobs batch by batch and appends what the runner makes of them (RESULT) to the results folder, one folder a
    batch, so a batch that is done again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        runner(batch).write.mode("overwrite").json(f"{out}/batch={number:08d}")

    return job_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def step_snapshots(rollouts: DataFrame, every: int, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Metrics by step (rollouts, mean reward, resolved) so far, handed on for every `every`-th step."""
    metrics = rollouts.groupBy("step").agg(F.count("*").alias("rollouts"), F.avg("reward").alias("mean_reward"), F.count_if(F.col("reward") >= 1).alias("resolved"))

    def run(batch: DataFrame, number: int) -> None:
        write(batch.where(F.col("step") % every == 0), number)

    return metrics.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

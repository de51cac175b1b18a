"""The best-plan cache over a stream of executions: each batch is merged into a table, and repeated batches change nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bgpforge.operators import feedback


def merge_best(spark: SparkSession, path: str):
    """A foreachBatch function: version n of the table is version n - 1 merged with batch n."""

    def merge(batch: DataFrame, n: int) -> None:
        best = feedback.best_plans(batch)
        if n > 0:
            best = spark.read.parquet(f"{path}/version={n - 1}").unionByName(best)
        best.groupBy("query_id", "plan_id").agg(F.min(F.struct("latency", "seq")).alias("b")).select("query_id", "plan_id", "b.latency", "b.seq").write.mode("overwrite").parquet(f"{path}/version={n}")

    return merge


def windowed_latency(log: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Latency by window of event time; rows later than the watermark are dropped."""
    return log.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n"), F.avg("latency").alias("mean"))

"""Training runs as a table partitioned by epoch, and the last and best epochs of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_epoch(rows: DataFrame, path: str, epoch: int) -> None:
    """Write an epoch's rows under `epoch=N`; a rerun of the epoch replaces them, other epochs stay."""
    rows.write.mode("overwrite").parquet(f"{path}/epoch={int(epoch)}")


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a run with their epoch (long)."""
    rows = spark.read.parquet(path)
    return rows.withColumn("epoch", F.col("epoch").cast("long"))


def last_epoch(run: DataFrame) -> int | None:
    """The largest epoch of a run, None where it has none."""
    return run.agg(F.max("epoch")).first()[0]


def best_epoch(run: DataFrame, metric: str, smaller_is_better: bool = True) -> int | None:
    """The epoch with the best mean of a metric; ties take the later epoch, epochs without a value none."""
    means = run.groupBy("epoch").agg(F.avg(metric).alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    order = F.struct((-F.col("value") if smaller_is_better else F.col("value")).alias("v"), "epoch")
    return means.agg(F.max_by("epoch", order)).first()[0]

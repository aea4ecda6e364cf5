"""The stored form of snapshots: Parquet, one folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.session import COMPRESSION

# Rows lie sorted by these inside a day, so row-group statistics prune a store or a
# product without one folder per store.
CLUSTER = ["snapshot_date", "store_id", "product_id"]


def with_day(observations: DataFrame) -> DataFrame:
    return observations.withColumn("snapshot_date", F.to_date("scraped_at"))


def write_observations(observations: DataFrame, path: str, mode: str = "append") -> None:
    """Range partitions give each day files of even size, also where a store is large."""
    (
        with_day(observations)
        .repartitionByRange(*CLUSTER)
        .sortWithinPartitions(*CLUSTER)
        .write.mode(mode)
        .partitionBy("snapshot_date")
        .parquet(path, compression=COMPRESSION)
    )


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

"""Snapshot documents arriving as files, appended to the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrina.sources.snapshots import (
    SnapshotTables,
    parse_documents,
    snapshot_tables,
    with_file_columns,
)

PARSED = "parsed"


def arriving_documents(spark: SparkSession, path: str, max_files: int = 10_000) -> DataFrame:
    """Stream of new files under `path`/<store>/, one document each."""
    raw = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(path)
    )
    return with_file_columns(raw)


def append_arrivals(documents: DataFrame, store: str, marks: str) -> StreamingQuery:
    """Parsed documents of the files that are there, each file once and parsed once.

    One table holds their headers and their products, with the file sink's exactly-once
    guarantee, and lies by the day the files came in.
    """
    parsed = parse_documents(documents).withColumn("arrived_on", F.current_date())
    return (
        parsed.writeStream.partitionBy("arrived_on")
        .format("parquet")
        .option("checkpointLocation", f"{marks}/{PARSED}")
        .trigger(availableNow=True)
        .start(f"{store}/{PARSED}")
    )


def stored_snapshots(spark: SparkSession, store: str) -> SnapshotTables:
    """The tables to compare. Snapshots are numbered here, whatever order they came in."""
    return snapshot_tables(spark.read.parquet(f"{store}/{PARSED}").drop("arrived_on"))

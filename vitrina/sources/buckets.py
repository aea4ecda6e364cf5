"""Tables stored by the hash of some columns.

Rows with the same hash are in one file, so joins and groupings on those columns, or on these
and further ones, read the files and exchange nothing. Two tables meet so if they are bucketed
by the same columns into as many files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from vitrina.session import COMPRESSION, scratch_path


def bucket_width(spark: SparkSession) -> int:
    """As many files as a shuffle has partitions: one task reads one file."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed_table(
    df: DataFrame, name: str, keys: Sequence[str], order: Sequence[str] = (), buckets: int | None = None, dealt: bool = False
) -> DataFrame:
    """The rows as files in the shared folder, written now and read back.

    With `dealt` the rows already lie by the hash of `keys` in as many partitions, as those
    that come from tables stored so; otherwise they are dealt first, which makes one file a bucket.
    """
    spark = df.sparkSession
    buckets = buckets or bucket_width(spark)
    rows = df if dealt else df.repartition(buckets, *keys)
    table = f"vitrina_{name}_{uuid.uuid4().hex[:12]}"
    writer = rows.write.format("parquet").options(path=scratch_path(spark, name), compression=COMPRESSION)
    writer = writer.bucketBy(buckets, *keys)
    if order:
        writer = writer.sortBy(*order)
    writer.saveAsTable(table)
    stored = spark.table(table)
    # the files stay, and the frame knows them; only the name goes
    spark.sql(f"DROP TABLE {table}")
    return stored

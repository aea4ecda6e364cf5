"""Store snapshots derived from `lineitem` and `part`.

One row per part and calendar quarter with sales. A part belongs to one of twenty
stores; a store's quarters are its snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrina.operators.pairing import number_snapshots
from vitrina.session import COMPRESSION, joined_in_place, scratch_path

# Parts of a store's snapshot: one per 10,000 part keys, so 500 products at most.
PART_KEYS = 10_000
SHELF = ["store_id", "part"]

_built: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived tables are written to the shared folder once per application and read
    back, as the engine's stored observations are."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = scratch_path(spark, name)
        build().write.parquet(path, compression=COMPRESSION)
        _built[key] = path
    return spark.read.parquet(_built[key])


def _placed(rows: DataFrame) -> DataFrame:
    """With the store and the numbered part that a product's documents are of."""
    return rows.withColumns(
        {
            "store_id": (F.col("pid") % 20).cast("string"),
            "part": (F.col("pid") / PART_KEYS).cast("bigint"),
        }
    )


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by store and part before anything is summed: the running sums, the names and the
    documents that are gathered from these rows need no further exchange."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("pid"),
        F.date_trunc("quarter", "l_shipdate").alias("scraped_at"),
        "l_quantity",
        "l_extendedprice",
    )
    return (
        _placed(line)
        .repartition(*SHELF)
        .groupBy(*SHELF, "pid", "scraped_at")
        .agg(
            F.sum("l_quantity").cast("bigint").alias("qty"),
            F.max("l_quantity").cast("bigint").alias("mq"),
            F.count(F.lit(1)).alias("n"),
            F.min("l_extendedprice").cast("decimal(18,2)").alias("price"),
        )
    )


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    store = F.col("l_partkey") % 20
    seen = line.select(
        store.alias("store"), F.date_trunc("quarter", "l_shipdate").alias("scraped_at")
    ).distinct()
    platform = (
        F.when(F.col("store") % 5 == 0, "shopify")
        .when(F.col("store") % 2 == 0, "tiendanube")
        .otherwise("generic")
    )
    return number_snapshots(
        seen.select(
            F.col("store").cast("string").alias("store_id"),
            F.concat_ws("-", "store", F.date_format("scraped_at", "yyyyMMdd")).alias(
                "source_file"
            ),
            "scraped_at",
            F.concat(F.lit("Brand "), F.col("store").cast("string")).alias("brand"),
            platform.alias("platform"),
            F.when(F.col("store") % 5 == 0, "USD").otherwise("ARS").alias("currency"),
        )
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_once(spark, sf_dir, "snapshots", lambda: _snapshots(spark, sf_dir))


def shelved_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations with their document's part, as rows that lie by SHELF when planned in place."""
    store = F.col("pid") % 20
    numbered = store % 5 != 0
    counted = numbered & (store % 2 == 0) & (F.col("pid") % 7 != 0)
    # some counters restart every calendar year; a product has one row per quarter
    run = F.when(F.col("pid") % 11 == 0, F.year("scraped_at"))
    so_far = Window.partitionBy(*SHELF, "pid", run).orderBy("scraped_at")
    rows = _quarters(spark, sf_dir).select(
        *SHELF,
        "pid",
        F.col("pid").cast("string").alias("product_id"),
        F.col("pid").alias("pos"),
        "scraped_at",
        "price",
        F.when(numbered, F.greatest(F.col("mq") - 10, F.lit(0))).alias("stock"),
        F.when(counted, F.sum("qty").over(so_far)).alias("sold_qty"),
        F.when(numbered, F.col("mq") > 10).otherwise(F.col("n") % 2 == 1).alias("available"),
    )
    names = _placed(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), F.col("p_name").alias("name"))
    )
    order = snapshots(spark, sf_dir).select("store_id", "scraped_at", "snap_ord")
    return rows.join(names, [*SHELF, "pid"]).join(order, ["store_id", "scraped_at"]).drop("pid")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with joined_in_place(spark):
        return written_once(
            spark, sf_dir, "observations", lambda: shelved_observations(spark, sf_dir).drop("part")
        )


def repeated_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item, so that product ids repeat inside a snapshot."""
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 20).cast("string").alias("store_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.date_trunc("quarter", "l_shipdate").alias("scraped_at"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_quantity").cast("bigint").alias("stock"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("sold_qty"),
    )
    order = snapshots(spark, sf_dir).select("store_id", "scraped_at", "snap_ord")
    return rows.join(order, ["store_id", "scraped_at"])

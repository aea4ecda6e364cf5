"""Saving a catalog as a dated snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.dates import output_name
from vitrina.functions.text import blank_to_null
from vitrina.operators.catalog import catalog_order, catalog_summary
from vitrina.operators.ordering import rank_within
from vitrina.operators.rows import join_stores

SNAPSHOT_KIND = "Catalog"
REPORT_KIND = "Sales"
DEFAULT_PLATFORM = "tiendanube"
# A document holds at most this many products; a larger store gets several parts.
DOCUMENT_PRODUCTS = 10_000


def _narrow_variants() -> Column:
    return F.transform(
        "variants",
        lambda v: F.struct(*[v[name].alias(name) for name in ("size", "stock", "sku")]),
    )


def compact_products(products: DataFrame) -> DataFrame:
    """The columns a comparison needs: no descriptions, no images, narrow variants."""
    return products.select(
        "store_id",
        "pos",
        F.col("id").alias("product_id"),
        "name",
        "brand",
        "price",
        F.col("stock_total").alias("stock"),
        "sold_qty",
        "available",
        _narrow_variants().alias("variants"),
    )


def snapshot_name() -> Column:
    return output_name(SNAPSHOT_KIND, F.col("brand"), F.col("scraped_at")).alias("snapshot_id")


def snapshot_headers(stores: DataFrame, products: DataFrame) -> DataFrame:
    """`stores(store_id, brand, platform, source, scraped_at)` with name and summary."""
    return stores.join(catalog_summary(products), "store_id").select(
        "store_id",
        snapshot_name(),
        "brand",
        F.coalesce(blank_to_null(F.col("platform")), F.lit(DEFAULT_PLATFORM)).alias("platform"),
        "source",
        "currency",
        "scraped_at",
        "products",
        "stock_total",
        "stock_known",
        "min_price",
        "max_price",
    )


def snapshot_rows(stores: DataFrame, products: DataFrame) -> DataFrame:
    """Product rows of a new snapshot, for the Parquet table."""
    names = stores.select("store_id", snapshot_name(), "scraped_at")
    return join_stores(compact_products(products), names, ["product_id"])


def snapshot_documents(
    stores: DataFrame, products: DataFrame, max_products: int = DOCUMENT_PRODUCTS
) -> DataFrame:
    """One JSON document per store, or several parts of bounded size.

    Products keep catalog order across the parts. How many parts a store has follows from its
    number of products, so they are ranked once.
    """
    order = catalog_order()
    columns = "store_id pos id url name brand price stock_total sold_qty available variants"
    ranked = rank_within(
        products.select(*columns.split()), ["store_id"], order, "place"
    ).withColumn("part", F.floor((F.col("place") - 1) / max_products))
    item = F.struct(
        "place",
        F.col("id"),
        "name",
        "brand",
        "price",
        F.col("stock_total").alias("stock"),
        F.col("sold_qty").alias("soldQty"),
        "available",
        _narrow_variants().alias("variants"),
    )
    parts = ranked.groupBy("store_id", "part").agg(
        F.transform(
            F.array_sort(F.collect_list(item)), lambda p: p.dropFields("place")
        ).alias("products")
    )
    document = F.to_json(
        F.struct(
            "platform",
            "brand",
            "source",
            "currency",
            F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("scrapedAt"),
            F.struct(
                F.col("stock_total").alias("stockTotal"),
                F.col("stock_known").alias("stockKnown"),
                F.col("min_price").alias("minPrice"),
                F.col("max_price").alias("maxPrice"),
            ).alias("summary"),
            "products",
        ),
        {"ignoreNullFields": "false"},
    )
    suffix = F.when(F.col("part") > 0, F.format_string(".part%05d", F.col("part")))
    name = F.concat("snapshot_id", F.coalesce(suffix, F.lit("")), F.lit(".json"))
    # headers meet the documents part by part, so one store's documents stay spread
    every_part = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_products") - 1) / max_products))
    headers = snapshot_headers(stores, products).withColumnRenamed("products", "n_products")
    headers = headers.withColumn("part", F.explode(every_part))
    return parts.join(headers, ["store_id", "part"]).select(
        "store_id", "snapshot_id", "scraped_at", name.alias("source_file"), document.alias("body")
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents as rows of a Parquet table by day, each with its name in a column.

    `load_snapshots` takes the table back as it is, or a day of it.
    """
    by_day = documents.withColumn("snapshot_date", F.to_date("scraped_at"))
    by_day.write.mode("append").partitionBy("snapshot_date").parquet(path)


def write_document_files(documents: DataFrame, path: str) -> None:
    """One JSON text file per document, in a folder named after the document.

    For handing single documents out; `write_documents` is the form for many.
    """
    (
        documents.select("store_id", "source_file", "body")
        .write.mode("append")
        .partitionBy("store_id", "source_file")
        .text(path)
    )

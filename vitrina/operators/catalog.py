"""Catalogs of many stores in one product table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions import labels
from vitrina.functions.money import price_label
from vitrina.functions.pages import GENERIC, platform_sign
from vitrina.functions.text import blank_to_null, truncate
from vitrina.operators.adapters import ADAPTERS
from vitrina.operators.ordering import first_n
from vitrina.operators.rows import join_stores

GRID_DESCRIPTION = 150
MIN_VOTES = 5


def classify_pages(pages: DataFrame) -> DataFrame:
    """Adds the platform each page gives away, `generic` when none."""
    return pages.withColumn(
        "platform", F.coalesce(platform_sign(F.col("html")), F.lit(GENERIC))
    )


def union_catalogs(products: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), products)


def build_catalog(captures: dict[str, DataFrame]) -> DataFrame:
    """One product table from the captures of each platform."""
    return union_catalogs([ADAPTERS[name](df) for name, df in captures.items()])


def feed_or_pages(feed_products: DataFrame, page_products: DataFrame) -> DataFrame:
    """Feed products; stores whose feed gave none use what their pages say."""
    served = feed_products.select("store_id").distinct()
    unserved = join_stores(page_products, served, ["url"], "left_anti")
    return feed_products.unionByName(unserved)


def first_products(products: DataFrame, limit: int) -> DataFrame:
    """The first products of each store in capture order."""
    order = [F.col("pos").asc_nulls_last(), F.col("url"), F.col("id")]
    return first_n(products, ["store_id"], order, limit).drop("rank")


def catalog_order() -> list[Column]:
    """Available first, then by name; the rest only settles ties."""
    return [F.col("available").desc(), F.col("name"), F.col("pos"), F.col("url"), F.col("id")]


def listing(products: DataFrame) -> DataFrame:
    """The whole catalog sorted; range partitions split a large store."""
    return products.orderBy("store_id", *catalog_order())


def capture_place() -> Column:
    """Order of a store's products: feed position, or address for pages."""
    return F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), F.col("url"))


def catalog_currency(products: DataFrame) -> DataFrame:
    """First currency a store's products name.

    Nearly every store names one, which a distinct list shows. Only the products of
    the others are put in order.
    """
    named = products.where(F.col("currency").isNotNull())
    counted = (
        named.select("store_id", "currency")
        .distinct()
        .groupBy("store_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min("currency").alias("currency"))
    )
    mixed = counted.where(F.col("n") > 1).select("store_id")
    first = (
        join_stores(named.select("store_id", "currency", "pos", "url"), mixed, ["url"])
        .groupBy("store_id")
        .agg(F.min_by("currency", capture_place()).alias("currency"))
    )
    return counted.where(F.col("n") == 1).select("store_id", "currency").unionByName(first)


def catalog_summary(products: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """One row per store. Unknown stock stays unknown: the total is null without any.

    With `stores(store_id, source)` the address that the catalog was taken from, too.
    """
    numbers = products.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("products"),
        F.sum("stock_total").alias("stock_total"),
        F.count("stock_total").alias("stock_known"),
        F.count_if("available").alias("available_n"),
        F.count_if(~F.coalesce("available", F.lit(False))).alias("sold_out_n"),
        F.min(F.coalesce("min_price", "price")).alias("min_price"),
        F.max(F.coalesce("max_price", "price")).alias("max_price"),
    )
    summary = numbers.join(catalog_currency(products), "store_id", "left")
    return summary if stores is None else summary.join(stores.select("store_id", "source"), "store_id", "left")


def majority_brand(products: DataFrame) -> DataFrame:
    """Most frequent product brand per store, the first seen winning ties."""
    votes = products.groupBy("store_id", F.col("brand").alias("top_brand")).agg(
        F.count(F.lit(1)).alias("votes"), F.min(capture_place()).alias("seen")
    )
    # the least of (-votes, place) is the brand with most votes, then the earliest
    named = blank_to_null(F.col("top_brand")).isNotNull()
    best = F.when(named, F.struct((-F.col("votes")).alias("n"), F.col("seen")))
    return votes.groupBy("store_id").agg(
        F.min_by("top_brand", best).alias("top_brand"),
        F.max(F.when(named, F.col("votes"))).alias("votes"),
        F.sum("votes").alias("products"),
    )


def store_brands(stores: DataFrame, products: DataFrame) -> DataFrame:
    """`stores(store_id, brand)` with the catalog's own brand where it clearly is one:
    at least five products and half the catalog carry it, and it is shorter."""
    half = F.greatest(F.lit(MIN_VOTES), F.col("products") / 2)
    wins = (F.col("votes") >= half) & (F.length("top_brand") < F.length("brand"))
    return stores.join(majority_brand(products), "store_id", "left").select(
        "store_id",
        F.when(wins, F.col("top_brand")).otherwise(F.col("brand")).alias("brand"),
        "top_brand",
        "votes",
    )


def grid(products: DataFrame, lang: str = "es") -> DataFrame:
    """What the catalog listing shows for each product."""
    price = labels.price_range_label(
        F.col("min_price"), F.col("max_price"), F.col("price_short"), F.col("price"), lang
    )
    return products.select(
        "store_id",
        "id",
        "name",
        price.alias("price_label"),
        labels.stock_badge(F.col("available"), F.col("stock_total")).alias("badge"),
        labels.category_path(F.col("crumbs"), F.col("name"), False, lang).alias("category"),
        labels.category_path(F.col("crumbs"), F.col("name"), True, lang).alias("full_category"),
        truncate(F.col("description"), GRID_DESCRIPTION).alias("summary"),
    )


def variant_detail(products: DataFrame, lang: str = "es") -> DataFrame:
    """One row per variant; products without variants have none."""
    return products.select(
        "store_id", "id", "price", F.posexplode("variants").alias("place", "v")
    ).select(
        "store_id",
        "id",
        "place",
        F.col("v.size").alias("size"),
        F.coalesce(blank_to_null(F.col("v.sku")), F.lit("—")).alias("sku"),
        F.col("v.stock").alias("stock"),
        labels.variant_is_out(F.col("v.stock")).alias("is_out"),
        F.col("v.available").alias("available"),
        F.coalesce(
            blank_to_null(F.col("v.price_short")), price_label(F.col("price"), lang), F.lit("—")
        ).alias("price_short"),
        F.coalesce(blank_to_null(F.col("v.promo_short")), F.lit("—")).alias("promo_short"),
        F.coalesce(blank_to_null(F.col("v.compare_short")), F.lit("—")).alias("compare_short"),
    )

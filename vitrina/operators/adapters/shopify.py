"""Shopify product feed. It publishes availability, never stock units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.money import price_label, variant_price
from vitrina.functions.pages import currency_in_storefront
from vitrina.functions.text import blank_to_null, first_chars, strip_tags
from vitrina.operators.adapters.common import (
    DEFAULT_OPTION,
    META_DESCRIPTION,
    as_products,
    feed_position,
    first_name,
    first_of,
    text_or_blank,
)
from vitrina.schemas import SHOPIFY_FEED, UNITS

UNNAMED_OPTION = "Default Title"


def _priced(variant: Column) -> Column:
    """The variant with its prices read, so that later steps reuse the numbers."""
    options = F.filter(
        F.array(variant["option1"], variant["option2"], variant["option3"]),
        lambda o: o.isNotNull() & (o != UNNAMED_OPTION),
    )
    return F.struct(
        F.coalesce(blank_to_null(F.array_join(options, " / ")), F.lit("—")).alias("size"),
        text_or_blank(variant["sku"]).alias("sku"),
        F.coalesce(variant["available"], F.lit(False)).alias("available"),
        variant_price(variant["price"]).alias("price"),
        variant_price(variant["compare_at_price"]).alias("compare"),
        blank_to_null(variant["featured_image"]["src"]).alias("image"),
    )


def _labelled(variant: Column) -> Column:
    on_sale = variant["compare"] > variant["price"]
    listed = F.when(on_sale, variant["compare"]).otherwise(variant["price"])
    return F.struct(
        variant["size"].alias("size"),
        variant["sku"].alias("sku"),
        F.lit(None).cast(UNITS).alias("stock"),
        variant["available"].alias("available"),
        price_label(listed).alias("price_short"),
        F.when(on_sale, price_label(variant["price"])).alias("promo_short"),
        F.when(on_sale, price_label(variant["compare"])).alias("compare_short"),
        F.lit(None).cast("string").alias("pay_discount_short"),
        variant["image"].alias("image"),
    )


def shopify_products(feeds: DataFrame) -> DataFrame:
    """`feeds(store_id, base, page, body[, home_html])` to products."""
    home = F.col("home_html") if "home_html" in feeds.columns else F.lit(None).cast("string")
    listed = feeds.select(
        "store_id",
        "base",
        "page",
        currency_in_storefront(home).alias("currency"),
        F.posexplode(F.from_json("body", SHOPIFY_FEED)["products"]).alias("index", "p"),
    )
    p = F.col("p")
    variants = F.coalesce(p["variants"], F.array())
    read = (
        listed.withColumn("priced", F.transform(variants, _priced))
        .withColumn("variants", F.transform("priced", _labelled))
        .withColumn("low", F.array_min(F.col("priced.price")))
        .withColumn("high", F.array_max(F.col("priced.price")))
        .withColumn("description", strip_tags(text_or_blank(p["body_html"])))
    )
    offered = F.col("variants")
    kind = blank_to_null(p["product_type"])
    return as_products(
        read,
        "shopify",
        pos=feed_position(F.col("page"), F.col("index")),
        id=p["id"],
        name=text_or_blank(p["title"]),
        brand=text_or_blank(p["vendor"]),
        url=F.concat("base", F.lit("/products/"), text_or_blank(p["handle"])),
        crumbs=F.when(kind.isNotNull(), F.array(kind)).otherwise(F.array()),
        seo_title=text_or_blank(p["title"]),
        meta_description=first_chars(F.col("description"), META_DESCRIPTION),
        description=F.col("description"),
        main_image=F.coalesce(
            blank_to_null(F.get(p["images"], 0)["src"]), first_of(offered, "image")
        ),
        price_short=F.coalesce(
            first_of(offered, "price_short"), price_label(F.col("low")), F.lit("—")
        ),
        price=F.col("low"),
        min_price=F.col("low"),
        max_price=F.col("high"),
        compare_short=first_of(offered, "compare_short"),
        promo_short=first_of(offered, "promo_short"),
        available=F.exists(F.col("priced.available"), lambda a: a),
        size_option_name=F.coalesce(first_name(p["options"]), F.lit(DEFAULT_OPTION)),
        variants=offered,
        currency=F.col("currency"),
    )

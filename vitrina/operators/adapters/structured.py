"""Any store whose product pages carry JSON-LD or Open Graph data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions import jsonld
from vitrina.functions.money import parse_price, price_label
from vitrina.functions.pages import reads_sold_out
from vitrina.functions.text import (
    blank_to_null,
    first_chars,
    last_path_segment,
    meta_tag,
    meta_tags,
    meta_value,
    strip_tags,
)
from vitrina.operators.adapters.common import (
    DEFAULT_OPTION,
    META_DESCRIPTION,
    as_products,
    no_variants,
)
from vitrina.operators.rows import keep_computed


# Meta tags read, and the columns they become.
META_KEYS = {
    "og_title": "og:title",
    "site_name": "og:site_name",
    "product_amount": "product:price:amount",
    "og_amount": "og:price:amount",
    "product_currency": "product:price:currency",
    "og_currency": "og:price:currency",
    "og_description": "og:description",
    "meta_description": "description",
}


def with_meta(pages: DataFrame) -> DataFrame:
    """Pages with a column per meta tag, null when empty.

    Each step is its own projection, so that the next one reads its result and does
    not search the page again.
    """
    tags = pages.withColumn("metas", meta_tags(F.col("html")))
    for step in (
        {name: meta_tag(F.col("metas"), key) for name, key in META_KEYS.items()},
        {name: meta_value(F.col(name), key) for name, key in META_KEYS.items()},
        {name: blank_to_null(F.col(name)) for name in META_KEYS},
    ):
        tags = tags.withColumns(step)
    return tags.drop("metas")


def structured_products(pages: DataFrame) -> DataFrame:
    """`pages(store_id, url, html)` to products; pages without a priced product drop out."""
    node, offers, prices = F.col("node"), F.col("offers"), F.col("prices")
    read = (
        with_meta(pages)
        .withColumn("nodes", jsonld.nodes(F.col("html")))
        .withColumn("listed", jsonld.nodes_of_type(F.col("nodes"), "Product"))
        .withColumn("node", jsonld.main_product(F.col("listed"), F.col("og_title")))
        .withColumn("offers", jsonld.as_list(node, "$.offers"))
        .withColumn("prices", jsonld.offer_prices(offers))
        .withColumn("og_price", parse_price(F.coalesce("product_amount", "og_amount")))
        .withColumn("low", F.coalesce(F.array_min(prices), F.col("og_price")))
        .withColumn("high", F.coalesce(F.array_max(prices), F.col("og_price")))
        .drop("listed", "prices", "og_price", "product_amount", "og_amount")
    )
    # A price alone decides: without a product node it can only come from Open Graph.
    priced = keep_computed(read, F.col("low").isNotNull())

    image = F.coalesce(jsonld.field(node, "$.image[0]"), jsonld.field(node, "$.image"))
    products = (
        priced.withColumns(
            {
                "raw_name": jsonld.text_field(node, "$.name"),
                "about": F.coalesce(
                    jsonld.text_field(node, "$.description"),
                    F.col("og_description"),
                    F.lit(""),
                ),
                "image": image,
                "title": F.regexp_extract("html", "(?i)<title>([^<]*)</title>", 1),
            }
        )
        .withColumns(
            {"name": strip_tags(F.col("raw_name")), "description": strip_tags(F.col("about"))}
        )
        .withColumn(
            "name", F.coalesce(blank_to_null(F.col("name")), "og_title", "site_name", "url")
        )
    )
    id_source = F.coalesce(
        jsonld.text_field(node, "$.productID"),
        jsonld.text_field(node, "$.sku"),
        jsonld.text_field(node, "$.offers.sku"),
        last_path_segment(F.col("url")),
    )
    return as_products(
        products,
        "generic",
        id=id_source,
        name=F.col("name"),
        brand=F.coalesce(
            jsonld.string_only(node, "$.brand"),
            jsonld.string_only(node, "$.brand.name"),
            F.lit(""),
        ),
        url=F.col("url"),
        crumbs=jsonld.breadcrumb_names(F.col("nodes")),
        seo_title=F.coalesce(blank_to_null(F.col("title")), F.col("name")),
        meta_description=first_chars(
            F.coalesce("meta_description", F.lit("")), META_DESCRIPTION
        ),
        description=F.col("description"),
        main_image=F.coalesce(
            jsonld.string_only(F.col("image"), "$"), jsonld.string_only(F.col("image"), "$.url")
        ),
        price_short=F.coalesce(price_label(F.col("low")), F.lit("—")),
        price=F.col("low"),
        min_price=F.col("low"),
        max_price=F.col("high"),
        available=F.coalesce(
            jsonld.offer_availability(offers), ~reads_sold_out(F.col("html"))
        ),
        size_option_name=F.lit(DEFAULT_OPTION),
        variants=no_variants(),
        currency=F.coalesce(
            jsonld.offer_currency(offers), F.col("product_currency"), F.col("og_currency")
        ),
    )

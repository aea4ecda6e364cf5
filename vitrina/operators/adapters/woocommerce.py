"""WooCommerce store feed. Prices are whole minor units; variants are not listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.money import minor_unit_price, price_label
from vitrina.functions.text import blank_to_null, first_chars, strip_tags
from vitrina.operators.adapters.common import (
    DEFAULT_OPTION,
    META_DESCRIPTION,
    as_products,
    feed_position,
    first_name,
    no_variants,
    text_or_blank,
)
from vitrina.schemas import WOOCOMMERCE_FEED


def woocommerce_products(feeds: DataFrame) -> DataFrame:
    """`feeds(store_id, base, page, body)` to products."""
    listed = feeds.select(
        "store_id",
        "base",
        "page",
        F.posexplode(F.from_json("body", WOOCOMMERCE_FEED)).alias("index", "p"),
    )
    p, prices = F.col("p"), F.col("p.prices")
    unit = prices["currency_minor_unit"]
    about = F.coalesce(
        blank_to_null(p["short_description"]), blank_to_null(p["description"]), F.lit("")
    )
    read = listed.withColumns(
        {
            "list_price": minor_unit_price(prices["price"], unit),
            "regular": minor_unit_price(prices["regular_price"], unit),
            "sale": minor_unit_price(prices["sale_price"], unit),
            "range_low": minor_unit_price(prices["price_range"]["min_amount"], unit),
            "range_high": minor_unit_price(prices["price_range"]["max_amount"], unit),
            "title": strip_tags(text_or_blank(p["name"])),
            "description": strip_tags(about),
        }
    )
    ranged = prices["price_range"].isNotNull()
    low = F.when(ranged, F.col("range_low")).otherwise(F.col("list_price"))
    high = F.when(ranged, F.col("range_high")).otherwise(F.col("list_price"))
    on_sale = p["on_sale"] & (F.col("sale") < F.col("regular"))
    low_stock = p["low_stock_remaining"]
    return as_products(
        read,
        "woocommerce",
        pos=feed_position(F.col("page"), F.col("index")),
        id=p["id"],
        name=F.col("title"),
        brand=F.coalesce(first_name(p["brands"]), F.lit("")),
        url=F.coalesce(blank_to_null(p["permalink"]), F.col("base")),
        crumbs=F.coalesce(p["categories"]["name"], F.array()),
        seo_title=F.col("title"),
        meta_description=first_chars(F.col("description"), META_DESCRIPTION),
        description=F.col("description"),
        main_image=blank_to_null(F.get(p["images"], 0)["src"]),
        price_short=F.coalesce(
            price_label(F.when(on_sale, F.col("regular")).otherwise(low)), F.lit("—")
        ),
        price=low,
        min_price=low,
        max_price=high,
        compare_short=F.when(on_sale, price_label(F.col("regular"))),
        promo_short=F.when(on_sale, price_label(F.col("sale"))),
        stock_total=F.when(~F.isnan(low_stock), low_stock),
        available=F.coalesce(p["is_in_stock"], F.lit(False)),
        size_option_name=F.coalesce(first_name(p["attributes"]), F.lit(DEFAULT_OPTION)),
        variants=no_variants(),
        currency=blank_to_null(prices["currency_code"]),
    )

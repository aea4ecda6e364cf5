"""What a catalog listing prints for one product."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.money import price_or_dash
from vitrina.functions.text import blank_to_null

HOME = {"es": "Inicio", "en": "Home"}


def price_range_label(
    low: Column, high: Column, short: Column, price: Column, lang: str = "es"
) -> Column:
    span = F.concat(price_or_dash(low, lang), F.lit(" – "), price_or_dash(high, lang))
    return F.when(low != high, span).otherwise(
        F.coalesce(blank_to_null(short), price_or_dash(price, lang))
    )


def category_path(crumbs: Column, name: Column, with_home: bool, lang: str = "es") -> Column:
    home = F.lit(HOME[lang])
    parts = F.when(F.size(crumbs) > 0, crumbs).otherwise(F.array(home))
    full = F.concat(parts, F.array(F.coalesce(name, F.lit(""))))
    return F.concat_ws(" › ", full if with_home else F.array_remove(full, home))


def stock_badge(available: Column, stock: Column) -> Column:
    units = F.regexp_replace(stock.cast("string"), r"\.0+$", "")
    gone = ~F.coalesce(available, F.lit(False))
    return (
        F.when(gone & stock.isNull(), "soldOut")
        .when(gone, "outOfStock")
        .when(stock.isNull(), "available")
        .otherwise(F.concat(F.lit("Stock: "), units))
    )


def variant_is_out(stock: Column) -> Column:
    return F.coalesce(stock, F.lit(0)) == 0

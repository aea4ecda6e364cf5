"""Pieces the adapters share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.text import blank_to_null
from vitrina.schemas import PRICE, PRODUCT_COLUMNS, UNITS, VARIANTS_TYPE

META_DESCRIPTION = 300
DEFAULT_OPTION = "Variante"

_TYPES = {
    "pos": "bigint",
    "crumbs": "array<string>",
    "price": PRICE,
    "min_price": PRICE,
    "max_price": PRICE,
    "stock_total": UNITS,
    "sold_qty": UNITS,
    "available": "boolean",
    "variants": VARIANTS_TYPE,
}

# Products per feed page stay far below this, so page and index make one position.
PAGE_STRIDE = 1 << 20


def feed_position(page: Column, index: Column) -> Column:
    return page.cast("bigint") * PAGE_STRIDE + index


def no_variants() -> Column:
    return F.array().cast(VARIANTS_TYPE)


def first_of(variants: Column, field: str) -> Column:
    """First value any variant has for a field."""
    return F.get(F.filter(variants[field], lambda v: v.isNotNull()), 0)


def text_or_blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def as_products(df: DataFrame, platform: str, **columns: Column) -> DataFrame:
    """The common product row; a column the platform does not publish is null."""
    columns = {"store_id": F.col("store_id"), "platform": F.lit(platform), **columns}
    return df.select(
        *[
            columns.get(name, F.lit(None)).try_cast(_TYPES.get(name, "string")).alias(name)
            for name in PRODUCT_COLUMNS
        ]
    )


def first_name(named: Column) -> Column:
    """Name of the first element of an array of structs."""
    return blank_to_null(F.get(named, 0)["name"])

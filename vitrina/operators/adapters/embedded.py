"""Tienda Nube product pages, which embed the product and its variants as script data."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrina.functions.media import resolve_image
from vitrina.functions.money import drop_zero_cents, price_or_dash
from vitrina.functions.pages import currency_in_structured_data
from vitrina.functions.text import (
    blank_to_null,
    decode_entities,
    drop_first,
    strip_tags,
    trim,
)
from vitrina.operators.adapters.common import as_products, first_name, first_of, text_or_blank
from vitrina.schemas import EMBEDDED_PRODUCT, EMBEDDED_VARIANTS, UNITS

# Send the page cutter itself to the executors, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Marks around the embedded data.
PRODUCT_MARK = "LS.product ="
VARIANTS_MARK = "LS.variants = ["
CRUMBS_MARK = "BreadcrumbList"
BLOCK_END = "</script"
OPTION_NAME = "Talle"

# The elements of a list in script data, which may hold lists of their own.
LIST_ITEMS = r'"itemListElement"\s*:\s*\[((?:[^\[\]]++|\[[^\[\]]*+\])*+)\]'

_STRUCTURE = re.compile(r"""["'{}\[\]]""")
_QUOTED = {q: re.compile(rf"[^{q}\\]*(?:\\.[^{q}\\]*)*{q}", re.DOTALL) for q in "\"'"}
_DIV = re.compile(r"<(/?)div\b[^>]*>", re.IGNORECASE)
_DESCRIPTION = re.compile(r"<div[^>]*product-description[^>]*>", re.IGNORECASE)

PIECES = ["product_id", "product_json", "variants_json", "description_html"]
PIECES_TYPE = T.StructType([T.StructField(name, T.StringType()) for name in PIECES])


def bracketed(text: str, start: int) -> str | None:
    """The bracketed block opening at `start`; brackets inside quotes do not count."""
    if start < 0:
        return None
    depth, at = 0, start
    while match := _STRUCTURE.search(text, at):
        mark, at = match.group(), match.end()
        if mark in _QUOTED:
            closing = _QUOTED[mark].match(text, at)
            if closing is None:
                return None
            at = closing.end()
        else:
            depth += 1 if mark in "{[" else -1
            if depth == 0:
                return text[start:at]
    return None


def description_block(html: str) -> str | None:
    """Inside of the description element, matched by nesting depth."""
    opening = _DESCRIPTION.search(html)
    if opening is None:
        return None
    begin = html.index(">", opening.start()) + 1
    depth = 1
    for tag in _DIV.finditer(html, begin):
        depth += -1 if tag.group(1) else 1
        if depth == 0:
            return html[begin : tag.start()]
    return None


def _cut(html: str) -> tuple:
    product_id = None
    at = html.find(PRODUCT_MARK)
    if at >= 0:
        block = bracketed(html, html.find("{", at))
        stated = re.search(r"id\s*:\s*(\d+)", block, re.ASCII) if block else None
        product_id = stated.group(1) if stated else None
    if product_id is None:
        stated = re.search(r'\{"id":(\d+),"name":', html, re.ASCII)
        product_id = stated.group(1) if stated else None
    if product_id is None:
        return (None, None, None, None)
    product = bracketed(html, html.find(f'{{"id":{product_id},"name":'))
    at = html.find(VARIANTS_MARK)
    variants = bracketed(html, html.find("[", at)) if at >= 0 else "[]"
    return (product_id, product, variants, description_block(html))


@F.pandas_udf(PIECES_TYPE)
def cut_pieces(html: pd.Series) -> pd.DataFrame:
    """Cut the embedded blocks out of each page; everything else is done on columns."""
    return pd.DataFrame([_cut(page) for page in html], columns=PIECES)


# Keeps the optimizer from pushing filters below the call and so making it twice.
cut_pieces = cut_pieces.asNondeterministic()


def _truthy(text: Column) -> Column:
    return F.coalesce(~text.isin("", "0", "false"), F.lit(False))


def _variant(v: Column) -> Column:
    stock_text = F.trim(v["stock"])
    stock = F.when(stock_text == "", F.lit(0)).otherwise(stock_text.try_cast(UNITS))
    promoted = _truthy(v["has_promotional_price"])
    return F.struct(
        F.coalesce(v["option0"], F.lit("—")).alias("size"),
        text_or_blank(v["sku"]).alias("sku"),
        stock.cast(UNITS).alias("stock"),
        _truthy(v["available"]).alias("available"),
        drop_zero_cents(v["price_short"]).alias("price_short"),
        F.when(promoted, drop_zero_cents(v["promotional_price_short"])).alias("promo_short"),
        drop_zero_cents(v["compare_at_price_short"]).alias("compare_short"),
        blank_to_null(v["price_with_payment_discount_short"]).alias("pay_discount_short"),
        resolve_image(v["image_url"]).alias("image"),
    )


def _crumbs(html: Column) -> Column:
    """Category names of the list with the breadcrumb mark, without the product itself.

    Names of other nodes of the same block are no categories. A list that cannot be made out
    counts up to the end of its block.
    """
    at = F.instr(html, F.lit(CRUMBS_MARK))
    span = F.when(at > 0, F.substring_index(F.substring(html, at, F.length(html)), BLOCK_END, 1))
    items = F.coalesce(blank_to_null(F.regexp_extract(span, LIST_ITEMS, 1)), span)
    names = F.regexp_extract_all(items, F.lit(r'"name"\s*:\s*"([^"]+)"'), F.lit(1))
    kept = F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0)))
    return F.coalesce(F.transform(kept, lambda n: decode_entities(trim(n))), F.array())


def embedded_products(pages: DataFrame) -> DataFrame:
    """`pages(store_id, base, url, html)` to products.

    Only pages with a product mark go through Python, and only their HTML does.
    """
    html, base = F.col("html"), F.col("base")
    marked = pages.where(html.contains(PRODUCT_MARK) | html.rlike(r'\{"id":[0-9]+,"name":'))
    strict = {"allowSingleQuotes": "false"}
    read = (
        marked.withColumn("pieces", cut_pieces(html))
        .withColumn("p", F.from_json("pieces.product_json", EMBEDDED_PRODUCT, strict))
        .withColumn("raw", F.from_json("pieces.variants_json", EMBEDDED_VARIANTS, strict))
        .where(F.col("p.id").isNotNull() & F.col("raw").isNotNull())
    )
    p = F.col("p")
    meta = trim(
        decode_entities(F.regexp_extract(html, '<meta name="description" content="([^"]*)"', 1))
    )
    read = (
        read.withColumn("variants", F.transform("raw", _variant))
        .withColumn("meta", meta)
        .withColumn("body", strip_tags(F.col("pieces.description_html")))
        .withColumn("cents", F.coalesce(p["price"], F.lit(0.0)) / 100)
        .withColumn("low", F.coalesce(F.array_min("raw.price_number"), F.col("cents")))
        .withColumn("high", F.coalesce(F.array_max("raw.price_number"), F.col("cents")))
    )
    offered = F.col("variants")
    summed = F.aggregate(
        offered["stock"],
        F.lit(0).cast("decimal(28,4)"),
        lambda total, s: (total + F.coalesce(s, F.lit(0))).cast("decimal(28,4)"),
    )
    read = read.withColumn("stock_total", F.coalesce(p["stock"].cast(UNITS), summed.cast(UNITS)))
    path = blank_to_null(p["canonical_url"])
    return as_products(
        read,
        "tiendanube",
        id=F.col("pieces.product_id"),
        name=decode_entities(text_or_blank(p["name"])),
        brand=text_or_blank(p["brand"]),
        url=F.when(path.isNotNull(), F.concat(base, drop_first(path, base))).otherwise(
            F.col("url")
        ),
        crumbs=_crumbs(html),
        seo_title=decode_entities(text_or_blank(p["seo_title"])),
        meta_description=F.col("meta"),
        description=F.when(
            F.length("body") > F.length("meta"), F.col("body")
        ).otherwise(F.col("meta")),
        main_image=F.coalesce(first_of(offered, "image"), resolve_image(p["featured_image"])),
        price_short=F.coalesce(
            first_of(offered, "price_short"), price_or_dash(F.col("low"))
        ),
        price=F.col("low"),
        min_price=F.col("low"),
        max_price=F.col("high"),
        compare_short=first_of(offered, "compare_short"),
        promo_short=first_of(offered, "promo_short"),
        pay_discount=first_of(offered, "pay_discount_short"),
        stock_total=F.col("stock_total"),
        sold_qty=p["sold_qty"],
        available=F.col("stock_total") > 0,
        size_option_name=F.coalesce(first_name(p["default_options"]), F.lit(OPTION_NAME)),
        variants=offered,
        currency=currency_in_structured_data(html),
    )

"""Structured data embedded in a page, read as VARIANT without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.money import variant_price
from vitrina.functions.text import blank_to_null, trim

# What a structured-data block looks like and what counts as available.
BLOCK = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
NAME_BEGIN = 20
AVAILABLE = "(?i)InStock|LimitedAvailability|OnlineOnly|PreOrder"


def field(node: Column, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(node, path, as_type)


def text_field(node: Column, path: str) -> Column:
    """Non-empty text, numbers included."""
    return blank_to_null(field(node, path, "string"))


def string_only(node: Column, path: str) -> Column:
    """Text when the JSON value is a string, null for any other kind."""
    value = field(node, path)
    return F.when(F.schema_of_variant(value) == "STRING", text_field(node, path))


def nodes(html: Column) -> Column:
    """All nodes of all readable blocks: arrays and `@graph` lists are flattened."""
    blocks = F.regexp_extract_all(html, F.lit(BLOCK), F.lit(1))
    parsed = F.filter(
        F.transform(blocks, lambda b: F.try_parse_json(trim(b))), lambda v: v.isNotNull()
    )
    return F.flatten(
        F.transform(
            parsed,
            lambda v: F.coalesce(
                field(v, "$", "array<variant>"),
                field(v, '$["@graph"]', "array<variant>"),
                F.array(v),
            ),
        )
    )


def is_type(node: Column, name: str) -> Column:
    one = field(node, '$["@type"]', "string") == name
    many = F.array_contains(field(node, '$["@type"]', "array<string>"), name)
    return F.coalesce(one, F.lit(False)) | F.coalesce(many, F.lit(False))


def nodes_of_type(all_nodes: Column, name: str) -> Column:
    return F.filter(all_nodes, lambda n: is_type(n, name))


def main_product(products: Column, og_title: Column) -> Column:
    """The product the page is about: related-item carousels embed products too.

    The longest name that begins the title wins, else the first whose own begin does.
    """
    title = F.lower(blank_to_null(og_title))
    name = lambda n: F.lower(text_field(n, "$.name"))
    whole = F.filter(products, lambda n: F.startswith(title, name(n)))
    longest = F.array_max(F.transform(whole, lambda n: F.length(name(n))))
    exact = F.filter(whole, lambda n: F.length(name(n)) == longest)
    begun = F.filter(products, lambda n: F.startswith(title, F.substring(name(n), 1, NAME_BEGIN)))
    return F.coalesce(F.get(exact, 0), F.get(begun, 0), F.get(products, 0))


def as_list(node: Column, path: str) -> Column:
    """The array at a path, or the single value there as a one-element array."""
    value = field(node, path)
    return F.coalesce(
        field(node, path, "array<variant>"), F.when(value.isNotNull(), F.array(value)), F.array()
    )


def offer_prices(offers: Column) -> Column:
    """Every readable price of a list of offers."""
    found = F.transform(
        offers,
        lambda o: F.array(
            variant_price(field(o, "$.price")),
            variant_price(field(o, "$.lowPrice")),
            variant_price(field(o, "$.highPrice")),
        ),
    )
    return F.array_compact(F.flatten(found))


def offer_currency(offers: Column) -> Column:
    codes = F.transform(offers, lambda o: string_only(o, "$.priceCurrency"))
    return F.get(F.array_compact(codes), 0)


def offer_availability(offers: Column) -> Column:
    """Whether any offer is available; null when no offer says."""
    stated = F.array_compact(F.transform(offers, lambda o: text_field(o, "$.availability")))
    return F.when(F.size(stated) > 0, F.exists(stated, lambda s: s.rlike(AVAILABLE)))


def breadcrumb_names(all_nodes: Column) -> Column:
    """Names of the first breadcrumb list, without the last one (the page itself)."""
    crumbs = F.get(nodes_of_type(all_nodes, "BreadcrumbList"), 0)
    items = field(crumbs, "$.itemListElement", "array<variant>")
    names = F.array_compact(
        F.transform(
            items,
            lambda it: F.coalesce(text_field(it, "$.name"), text_field(it, "$.item.name")),
        )
    )
    return F.coalesce(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.array())

"""Localised prices in and out, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.text import blank_to_null
from vitrina.schemas import PRICE

PRICE_SQL = PRICE.simpleString()


def parse_price(col: Column) -> Column:
    """Number in a price string such as "78.600", "78.600,50" or "1,299.00".

    The last separator is the decimal one when one or two characters follow it;
    otherwise every separator groups thousands.
    """
    kept = F.regexp_replace(col, r"[^0-9.,\-]", "")
    marked = F.regexp_replace(kept, "[.,]([^.,]{1,2})$", "#$1")
    plain = F.translate(F.regexp_replace(marked, "[.,]", ""), "#", ".")
    return F.regexp_extract(plain, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast(PRICE)


def variant_price(value: Column) -> Column:
    """Price held in JSON: numbers pass through, strings are read as localised."""
    kind = F.schema_of_variant(value)
    return F.when(kind == "STRING", parse_price(F.try_variant_get(value, "$", "string"))).when(
        kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, "$", PRICE_SQL)
    )


def minor_unit_price(text: Column, unit: Column) -> Column:
    """Price given as a whole number of minor units, e.g. "195" with unit 2 is 1.95."""
    number = F.trim(text).try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)
    return (number / F.pow(F.lit(10.0), F.coalesce(unit, F.lit(2)))).try_cast(PRICE)


def round_half_up(col: Column) -> Column:
    """Nearest whole number with halves going up, also below zero."""
    return F.floor(col + F.lit(0.5).cast("decimal(2,1)"))


def group_digits(whole: Column, lang: str = "es") -> Column:
    text = F.format_number(whole, 0)
    return text if lang == "en" else F.translate(text, ",", ".")


def price_label(col: Column, lang: str = "es") -> Column:
    """"$" and the rounded amount, null for an unknown price."""
    return F.concat(F.lit("$"), group_digits(round_half_up(col.try_cast(PRICE)), lang))


def price_or_dash(col: Column, lang: str = "es") -> Column:
    return F.coalesce(price_label(col, lang), F.lit("—"))


def count_label(col: Column, lang: str = "es") -> Column:
    return group_digits(F.coalesce(col, F.lit(0)), lang)


def millions_label(col: Column, lang: str = "es") -> Column:
    """Compact amount, e.g. 7647000 is "$7,65 M" (es) or "$7.65 M" (en)."""
    millions = F.round(col.cast("decimal(28,4)") / F.lit(1_000_000), 2)
    text = F.regexp_replace(F.format_number(millions, 2), r"\.?0+$", "")
    if lang != "en":
        text = F.translate(text, ",.", ".,")
    return F.concat(F.lit("$"), text, F.lit(" M"))


def drop_zero_cents(col: Column) -> Column:
    """"$94.000,00" without its ",00"; real decimals stay."""
    return blank_to_null(F.regexp_replace(col, ",00$", ""))

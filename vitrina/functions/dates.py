"""Date labels and the time stamp used in snapshot and report names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.text import slug

# Spanish month names and their short forms.
MONTHS_ES = [
    "enero",
    "febrero",
    "marzo",
    "abril",
    "mayo",
    "junio",
    "julio",
    "agosto",
    "septiembre",
    "octubre",
    "noviembre",
    "diciembre",
]
SHORT_MONTHS_ES = "ene feb mar abr may jun jul ago sep oct nov dic".split()


def _month_name(ts: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in names]), F.month(ts))


def datetime_label(ts: Column, lang: str = "es") -> Column:
    if lang == "en":
        return F.date_format(ts, "MMMM dd, yyyy · hh:mm a")
    return F.concat(
        F.date_format(ts, "dd"),
        F.lit(" de "),
        _month_name(ts, MONTHS_ES),
        F.lit(" de "),
        F.date_format(ts, "yyyy · HH:mm"),
        F.lit(" hs"),
    )


def short_date_label(ts: Column, lang: str = "es") -> Column:
    if lang == "en":
        return F.date_format(ts, "MMM dd")
    return F.concat(F.date_format(ts, "dd "), _month_name(ts, SHORT_MONTHS_ES))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd_HHmm")


def output_name(kind: str, brand: Column, ts: Column) -> Column:
    return F.concat_ws("_", F.lit(kind), slug(brand), stamp(ts))


def days_between(start: Column, end: Column) -> Column:
    """Elapsed days with their fraction."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000.0)

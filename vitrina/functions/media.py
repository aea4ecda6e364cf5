"""Image addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.text import blank_to_null

LIGHT_WIDTH = 320

# How the two image CDNs name a size.
_SUFFIXED = r"""(?i)(mitiendanube\.com/[^"'\s)]*?)-\d{2,4}-\d{2,4}(\.(?:webp|jpe?g|png))"""
_CDN_FILE = r"""((?>cdn\.shopify\.com/[^"'\s)]*?\.(?:webp|jpe?g|png)))"""


def resolve_image(value: Column, base: Column | None = None) -> Column:
    """Absolute image address, or null when it cannot be made absolute.

    `value` is an address or the JSON text of an object with `src` or `url`.
    """
    inner = F.coalesce(
        blank_to_null(F.get_json_object(value, "$.src")),
        blank_to_null(F.get_json_object(value, "$.url")),
    )
    link = F.when(value.startswith("{"), inner).otherwise(blank_to_null(value))
    rooted = F.lit(None).cast("string") if base is None else F.concat(blank_to_null(base), link)
    return (
        F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.startswith("/"), rooted)
        .when(link.rlike("^https?:"), link)
    )


def lighten_images(text: Column, width: int = LIGHT_WIDTH) -> Column:
    """Point every known CDN image in a text at its small rendition."""
    text = F.regexp_replace(text, _SUFFIXED, f"$1-{width}-{width}$2")
    # no query, then a query naming a width, then a query without one
    text = F.regexp_replace(text, rf"(?i){_CDN_FILE}(?!\?)", f"$1?width={width}")
    text = F.regexp_replace(
        text,
        rf"""(?i){_CDN_FILE}\?((?:[^"'\s)]*?&)?)width=[^&"'\s)]*""",
        f"$1?$2width={width}",
    )
    # further widths of the same query go, one after the other
    text = F.regexp_replace(
        text,
        rf"""((?:(?i:{_CDN_FILE})\?(?:[^&"'\s)]*&)*?width={width}|(?<!^)\G)"""
        r"""(?:&(?!width=)[^&"'\s)]*)*)&width=[^&"'\s)]*""",
        "$1",
    )
    text = F.regexp_replace(text, rf"""(?i){_CDN_FILE}\?(?=["'\s)]|$)""", f"$1?width={width}")
    return F.regexp_replace(
        text,
        rf"""(?i){_CDN_FILE}\?(?!(?:[^"'\s)]*&)?width=)([^"'\s)]+)""",
        f"$1?$2&width={width}",
    )

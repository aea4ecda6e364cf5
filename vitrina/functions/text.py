"""Text clean-up as Column expressions: entities, tags, slugs, meta tags, URLs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that browser scripts count as white space; Java's \s covers ASCII only.
SPACES = [
    *range(0x09, 0x0E),
    0x20,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
    0xFEFF,
]


def _space_class() -> str:
    """Regular expression class of the white space, written as what it is not.

    Java tests a class range by range, so the ranges holding most text come first and
    a letter is dismissed by the first test. Naming the spaces is several times slower.
    """
    edges = [-1, *SPACES, 0x110000]
    gaps = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    gaps.sort(key=lambda gap: not gap[0] <= ord("a") <= gap[1])
    return "[^" + "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in gaps) + "]"


WS = _space_class()

# The entities decoded, in the order they are decoded. `&amp;` comes
# before `&lt;`, so `&amp;lt;` ends up as `<`.
ENTITIES = [
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&#39;", "'"),
    ("&#039;", "'"),
    ("&#8217;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&nbsp;", " "),
    ("&aacute;", "á"),
    ("&eacute;", "é"),
    ("&iacute;", "í"),
    ("&oacute;", "ó"),
    ("&uacute;", "ú"),
    ("&ntilde;", "ñ"),
]


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def trim(col: Column) -> Column:
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def decode_entities(col: Column) -> Column:
    decoded = col
    for entity, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def strip_tags(html: Column) -> Column:
    """Visible text of an HTML fragment. Spaces collapse before entities decode."""
    text = F.regexp_replace(html, rf"(?i)<{WS}*br{WS}*/?>", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    text = F.regexp_replace(text, f"{WS}+", " ")
    return F.trim(decode_entities(text))


def truncate(col: Column, limit: int) -> Column:
    cut = F.regexp_replace(F.substring(col, 1, limit), f"{WS}+$", "")
    return F.when(F.length(col) > limit, F.concat(cut, F.lit("…"))).otherwise(
        F.coalesce(col, F.lit(""))
    )


def first_chars(col: Column, limit: int) -> Column:
    return F.substring(col, 1, limit)


def _accented_letters() -> tuple[str, str]:
    """Every BMP letter that decomposes to one ASCII letter plus combining accents."""
    accented, plain = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if base.isascii() and base.isalnum() and marks:
            if all("\u0300" <= mark <= "\u036f" for mark in marks):
                accented.append(chr(code))
                plain.append(base)
    return "".join(accented), "".join(plain)


ACCENTED, PLAIN = _accented_letters()


def slug(col: Column) -> Column:
    """ASCII name for keys and files: accents dropped, other runs become `_`."""
    text = F.translate(F.coalesce(blank_to_null(col), F.lit("marca")), ACCENTED, PLAIN)
    text = F.regexp_replace(text, r"[\u0300-\u036f]", "")
    text = F.regexp_replace(text, "[^A-Za-z0-9]+", "_")
    return F.coalesce(blank_to_null(F.regexp_replace(text, "^_+|_+$", "")), F.lit("marca"))


def meta_tags(html: Column) -> Column:
    """The page cut down to its meta tags, for looking up several of them."""
    tags = F.regexp_extract_all(
        html, F.lit(r"""(?i)<meta[^>]+content=["'][^"']*["'][^>]*"""), F.lit(0)
    )
    return F.array_join(tags, ">")


def _meta_pattern(key: str) -> str:
    attr = rf"""(?:name|property)=["']{re.escape(key)}["']"""
    value = r"""content=["']([^"']*)["']"""
    return rf"(?i)<meta[^>]+{attr}[^>]+{value}|<meta[^>]+{value}[^>]+{attr}"


def meta_tag(html: Column, key: str) -> Column:
    """First meta tag with that name or property, attributes in any order; else empty."""
    return F.regexp_extract(html, _meta_pattern(key), 0)


def meta_value(tag: Column, key: str) -> Column:
    """Content of a tag found by `meta_tag`, null when none was."""
    pattern = _meta_pattern(key)
    content = F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2))
    return F.when(tag != "", trim(decode_entities(content)))


def meta_content(html: Column, key: str) -> Column:
    """Content of a meta tag of a page or of its `meta_tags`."""
    return meta_value(meta_tag(html, key), key)


def drop_first(col: Column, part: Column) -> Column:
    """`col` without the first occurrence of `part`."""
    at = F.instr(col, part)
    rest = F.concat(
        F.substring(col, F.lit(1), at - 1),
        F.substring(col, at + F.length(part), F.length(col)),
    )
    return F.when((at > 0) & (F.length(part) > 0), rest).otherwise(col)


def normalize_url(col: Column) -> Column:
    """Typed-in address: scheme added when missing, trailing slashes dropped."""
    url = trim(col)
    url = F.when(url.rlike("(?i)^https?://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(url, "/+$", "")


def url_origin(url: Column) -> Column:
    origin = F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1))
    return F.regexp_replace(origin, r"^(https://.*):443$|^(http://.*):80$", "$1$2")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def page_key(url: Column, base: Column, limit: int | None = None) -> Column:
    """File-safe key of a page inside its store."""
    path = F.regexp_replace(drop_first(url, base), "[^A-Za-z0-9]+", "_")
    return F.concat(path if limit is None else F.substring(path, 1, limit), F.lit(".html"))


def last_path_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)

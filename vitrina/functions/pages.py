"""What a saved page says about its store: platform, brand, currency, product links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrina.functions.text import WS, blank_to_null, decode_entities, drop_first, trim, url_host

# Marks that each platform leaves in its pages, tested in this order.
PLATFORM_SIGNS = [
    (
        "tiendanube",
        r"LS\.product\s*=|LS\.variants\s*=|mitiendanube\.com|cdn\.tiendanube|window\.LS\b",
    ),
    (
        "shopify",
        r"Shopify\.shop|cdn\.shopify\.com|/cdn/shop/|shopify-features|myshopify\.com",
    ),
    (
        "woocommerce",
        r'wp-content/plugins/woocommerce|class="[^"]*woocommerce|woocommerce_params'
        r"|wc_add_to_cart_params",
    ),
]

# Paths that look like a product page, and the two-letter folders
# under which one platform hangs its other countries' catalogs.
PRODUCT_PATH = r"(?i)/(producto?s?|product|prod|item|itm|p)/[^/]+|/p(/?$|\.html)|-p-\d+"
COUNTRY_FOLDER = (
    "/(ad|bo|br|ca|cl|co|cr|de|ec|es|fr|gb|gt|hk|it|jp|mx|nl|nz|pe|pr|pt|py|us|uy|au)/"
)

# Where a page names its shop, and its currency.
SITE_NAME = '<meta property="og:site_name" content="([^"]+)"'
TITLE = "<title>([^<]+)</title>"
TAGLINE = rf"^([^:|–\-]{{2,25}}):{WS}"
BUYING = rf"Comprar en{WS}+([^\-–|]+){WS}*\z"
ENDING = rf"[\-–|]{WS}*([^\-–|]+){WS}*\z"
PRICE_CURRENCY = r'"priceCurrency"\s*:\s*"([A-Z]{3})"'
ACTIVE_CURRENCY = r'Shopify\.currency\s*=\s*\{\s*"active"\s*:\s*"([A-Z]{3})"'
OTHER_CURRENCY = r'"currency"\s*:\s*"([A-Z]{3})"'

# Words that say a product is gone.
SOLD_OUT = rf"(?i)agotado|sold{WS}*out|out of stock"

GENERIC = "generic"


def platform_sign(html: Column) -> Column:
    """Platform given away by the page, null when none is."""
    page = F.coalesce(html, F.lit(""))
    chosen = None
    for platform, pattern in PLATFORM_SIGNS:
        hit = page.rlike(pattern)
        chosen = (F.when if chosen is None else chosen.when)(hit, platform)
    return chosen


def feed_shape(body: Column) -> Column:
    """Platform given away by a product feed's outer shape."""
    value = F.try_parse_json(body)
    listed = F.try_variant_get(value, "$.products", "array<variant>")
    bare = F.try_variant_get(value, "$", "array<variant>")
    return F.when(listed.isNotNull(), "shopify").when(bare.isNotNull(), "woocommerce")


def page_brand(html: Column, url: Column) -> Column:
    """Store name: site name, then what the title says, then the host."""
    site = blank_to_null(F.regexp_extract(html, SITE_NAME, 1))
    title = decode_entities(blank_to_null(F.regexp_extract(html, TITLE, 1)))

    tagline = blank_to_null(F.regexp_extract(title, TAGLINE, 1))
    buying = trim(F.regexp_extract(title, BUYING, 1))
    ending = trim(F.regexp_extract(title, ENDING, 1))
    last_part = trim(F.element_at(F.split(title, r"[\-–|]", -1), -1))

    host = F.element_at(F.split(F.regexp_replace(url_host(url), r"^www\.", ""), r"\."), 1)
    return (
        F.when(site.isNotNull(), decode_entities(trim(site)))
        .when(tagline.isNotNull(), trim(tagline))
        .when(F.length(buying) > 1, buying)
        .when(F.length(ending) > 1, ending)
        .when(title.isNotNull(), F.coalesce(blank_to_null(last_part), trim(title)))
        .otherwise(host)
    )


def currency_in_structured_data(html: Column) -> Column:
    return blank_to_null(F.regexp_extract(html, PRICE_CURRENCY, 1))


def currency_in_storefront(html: Column) -> Column:
    active = F.regexp_extract(html, ACTIVE_CURRENCY, 1)
    other = F.regexp_extract(html, OTHER_CURRENCY, 1)
    return F.coalesce(blank_to_null(active), blank_to_null(other))


def is_product_url(url: Column, base: Column) -> Column:
    return drop_first(url, base).rlike(PRODUCT_PATH)


def is_local_product_url(url: Column, base: Column) -> Column:
    """Product page under `base`/productos/ outside any country folder."""
    prefix = F.concat(base, F.lit("/productos/"))
    rest = F.substring(url, F.length(base) + 1, F.length(url))
    return F.startswith(url, prefix) & (F.length(url) > F.length(prefix)) & ~rest.rlike(COUNTRY_FOLDER)


def reads_sold_out(html: Column) -> Column:
    return html.rlike(SOLD_OUT)

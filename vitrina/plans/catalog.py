"""From the captures of many stores to their dated snapshots.

A capture is what was saved of a store: its home page, feed pages, product pages, robots file
and sitemaps. The platform that the home page or the feed gives away decides which of these
make the store's catalog.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.pages import GENERIC, feed_shape, page_brand, platform_sign
from vitrina.operators import catalog
from vitrina.operators.adapters import ADAPTERS
from vitrina.operators.rows import join_stores
from vitrina.session import written_table
from vitrina.sources import export, sitemaps

SHOPIFY, WOOCOMMERCE, TIENDANUBE = "shopify", "woocommerce", "tiendanube"


@dataclass(frozen=True)
class Captures:
    """Saved pages of many stores; any table may lack a store.

    homes(store_id, base, html, scraped_at), feeds(store_id, page, body),
    pages(store_id, url, html), robots(store_id, base, body), maps(store_id, url, xml).
    """

    homes: DataFrame
    feeds: DataFrame
    pages: DataFrame
    robots: DataFrame
    maps: DataFrame


def detect_stores(captures: Captures) -> DataFrame:
    """store_id, base, home_html, scraped_at, platform and page brand: one row per home page.

    The home page's marks come first, then the shape of the store's first feed page; a store
    that gives nothing away is generic.
    """
    shapes = (
        captures.feeds.groupBy("store_id")
        .agg(F.min_by("body", "page").alias("body"))
        .select("store_id", feed_shape(F.col("body")).alias("shape"))
    )
    html = F.col("html")
    return captures.homes.join(shapes, "store_id", "left").select(
        "store_id",
        "base",
        F.col("html").alias("home_html"),
        "scraped_at",
        F.coalesce(platform_sign(html), F.col("shape"), F.lit(GENERIC)).alias("platform"),
        page_brand(html, F.col("base")).alias("brand"),
    )


def _of(stores: DataFrame, *platforms: str) -> DataFrame:
    return stores.where(F.col("platform").isin(*platforms))


def chosen_pages(captures: Captures, stores: DataFrame) -> DataFrame:
    """store_id, platform, base, url, html of the saved pages that are product pages.

    Of Tienda Nube stores those that the shop's own sitemaps list, of the others what their
    reachable sitemaps list as products. Addresses are filtered before any page is read.
    """
    bases = _of(stores, TIENDANUBE, WOOCOMMERCE, GENERIC).select("store_id", "base", "platform")
    own = F.col("platform") == TIENDANUBE
    locations = sitemaps.location_table(captures.maps)
    local = sitemaps.local_product_urls(bases.where(own).select("store_id", "base"), locations)
    others = bases.where(~own).select("store_id", "base")
    robots = captures.robots.join(others.select("store_id"), "store_id", "left_semi")
    listed = sitemaps.listed_urls(sitemaps.reachable_sitemaps(robots, locations), locations)
    found = sitemaps.product_urls(listed, others).select("store_id", "url")
    wanted = local.unionByName(found).distinct()
    pages = captures.pages.join(wanted, ["store_id", "url"])
    return join_stores(pages, bases, ["url"]).select("store_id", "platform", "base", "url", "html")


def store_products(captures: Captures, stores: DataFrame) -> DataFrame:
    """The catalog of every store by its platform's adapter.

    A WooCommerce store whose feed gives no product is read like a generic one.
    """
    feeds = join_stores(captures.feeds, stores.select("store_id", "base", "platform", "home_html"), ["page"])
    pages = chosen_pages(captures, stores)
    by_platform = lambda df, name: df.where(F.col("platform") == name).drop("platform")
    served = ADAPTERS[WOOCOMMERCE](by_platform(feeds, WOOCOMMERCE))
    unserved = ADAPTERS[GENERIC](by_platform(pages, WOOCOMMERCE))
    return catalog.union_catalogs(
        [
            ADAPTERS[SHOPIFY](by_platform(feeds, SHOPIFY)),
            catalog.feed_or_pages(served, unserved),
            ADAPTERS[TIENDANUBE](by_platform(pages, TIENDANUBE)),
            ADAPTERS[GENERIC](by_platform(pages, GENERIC)),
        ]
    )


class CatalogSnapshot:
    """The snapshot that a set of captures makes: stores, products, headers, documents.

    Stores and products are written once each, when they are first asked for.
    """

    def __init__(self, captures: Captures):
        self.captures = captures

    @cached_property
    def detected(self) -> DataFrame:
        return written_table(detect_stores(self.captures), "detected_stores")

    @cached_property
    def products(self) -> DataFrame:
        return written_table(store_products(self.captures, self.detected), "catalog_products")

    @cached_property
    def stores(self) -> DataFrame:
        """store_id, brand, platform, source, scraped_at. The catalog's own brand replaces the
        page's where it clearly is one; stores without a product make no snapshot."""
        voted = catalog.store_brands(self.detected.select("store_id", "brand"), self.products)
        named = self.detected.drop("brand", "home_html").join(voted.select("store_id", "brand"), "store_id")
        sold = self.products.select("store_id").distinct()
        rows = named.join(sold, "store_id", "left_semi")
        return written_table(rows.withColumnRenamed("base", "source"), "catalog_stores")

    @property
    def headers(self) -> DataFrame:
        return export.snapshot_headers(self.stores, self.products)

    @property
    def listing(self) -> DataFrame:
        return catalog.listing(self.products)

    @property
    def documents(self) -> DataFrame:
        return export.snapshot_documents(self.stores, self.products)

    @property
    def observations(self) -> DataFrame:
        return export.snapshot_rows(self.stores, self.products)


def build_snapshot(captures: Captures) -> CatalogSnapshot:
    return CatalogSnapshot(captures)

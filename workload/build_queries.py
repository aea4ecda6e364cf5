"""The build of catalog snapshots from whole captures, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.plans.catalog import build_snapshot, chosen_pages, detect_stores
from vitrina.session import scratch_path
from vitrina.sources import export
from vitrina.sources.snapshots import load_snapshots
from workload import captures
from workload.catalog_queries import CATALOG
from workload.sales_queries import tidy


def store_detection(spark, sf):
    found = detect_stores(captures.saved_captures(spark, sf))
    return found.select("store_id", "platform", "brand")


def build_pages(spark, sf):
    """Which saved pages a build reads."""
    saved = captures.saved_captures(spark, sf)
    return chosen_pages(saved, detect_stores(saved)).select("store_id", "platform", "url")


def build_products(spark, sf):
    built = build_snapshot(captures.saved_captures(spark, sf))
    return tidy(built.listing.select("store_id", "platform", "id", "price", "available"))


def build_headers(spark, sf):
    """Headers and summaries of the built snapshots, read back from their stored documents."""
    built = build_snapshot(captures.saved_captures(spark, sf))
    path = scratch_path(spark, "built_documents")
    export.write_documents(built.documents, path)
    loaded = load_snapshots(spark.read.parquet(path)).snapshots
    return tidy(
        loaded.select(
            "store_id", "snapshot_id", "brand", "platform", "source", "currency", "scraped_at", "n_products",
            "stock_total", F.col("stock_known").cast("bigint").alias("stock_known"), "min_price", "max_price",
        )
    )


_BUILT = (
    CATALOG
    + r""", built AS (
  SELECT store_id, platform, id, price, available, brand, stock_total, min_price, max_price, currency,
         CASE WHEN pos IS NULL THEN url ELSE printf('%012d', pos) END AS seen
  FROM placed
  WHERE NOT (platform = 'woocommerce' AND store_id IN ('9', '17'))
    AND NOT (platform = 'generic' AND COALESCE(TRY_CAST(regexp_extract(url, 'g-(\d+)', 1) AS BIGINT), 1) % 17 = 0)
  UNION ALL
  SELECT store_id, 'generic', 'f-' || pk, p + 0.5, true, 'Own', NULL, p + 0.5, p + 0.5, 'EUR',
         base || '/p/f-' || pk
  FROM c WHERE store_id IN ('9', '17')
), home AS (
  SELECT DISTINCT store_id, base, CAST(store_id AS INT) AS n,
    CASE WHEN n % 4 = 0 THEN 'shopify' WHEN n % 4 = 1 THEN 'woocommerce' WHEN n % 4 = 2 THEN 'tiendanube'
         ELSE 'generic' END AS platform,
    CASE WHEN n % 4 = 0 THEN 'Shop ' || n WHEN n % 4 = 1 THEN 'Woo shop ' || n
         WHEN n % 4 = 2 THEN 'Tienda ' || n ELSE 's' || n END AS page_brand
  FROM c
)
"""
)

SQL = {
    "store_detection": _BUILT + "SELECT store_id, platform, page_brand AS brand FROM home",
    "build_pages": _BUILT
    + """SELECT store_id, 'tiendanube' AS platform, base || '/productos/u-' || pk || '/' AS url FROM c WHERE pk % 4 = 2
    UNION ALL SELECT store_id, 'generic', base || '/p/g-' || pk || '/' FROM c WHERE pk % 4 = 3 AND pk % 17 <> 0
    UNION ALL SELECT store_id, 'woocommerce', base || '/p/f-' || pk FROM c WHERE store_id IN ('9', '17')""",
    "build_products": _BUILT + "SELECT store_id, platform, id, CAST(price AS DOUBLE) AS price, available FROM built",
    "build_headers": _BUILT
    + """, votes AS (
      SELECT store_id, brand, count(*) AS votes, min(seen) AS seen FROM built WHERE brand <> '' GROUP BY 1, 2
    ), top AS (
      SELECT store_id, brand AS top_brand, votes FROM votes
      QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY votes DESC, seen) = 1
    ), summary AS (
      SELECT store_id, count(*) AS n_products, CAST(sum(stock_total) AS DOUBLE) AS stock_total,
        count(stock_total) AS stock_known, CAST(min(min_price) AS DOUBLE) AS min_price,
        CAST(max(max_price) AS DOUBLE) AS max_price,
        arg_min(currency, seen) FILTER (WHERE currency IS NOT NULL) AS currency FROM built GROUP BY 1
    ), named AS (
      SELECT h.*, s.* EXCLUDE (store_id), CASE WHEN votes >= greatest(5, n_products / 2)
        AND length(top_brand) < length(page_brand) THEN top_brand ELSE page_brand END AS brand,
        TIMESTAMP '2026-08-01 12:30:00' + to_days(n) AS taken_at
      FROM home h JOIN summary s USING (store_id) LEFT JOIN top USING (store_id)
    )
    SELECT store_id, 'Catalog_' || replace(brand, ' ', '_') || '_' || strftime(taken_at, '%Y-%m-%d_%H%M') || '.json'
      AS snapshot_id, brand, platform, base AS source, currency, strftime(taken_at, '%Y-%m-%d %H:%M:%S') AS scraped_at,
      n_products, stock_total, stock_known, min_price, max_price FROM named""",
}

QUERIES = {name: globals()[name] for name in SQL}

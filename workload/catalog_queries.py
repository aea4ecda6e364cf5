"""Adapter and catalog queries on the rendered captures, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.operators import catalog
from vitrina.operators.adapters import (
    embedded_products,
    shopify_products,
    structured_products,
    woocommerce_products,
)
from vitrina.operators.ordering import rank_within
from workload import captures
from workload.captures import PART_SQL, money
from workload.sales_queries import tidy


def flat(products: DataFrame) -> DataFrame:
    """Products with arrays as text."""
    sizes = F.array_join(F.col("variants.size"), "|")
    stocks = F.array_join(
        F.transform("variants.stock", lambda s: s.cast("bigint").cast("string")), "|", "?"
    )
    return tidy(
        products.select(
            "store_id",
            "id",
            "name",
            "brand",
            "url",
            F.array_join("crumbs", "|").alias("crumbs"),
            "seo_title",
            "meta_description",
            "description",
            "main_image",
            "price_short",
            "price",
            "min_price",
            "max_price",
            "compare_short",
            "promo_short",
            "pay_discount",
            "stock_total",
            "sold_qty",
            "available",
            "size_option_name",
            sizes.alias("sizes"),
            stocks.alias("stocks"),
            "currency",
        )
    )


def _shopify(spark, sf):
    return shopify_products(captures.shopify_feeds(spark, sf))


def _woocommerce(spark, sf):
    return woocommerce_products(captures.woocommerce_feeds(spark, sf))


def _embedded(spark, sf):
    return embedded_products(captures.embedded_pages(spark, sf))


def _structured(spark, sf):
    return structured_products(captures.structured_pages(spark, sf))


def shopify_normalize(spark, sf):
    return flat(_shopify(spark, sf))


def woocommerce_normalize(spark, sf):
    return flat(_woocommerce(spark, sf))


def embedded_normalize(spark, sf):
    return flat(_embedded(spark, sf))


def structured_normalize(spark, sf):
    return flat(_structured(spark, sf))


def catalog_union(spark, sf):
    return tidy(
        captures.catalog(spark, sf).select("store_id", "platform", "id", "name", "price", "url")
    )


def feed_fallback(spark, sf):
    """WooCommerce stores 1, 9, 17 lost their feed; the pages of all such stores exist."""
    feeds = _woocommerce(spark, sf).where(~F.col("store_id").isin("1", "9", "17"))
    pages = captures.parts(spark, sf, 1).selectExpr(
        "store_id",
        "concat(base, '/p/', pk) AS url",
        "concat('<meta property=\"og:title\" content=\"', name, '\">',"
        " '<meta property=\"og:price:amount\" content=\"', p, ',50\">') AS html",
    )
    rows = catalog.feed_or_pages(feeds, structured_products(pages))
    return tidy(rows.select("store_id", "platform", "id", "price"))


def first_products(spark, sf):
    rows = catalog.first_products(captures.catalog(spark, sf), 20)
    return rows.select("store_id", "id")


def catalog_order(spark, sf):
    products = captures.catalog(spark, sf).select(
        "store_id", "id", "name", "available", "pos", "url"
    )
    rows = rank_within(products, ["store_id"], catalog.catalog_order(), "place")
    return catalog.listing(rows).select("store_id", "place", "id", "name", "available")


def catalog_currency(spark, sf):
    return catalog.catalog_currency(captures.catalog(spark, sf))


def catalog_summary(spark, sf):
    return tidy(catalog.catalog_summary(captures.catalog(spark, sf), captures.stores(spark, sf)))


def store_brands(spark, sf):
    """Stores 0, 3, 6 … sell mostly one brand; it wins where the page's name is longer."""
    own = (F.col("store_id") % 3 == 0) & (F.col("id").try_cast("bigint") % 3 != 0)
    products = captures.catalog(spark, sf).withColumn(
        "brand", F.when(own, "Mainbrand").otherwise(F.col("brand"))
    )
    return tidy(catalog.store_brands(captures.stores(spark, sf), products))


def catalog_labels(spark, sf):
    return catalog.grid(captures.catalog(spark, sf))


def catalog_labels_english(spark, sf):
    rows = catalog.grid(captures.catalog(spark, sf), "en")
    return rows.select("store_id", "id", "price_label", "category", "full_category")


def variant_detail(spark, sf):
    return tidy(catalog.variant_detail(captures.catalog(spark, sf)))


SHOPIFY = f"""shopify AS (
  SELECT store_id, CAST(pk AS VARCHAR) AS id, name || ' "' || pk || '"' AS name, brand,
         base || '/products/h-' || pk AS url, CASE WHEN k % 9 = 0 THEN '' ELSE type END AS crumbs,
         name || ' "' || pk || '"' AS seo_title,
         name || ' ' || brand || ' & ' || type || ' size <' || size || '>' AS meta_description,
         name || ' ' || brand || ' & ' || type || ' size <' || size || '>' AS description,
         CASE WHEN k % 5 <> 0 THEN 'https://cdn.example.com/p' || pk || '.jpg'
              WHEN k % 7 <> 0 THEN 'https://cdn.example.com/m' || pk || '.jpg' END AS main_image,
         {money('p + CASE WHEN k % 3 = 0 THEN 1000 ELSE 0 END')} AS price_short,
         CAST(p AS DOUBLE) AS price, CAST(p AS DOUBLE) AS min_price,
         CASE WHEN k % 7 = 0 THEN p ELSE p + 50.5 END::DOUBLE AS max_price,
         CASE WHEN k % 3 = 0 THEN {money('p + 1000')} END AS compare_short,
         CASE WHEN k % 3 = 0 THEN {money('p')} END AS promo_short,
         CAST(NULL AS VARCHAR) AS pay_discount, CAST(NULL AS DOUBLE) AS stock_total,
         CAST(NULL AS DOUBLE) AS sold_qty,
         size % 2 = 0 OR (k % 7 <> 0 AND size % 3 = 0) AS available,
         CASE WHEN k % 4 = 0 THEN 'Variante' ELSE 'Size' END AS size_option_name,
         CASE WHEN k % 7 = 0 THEN '—' WHEN k % 2 = 0 THEN 'S / Red|M' ELSE 'S|M' END AS sizes,
         CASE WHEN k % 7 = 0 THEN '?' ELSE '?|?' END AS stocks, 'USD' AS currency
  FROM c WHERE pk % 4 = 0
)"""

WOOCOMMERCE = f"""woocommerce AS (
  SELECT store_id, CAST(pk AS VARCHAR) AS id, name || ' & ' || pk AS name,
         CASE WHEN k % 2 = 1 THEN brand ELSE '' END AS brand,
         CASE WHEN k % 8 = 0 THEN base ELSE base || '/product/w-' || pk || '/' END AS url,
         type || '|All' AS crumbs, name || ' & ' || pk AS seo_title,
         CASE WHEN k % 2 = 0 THEN name || '  ' || brand ELSE type || ' ''s' END AS meta_description,
         CASE WHEN k % 2 = 0 THEN name || '  ' || brand ELSE type || ' ''s' END AS description,
         CASE WHEN k % 5 <> 1 THEN 'https://img.example.com/' || pk || '.png' END AS main_image,
         {money('p + CASE WHEN k % 3 = 1 THEN 700 ELSE 0 END')} AS price_short,
         CAST(p AS DOUBLE) AS price, CAST(p AS DOUBLE) AS min_price,
         CASE WHEN k % 6 <> 2 THEN p
              ELSE p + 300 + 0.05 END::DOUBLE AS max_price,
         CASE WHEN k % 3 = 1 THEN {money('p + 700')} END AS compare_short,
         CASE WHEN k % 3 = 1 THEN {money('p')} END AS promo_short,
         CAST(NULL AS VARCHAR) AS pay_discount,
         CASE WHEN k % 4 = 0 THEN size END::DOUBLE AS stock_total, CAST(NULL AS DOUBLE) AS sold_qty,
         size % 2 = 0 AS available,
         CASE WHEN k % 3 = 0 THEN 'Fit' ELSE 'Variante' END AS size_option_name,
         '' AS sizes, '' AS stocks, 'EUR' AS currency
  FROM c WHERE pk % 4 = 1
)""".replace("name || '  ' || brand", "name || ' ' || brand")

EMBEDDED = f"""embedded AS (
  SELECT store_id, CAST(pk AS VARCHAR) AS id, name || ' é "q}}"' AS name,
         CASE WHEN k % 2 = 0 THEN brand ELSE '' END AS brand,
         base || CASE WHEN k % 7 = 0 THEN '/productos/u-' ELSE '/productos/c-' END || pk || '/' AS url,
         type || '|' || brand || ' ñ' AS crumbs, 'SEO <' || pk || '>' AS seo_title,
         'Meta ' || name || ' & more' AS meta_description,
         'Long text about ' || name || CASE WHEN k % 2 = 0 THEN ' and a tail that goes on' ELSE '' END
           AS description,
         CASE WHEN k % 6 = 5 THEN 'https://cdn.example.com/f' || pk || '.jpg'
              ELSE 'https://d1.mitiendanube.com/a' || pk || '-1024-1024.webp' END AS main_image,
         {money('p')} AS price_short, CAST(p AS DOUBLE) AS price, CAST(p AS DOUBLE) AS min_price,
         CASE WHEN k % 6 = 5 THEN p ELSE p + 20.5 END::DOUBLE AS max_price,
         CASE WHEN k % 6 <> 5 THEN '$99.000' END AS compare_short,
         CASE WHEN k % 6 <> 5 AND k % 2 = 0 THEN '$1.500,50' END AS promo_short,
         CASE WHEN k % 6 <> 5 THEN '$1.200' END AS pay_discount,
         CASE WHEN k % 4 = 0 THEN 7 WHEN k % 6 = 5 THEN 0 WHEN k % 3 = 0 THEN size
              ELSE size + 2 END::DOUBLE AS stock_total,
         CASE WHEN k % 3 <> 2 THEN k END::DOUBLE AS sold_qty,
         k % 4 = 0 OR (k % 6 <> 5 AND (size > 0 OR k % 3 <> 0)) AS available,
         CASE WHEN k % 2 = 0 THEN 'Color' ELSE 'Talle' END AS size_option_name,
         CASE WHEN k % 6 = 5 THEN '' ELSE 'S|—' END AS sizes,
         CASE WHEN k % 6 = 5 THEN '' WHEN k % 3 = 0 THEN size || '|?' ELSE size || '|2' END AS stocks,
         'ARS' AS currency
  FROM c WHERE pk % 4 = 2 AND k % 11 <> 10 AND k % 13 <> 12
)"""

STRUCTURED = f"""structured AS (
  SELECT store_id, CASE k % 6 WHEN 2 THEN 'S' || pk WHEN 3 THEN 'g-' || pk WHEN 5 THEN 'C' || pk
           ELSE CAST(pk AS VARCHAR) END AS id,
         CASE k % 6 WHEN 3 THEN 'OG & ' || name WHEN 5 THEN name || ' ' || pk ELSE name END AS name,
         CASE WHEN k % 6 < 2 THEN brand ELSE '' END AS brand, base || '/p/g-' || pk || '/' AS url,
         CASE k % 6 WHEN 1 THEN type || '|' || brand ELSE '' END AS crumbs,
         'T ' || pk AS seo_title, 'd ' || type AS meta_description,
         CASE k % 6 WHEN 0 THEN type || ' & ' || brand WHEN 3 THEN 'about ' || type ELSE '' END
           AS description,
         CASE k % 6 WHEN 0 THEN 'https://i.example.com/' || pk || '.jpg'
                    WHEN 1 THEN 'https://i.example.com/g.jpg' END AS main_image,
         {money('CASE WHEN k % 6 = 0 OR k % 6 = 5 THEN p + 1 ELSE p END')} AS price_short,
         low AS price, low AS min_price, low + CASE k % 6 WHEN 1 THEN 100.5 WHEN 2 THEN 10 ELSE 0 END
           AS max_price,
         CAST(NULL AS VARCHAR) AS compare_short, CAST(NULL AS VARCHAR) AS promo_short,
         CAST(NULL AS VARCHAR) AS pay_discount, CAST(NULL AS DOUBLE) AS stock_total,
         CAST(NULL AS DOUBLE) AS sold_qty,
         CASE k % 6 WHEN 1 THEN false WHEN 2 THEN k % 4 <> 0 ELSE true END AS available,
         'Variante' AS size_option_name, '' AS sizes, '' AS stocks,
         CASE k % 6 WHEN 0 THEN 'ARS' WHEN 1 THEN 'UYU' WHEN 3 THEN 'USD' END AS currency
  FROM (SELECT *, CAST(p AS DOUBLE) + CASE k % 6 WHEN 0 THEN 0.5 WHEN 5 THEN 0.9 ELSE 0 END AS low
        FROM c) WHERE pk % 4 = 3 AND k % 6 <> 4
)"""

CATALOG = f"""
WITH {PART_SQL}, {SHOPIFY}, {WOOCOMMERCE}, {EMBEDDED}, {STRUCTURED}, catalog AS (
  SELECT 'shopify' AS platform, * FROM shopify UNION ALL
  SELECT 'woocommerce', * FROM woocommerce UNION ALL
  SELECT 'tiendanube', * FROM embedded UNION ALL
  SELECT 'generic', * FROM structured
), placed AS (
  SELECT catalog.*, CASE WHEN platform IN ('shopify', 'woocommerce') THEN CAST(id AS BIGINT) END
    AS pos FROM catalog
)
"""


def rounded(value: str) -> str:
    return money(f"floor({value} + 0.5)")


def _grid(lang: str) -> str:
    home = "Home" if lang == "en" else "Inicio"

    def fmt(value: str) -> str:
        label = rounded(value)
        return label.replace(", ',', '.')", ", ',', ',')") if lang == "en" else label

    path = f"replace(CASE WHEN crumbs = '' THEN '{home}' ELSE crumbs END, '|', ' › ')"
    return f"""
    CASE WHEN min_price <> max_price THEN {fmt('min_price')} || ' – ' || {fmt('max_price')}
         ELSE price_short END AS price_label,
    CASE WHEN crumbs = '' THEN name ELSE {path} || ' › ' || name END AS category,
    {path} || ' › ' || name AS full_category"""


SQL = {
    "shopify_normalize": f"WITH {PART_SQL}, {SHOPIFY} SELECT * FROM shopify",
    "woocommerce_normalize": f"WITH {PART_SQL}, {WOOCOMMERCE} SELECT * FROM woocommerce",
    "embedded_normalize": f"WITH {PART_SQL}, {EMBEDDED} SELECT * FROM embedded",
    "structured_normalize": f"WITH {PART_SQL}, {STRUCTURED} SELECT * FROM structured",
    "catalog_union": CATALOG + "SELECT store_id, platform, id, name, price, url FROM catalog",
    "feed_fallback": f"""WITH {PART_SQL}
    SELECT store_id, CASE WHEN store_id IN ('1', '9', '17') THEN 'generic' ELSE 'woocommerce' END
      AS platform, CAST(pk AS VARCHAR) AS id,
      CAST(p AS DOUBLE) + CASE WHEN store_id IN ('1', '9', '17') THEN 0.5 ELSE 0 END AS price
    FROM c WHERE pk % 4 = 1""",
    "first_products": CATALOG
    + """SELECT store_id, id FROM placed QUALIFY
    row_number() OVER (PARTITION BY store_id ORDER BY pos, url) <= 20""",
    "catalog_order": CATALOG
    + """SELECT store_id, id, name, available, row_number() OVER (PARTITION BY store_id
    ORDER BY available DESC, name, pos, url, id) AS place FROM placed""",
    "catalog_currency": CATALOG
    + """SELECT store_id, arg_min(currency, CASE WHEN pos IS NULL THEN url
      ELSE printf('%012d', pos) END) FILTER (WHERE currency IS NOT NULL) AS currency
    FROM placed GROUP BY 1""",
    "catalog_summary": CATALOG
    + """SELECT store_id, count(*) AS products, sum(stock_total) AS stock_total,
    count(stock_total) AS stock_known, count(*) FILTER (WHERE available) AS available_n,
    count(*) FILTER (WHERE NOT available) AS sold_out_n, min(min_price) AS min_price,
    max(max_price) AS max_price, arg_min(currency, CASE WHEN pos IS NULL THEN url
      ELSE printf('%012d', pos) END) FILTER (WHERE currency IS NOT NULL) AS currency,
    'https://s' || store_id || '.example.com' AS source
    FROM placed GROUP BY 1""",
    "store_brands": CATALOG
    + """, b AS (
    SELECT store_id, CASE WHEN CAST(store_id AS INT) % 3 = 0
      AND TRY_CAST(id AS BIGINT) % 3 <> 0 THEN 'Mainbrand' ELSE brand END AS brand,
      CASE WHEN pos IS NULL THEN url ELSE printf('%012d', pos) END AS seen FROM placed
    ), v AS (
    SELECT store_id, brand, count(*) AS votes FROM b WHERE brand <> '' GROUP BY 1, 2
    ), t AS (
    SELECT store_id, brand AS top_brand, votes FROM v
    JOIN (SELECT store_id, brand, min(seen) AS seen FROM b GROUP BY 1, 2) USING (store_id, brand)
    QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY votes DESC, seen) = 1
    ), s AS (
    SELECT DISTINCT store_id, CASE WHEN CAST(store_id AS INT) % 2 = 0
      THEN 'Marketing name of shop ' ELSE 'S' END || store_id AS name FROM c
    )
    SELECT s.store_id, CASE WHEN votes >= greatest(5,
        (SELECT count(*) FROM b WHERE b.store_id = s.store_id) / 2)
      AND length(top_brand) < length(name) THEN top_brand ELSE name END AS brand, top_brand, votes
    FROM s LEFT JOIN t USING (store_id)""",
    "catalog_labels": CATALOG
    + f"""SELECT store_id, id, name, {_grid('es')},
    CASE WHEN NOT available AND stock_total IS NULL THEN 'soldOut'
         WHEN NOT available THEN 'outOfStock' WHEN stock_total IS NULL THEN 'available'
         ELSE 'Stock: ' || CAST(stock_total AS BIGINT) END AS badge,
    CASE WHEN length(description) > 150 THEN rtrim(substr(description, 1, 150)) || '…'
         ELSE description END AS summary FROM catalog""",
    "catalog_labels_english": CATALOG + f"SELECT store_id, id, {_grid('en')} FROM catalog",
    "variant_detail": f"""WITH {PART_SQL}
    SELECT store_id, CAST(pk AS VARCHAR) AS id, CAST(0 AS BIGINT) AS place,
      CASE WHEN k % 7 = 0 THEN '—' WHEN k % 2 = 0 THEN 'S / Red' ELSE 'S' END AS size,
      'A' || pk AS sku, CAST(NULL AS DOUBLE) AS stock, true AS is_out, size % 2 = 0 AS available,
      {money('p + CASE WHEN k % 3 = 0 THEN 1000 ELSE 0 END')} AS price_short,
      CASE WHEN k % 3 = 0 THEN {money('p')} ELSE '—' END AS promo_short,
      CASE WHEN k % 3 = 0 THEN {money('p + 1000')} ELSE '—' END AS compare_short
    FROM c WHERE pk % 4 = 0
    UNION ALL
    SELECT store_id, CAST(pk AS VARCHAR), 1, 'M', '—', NULL, true, size % 3 = 0,
      {money('p + 51')}, '—', '—' FROM c WHERE pk % 4 = 0 AND k % 7 <> 0
    UNION ALL
    SELECT store_id, CAST(pk AS VARCHAR), 0, 'S', 'T' || pk, size, size = 0, true, {money('p')},
      CASE WHEN k % 2 = 0 THEN '$1.500,50' ELSE '—' END, '—'
    FROM c WHERE pk % 4 = 2 AND k % 11 <> 10 AND k % 13 <> 12 AND k % 6 <> 5
    UNION ALL
    SELECT store_id, CAST(pk AS VARCHAR), 1, '—', '—', CASE WHEN k % 3 <> 0 THEN 2 END,
      k % 3 = 0, false, {money('p')}, '—', '$99.000'
    FROM c WHERE pk % 4 = 2 AND k % 11 <> 10 AND k % 13 <> 12 AND k % 6 <> 5""",
}

QUERIES = {name: globals()[name] for name in SQL}

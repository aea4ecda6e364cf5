"""Feeds, product pages and sitemaps rendered from `part`, one capture kind per store.

Part pk belongs to store pk % 20; stores 0, 4, … have a Shopify feed, 1, 5, … a
WooCommerce feed, 2, 6, … Tienda Nube pages and 3, 7, … structured pages. `k` is the
part's number inside its store and decides which odd cases it shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators.catalog import build_catalog
from vitrina.plans.catalog import Captures
from vitrina.sources.buckets import bucket_width
from workload.snapshots import table, written_once

# Columns shared by the Spark fixtures and, in SQL form, by their counterparts.
PART_COLUMNS = [
    "p_partkey AS pk",
    "CAST(p_partkey % 20 AS STRING) AS store_id",
    "p_partkey DIV 20 AS k",
    "concat('https://s', p_partkey % 20, '.example.com') AS base",
    "p_name AS name",
    "p_brand AS brand",
    "p_type AS type",
    "p_size AS size",
    "CAST(round(p_retailprice * 10) AS BIGINT) AS p",
]

# The same in SQL; `c` is the table every catalog counterpart starts from, `money` the
# "$9.001" label.
PART_SQL = """
c AS (
  SELECT p_partkey AS pk, CAST(p_partkey % 20 AS VARCHAR) AS store_id, p_partkey // 20 AS k,
         'https://s' || (p_partkey % 20) || '.example.com' AS base, p_name AS name,
         p_brand AS brand, p_type AS type, p_size AS size,
         CAST(round(p_retailprice * 10) AS BIGINT) AS p
  FROM part
)
"""


def money(value: str) -> str:
    return f"'$' || replace(format('{{:,}}', CAST({value} AS BIGINT)), ',', '.')"


def parts(spark: SparkSession, sf_dir: str, kind: int | None = None) -> DataFrame:
    """A part is short and what is rendered from it is not, so the rows are dealt out first: the tasks
    that render and read captures do not depend on how few files the parts lie in."""
    rows = table(spark, sf_dir, "part").selectExpr(*PART_COLUMNS)
    rows = rows if kind is None else rows.where(F.col("pk") % 4 == kind)
    return rows.repartition(bucket_width(spark), "pk", "name", "type")


def _paged(rows: DataFrame, before: str, after: str) -> DataFrame:
    """Feed pages of at most 50 products, from rows with a `json` column."""
    key = ["store_id", "base", "page"]
    return (
        rows.withColumn("page", (F.col("k") / 50).cast("bigint"))
        .repartition(bucket_width(rows.sparkSession), *key)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(F.struct("k", "json"))).alias("items"))
        .select(
            "store_id",
            "base",
            "page",
            F.concat(F.lit(before), F.array_join("items.json", ","), F.lit(after)).alias("body"),
        )
    )


def shopify_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = """concat(
      '{"id":', pk, ',"title":"', name, ' \\\\"', pk, '\\\\"","handle":"h-', pk,
      '","body_html":"<p>', name, '<br/>', brand, ' &amp; ', type,
      '</p>\\\\n<ul><li>size &lt;', size, '&gt;</li></ul>","vendor":"', brand,
      '","product_type":"', if(k % 9 = 0, '', type), '","variants":[{"option1":"',
      if(k % 7 = 0, 'Default Title', 'S'), '","option2":',
      if(k % 7 <> 0 AND k % 2 = 0, '"Red"', 'null'), ',"option3":null,"sku":"A', pk,
      '","available":', size % 2 = 0, ',"price":"', p, '.00","compare_at_price":',
      if(k % 3 = 0, concat('"', p + 1000, '.00"'), 'null'), ',"featured_image":null}',
      if(k % 7 = 0, '', concat(',{"option1":"M","option2":null,"option3":null,"sku":null,',
        '"available":', size % 3 = 0, ',"price":',
        if(k % 3 = 0, concat(p + 50, '.50'), concat('"', p + 50, '.50"')),
        ',"compare_at_price":"1.00","featured_image":{"src":"https://cdn.example.com/m', pk,
        '.jpg"}}')),
      '],"images":[', if(k % 5 = 0, '', concat('{"src":"https://cdn.example.com/p', pk, '.jpg"}')),
      '],"options":[', if(k % 4 = 0, '', '{"name":"Size"}'), ']}')"""
    rows = parts(spark, sf_dir, 0).selectExpr("store_id", "base", "k", f"{json} AS json")
    home = F.lit('<script>Shopify.currency = {"active":"USD","rate":"1.0"};</script>')
    return _paged(rows, '{"products":[', "]}").withColumn("home_html", home)


def woocommerce_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = "CASE WHEN k % 5 = 0 THEN 2 WHEN k % 3 = 0 THEN 3 ELSE 2 END"
    minor = f"CAST(pow(10, {unit}) AS BIGINT)"
    json = f"""concat(
      '{{"id":', pk, ',"name":"', name, ' &amp; <b>', pk, '</b>","permalink":"',
      if(k % 8 = 0, '', concat(base, '/product/w-', pk, '/')),
      '","short_description":"', if(k % 2 = 0, '', concat('<p>', type, ' &#8217;s</p>')),
      '","description":"<p>', name, '</p>\\\\n<p>', brand, '</p>","on_sale":', k % 3 = 1,
      ',"is_in_stock":', size % 2 = 0, ',"low_stock_remaining":', if(k % 4 = 0, string(size), 'null'),
      ',"prices":{{"price":"', p * {minor}, '","regular_price":"', (p + 700) * {minor},
      '","sale_price":"', p * {minor}, '","price_range":',
      if(k % 6 = 2, concat('{{"min_amount":"', p * {minor}, '","max_amount":"',
        (p + 300) * {minor} + 5, '"}}'), 'null'),
      ',"currency_code":"EUR","currency_minor_unit":', if(k % 5 = 0, 'null', string({unit})),
      '}},"images":[', if(k % 5 = 1, '', concat('{{"src":"https://img.example.com/', pk, '.png"}}')),
      '],"categories":[{{"name":"', type, '"}},{{"name":"All"}}],"brands":[',
      if(k % 2 = 1, concat('{{"name":"', brand, '"}}'), ''), '],"attributes":[',
      if(k % 3 = 0, '{{"name":"Fit"}}', ''), ']}}')"""
    rows = parts(spark, sf_dir, 1).selectExpr("store_id", "base", "k", f"{json} AS json")
    return _paged(rows, "[", "]")


def embedded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = "replace(format_number(p, 0), ',', '.')"
    variants = f"""concat('[',
      if(k % 6 = 5, '', concat('{{"option0":"S","sku":"T', pk, '","stock":', size,
        ',"available":true,"price_number":', p, ',"price_short":"$', {grouped},
        ',00","has_promotional_price":', k % 2 = 0, ',"promotional_price_short":"$1.500,50",',
        '"compare_at_price_short":"","price_with_payment_discount_short":"$1.200",',
        '"image_url":"//d1.mitiendanube.com/a', pk, '-1024-1024.webp"}},',
        '{{"option0":null,"sku":null,"stock":', if(k % 3 = 0, 'null', '"2"'),
        ',"available":false,"price_number":', p + 20, '.5,"price_short":null,',
        '"has_promotional_price":false,"promotional_price_short":"$9",',
        '"compare_at_price_short":"$99.000,00","image_url":{{"src":"https://x/y.png"}}}}')),
      if(k % 13 = 12, '{{broken', ''), ']')"""
    html = f"""concat(
      '<html><head><meta name="description" content=" Meta ', name, ' &amp; more "/>',
      '</head><body>',
      if(k % 5 = 0 OR k % 11 = 10, '',
         concat('<script>LS.product = {{ note: "}}", tags: ["a{{"], id : ', pk, ' }};</script>')),
      if(k % 11 = 10, '', concat('<script>var p = {{"id":', pk, ',"name":"', name,
        ' &eacute; \\\\"q}}\\\\"","brand":', if(k % 2 = 0, concat('"', brand, '"'), 'null'),
        ',"canonical_url":', if(k % 7 = 0, 'null', concat('"', base, '/productos/c-', pk, '/"')),
        ',"seo_title":"SEO &lt;', pk, '&gt;",', if(k % 4 = 0, '"stock":7,', ''),
        '"price":', p * 100, ',"sold_qty":', if(k % 3 = 2, 'null', string(k)),
        ',"featured_image":"//cdn.example.com/f', pk, '.jpg","default_options":',
        if(k % 2 = 0, '[{{"name":"Color"}}]', '[]'), ',"offers":{{"priceCurrency":"ARS"}}}};',
        ' LS.variants = ', {variants}, ';</script>')),
      '<div class="box product-description" id="d"><div>Long <b>text</b> about ', name,
      '</div>', if(k % 2 = 0, '<p>and a tail that goes on</p>', ''), '</div><div>other</div>',
      '<script type="application/ld+json">{{"@type":"BreadcrumbList","itemListElement":',
      '[{{"item":"https://', if(k % 3 = 0, repeat('x', 1000), 'c'), '","name": "', type, '"}},{{"name":"', brand, ' &ntilde;"}},{{"name":"', name,
      '"}}]}}</script></body></html>')"""
    return parts(spark, sf_dir, 2).selectExpr(
        "store_id", "base", "concat(base, '/productos/u-', pk, '/') AS url", f"{html} AS html"
    )


def structured_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ld = '<script type="application/ld+json">'
    es = "replace(format_number({0}, 0), ',', '.')"
    offer_object = f"""concat('{ld}{{"@type":"Product","name":"', name, '","sku":"', pk,
      '","brand":"', brand, '","image":["https://i.example.com/', pk, '.jpg"],"description":"<p>',
      type, ' &amp; ', brand, '</p>","offers":{{"price":', p,
      '.5,"priceCurrency":"ARS","availability":"https://schema.org/InStock"}}}}</script>')"""
    graph = f"""concat('{ld}{{"@graph":[{{"@type":"BreadcrumbList","itemListElement":[',
      '{{"name":"', type, '"}},{{"item":{{"name":"', brand, '"}}}},{{"name":"', name, '"}}]}},',
      '{{"@type":["Thing","Product"],"name":"', name, '","productID":', pk,
      ',"brand":{{"name":"', brand, '"}},"image":{{"url":"https://i.example.com/g.jpg"}},',
      '"offers":[{{"price":"', {es.format('p')}, '","availability":"OutOfStock"}},"x",',
      '{{"price":"', {es.format('p + 100')}, ',50","priceCurrency":"UYU"}}]}}]}}</script>')"""
    aggregate = f"""concat('{ld}{{"@type":"Product","name":"', name,
      '","offers":{{"@type":"AggregateOffer","sku":"S', pk, '","lowPrice":"', p,
      '.00","highPrice":', p + 10, '}}}}</script>', if(k % 4 = 0, '<b>Sold  OUT</b>', ''))"""
    open_graph = """concat('<meta property="og:type" content="product"/>',
      '<meta content="OG &amp; ', name, '" property="og:title">',
      '<meta property="product:price:amount" content="', p, '.00"/>',
      '<meta name="product:price:currency" content="USD">',
      '<meta property="og:description" content="about ', type, '">')"""
    carousel = f"""concat('{ld}broken{{{{{{</script>',
      '<meta property="og:title" content="', upper(name), ' ', pk, ' - shop"/>',
      '{ld}[{{"@type":"Product","name":"Related thing","offers":{{"price":1}}}},',
      '{{"@type":"Product","name":"', name, ' ', pk, '","sku":"C', pk,
      '","offers":{{"price":"', p, ',9","availability":"PreOrder"}}}}]</script>')"""
    html = f"""concat('<html><head><title>T ', pk, '</title>',
      '<meta name="description" content="d ', type, '">',
      CASE k % 6 WHEN 0 THEN {offer_object} WHEN 1 THEN {graph} WHEN 2 THEN {aggregate}
        WHEN 3 THEN {open_graph} WHEN 5 THEN {carousel} ELSE '<p>a blog</p>' END,
      '</head><body></body></html>')"""
    return parts(spark, sf_dir, 3).selectExpr(
        "store_id", "base", "concat(base, '/p/g-', pk, '/') AS url", f"{html} AS html"
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored catalog of all twenty stores, from all four kinds of capture."""

    def build() -> DataFrame:
        return build_catalog(
            {
                "shopify": shopify_feeds(spark, sf_dir),
                "woocommerce": woocommerce_feeds(spark, sf_dir),
                "tiendanube": embedded_pages(spark, sf_dir),
                "generic": structured_pages(spark, sf_dir),
            }
        )

    return written_once(spark, sf_dir, "catalog", build)


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each store besides its products."""
    name = F.when(F.col("store") % 2 == 0, "Marketing name of shop ").otherwise("S")
    return (
        table(spark, sf_dir, "part")
        .select((F.col("p_partkey") % 20).alias("store"))
        .distinct()
        .select(
            F.col("store").cast("string").alias("store_id"),
            F.concat(name, F.col("store").cast("string")).alias("brand"),
            F.when(F.col("store") % 3 != 0, "shopify").alias("platform"),
            F.concat(F.lit("https://s"), "store", F.lit(".example.com")).alias("source"),
            F.expr("timestampadd(DAY, store, timestamp'2026-08-01 12:30:00')").alias("scraped_at"),
        )
    )


# ---- whole captures: home pages, feeds, pages and sitemaps of every store --------------

# Stores 9 and 17 have lost their feed and are read from pages.
LOST_FEEDS = ("9", "17")
# Addresses in one sitemap.
MAP_URLS = 500


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Home pages. Stores 5 and 13 show their platform by the feed only, 3, 7, … not at all."""
    html = """CASE
      WHEN n % 4 = 0 THEN concat('<title>Shop ', n, ': fine things</title><script>Shopify.shop = "x";',
        ' Shopify.currency = {"active":"USD"};</script>')
      WHEN n % 8 = 1 THEN concat('<title>Buy | Woo shop ', n, '</title><body class="home woocommerce">')
      WHEN n % 4 = 1 THEN concat('<title>Buy | Woo shop ', n, '</title>')
      WHEN n % 4 = 2 THEN concat('<meta property="og:site_name" content="Tienda ', n, '"><script>window.LS = {}</script>')
      ELSE '<p>hello</p>' END"""
    stores = table(spark, sf_dir, "part").selectExpr("p_partkey % 20 AS n").distinct()
    return stores.selectExpr(
        "string(n) AS store_id",
        "concat('https://s', n, '.example.com') AS base",
        f"{html} AS html",
        "timestampadd(DAY, n, timestamp'2026-08-01 12:30:00') AS scraped_at",
    )


def saved_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["store_id", "page", "body"]
    woocommerce = woocommerce_feeds(spark, sf_dir).where(~F.col("store_id").isin(*LOST_FEEDS))
    return shopify_feeds(spark, sf_dir).select(*columns).unionByName(woocommerce.select(*columns))


def _fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = """concat('<script type="application/ld+json">{"@type":"Product","name":"', name,
      '","brand":"Own","offers":{"price":', p, '.5,"priceCurrency":"EUR"}}</script>')"""
    rows = parts(spark, sf_dir, 1).where(F.col("store_id").isin(*LOST_FEEDS))
    return rows.selectExpr("store_id", "base", "concat(base, '/p/f-', pk) AS url", f"{html} AS html")


def _product_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        embedded_pages(spark, sf_dir)
        .unionByName(structured_pages(spark, sf_dir))
        .unionByName(_fallback_pages(spark, sf_dir))
    )


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product pages, and copies of them under addresses that are no product's."""
    real = _product_pages(spark, sf_dir)
    local = real.where(F.col("url").contains("/productos/"))
    elsewhere = local.withColumn("url", F.regexp_replace("url", "/productos/", "/mx/productos/"))
    blog = real.where(F.col("url").contains("/p/g-")).withColumn("url", F.regexp_replace("url", "/p/g-", "/blog/g-"))
    return real.unionByName(elsewhere).unionByName(blog).select("store_id", "url", "html")


def saved_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index and its maps per store; a seventeenth of the structured pages is in none."""
    number = F.regexp_extract("url", r"-(\d+)/?$", 1).cast("bigint")
    urls = saved_pages(spark, sf_dir).select("store_id", "url", number.alias("pk"))
    listed = urls.where(~(F.col("url").contains("/p/g-") & (F.col("pk") % 17 == 0)))
    base = F.concat(F.lit("https://s"), "store_id", F.lit(".example.com"))
    leaf = F.concat(base, F.lit("/map-"), (F.col("pk") / (20 * MAP_URLS)).cast("int"), F.lit(".xml"))
    entry = lambda loc: F.concat(F.lit("<url><loc>"), loc, F.lit("</loc></url>"))
    body = lambda tag, loc: F.concat(
        F.lit(f"<{tag}>"), F.array_join(F.array_sort(F.collect_set(entry(F.col(loc)))), ""), F.lit(f"</{tag}>")
    )
    placed = listed.select("store_id", F.col("url").alias("loc"), leaf.alias("url"), F.concat(base, F.lit("/sitemap.xml")).alias("root"))
    leaves = placed.groupBy("store_id", "url").agg(body("urlset", "loc").alias("xml"))
    roots = placed.groupBy("store_id", F.col("root")).agg(body("sitemapindex", "url").alias("xml"))
    return leaves.unionByName(roots.withColumnRenamed("root", "url"))


def saved_captures(spark: SparkSession, sf_dir: str) -> Captures:
    """All of it as it would be stored."""

    def stored(name: str, build) -> DataFrame:
        return written_once(spark, sf_dir, name, lambda: build(spark, sf_dir))

    home = stored("homes", homes)
    robots = home.select("store_id", "base", F.lit(None).cast("string").alias("body"))
    return Captures(
        home, stored("saved_feeds", saved_feeds), stored("saved_pages", saved_pages), robots, stored("saved_maps", saved_maps)
    )

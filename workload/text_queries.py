"""Scalar functions over whole tables, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrina.functions import dates, jsonld, media, money, pages, text
from vitrina.operators.catalog import classify_pages
from workload import captures
from workload.captures import PART_SQL
from workload.sales_queries import tidy
from workload.snapshots import table

# ---- Spark side -----------------------------------------------------------------


def price_parse(spark, sf):
    """A price in eight spellings, good and bad."""
    shown = captures.parts(spark, sf).selectExpr(
        "pk",
        """CASE pk % 12
        WHEN 0 THEN concat(p, '.00')
        WHEN 1 THEN replace(format_number(p, 0), ',', '.')
        WHEN 2 THEN concat('$ ', replace(format_number(p, 0), ',', '.'), ',50')
        WHEN 3 THEN concat(format_number(p, 0), '.5')
        WHEN 4 THEN 'gratis'
        WHEN 5 THEN concat('ARS ', p, '-5')
        WHEN 6 THEN concat('0.', p)
        WHEN 7 THEN concat(p, '.')
        WHEN 8 THEN concat('-', p, ',2')
        WHEN 9 THEN concat('1.', p, ',7x5')
        WHEN 10 THEN '--'
        ELSE '' END AS shown""",
    )
    return tidy(shown.select("pk", money.parse_price(F.col("shown")).alias("price")))


def price_format(spark, sf):
    amount = ((F.col("p") * F.col("size") * 137 - 600000) / F.lit(100).cast("decimal(3,0)")).cast(
        "decimal(18,2)"
    )
    rows = captures.parts(spark, sf).select(
        "pk", F.when(F.col("pk") % 10 != 0, amount).alias("amount"), "size", "p"
    )
    amount = F.col("amount")
    return rows.select(
        "pk",
        money.price_label(amount).alias("es"),
        money.price_or_dash(amount, "en").alias("en"),
        money.count_label(F.when(F.col("pk") % 7 != 0, F.col("p") * 1000)).alias("units"),
        money.millions_label(F.col("p") * F.col("size") * 100).alias("millions"),
        money.millions_label(F.col("p") * F.col("size") * 100, "en").alias("millions_en"),
    )


def clean_price(spark, sf):
    rows = captures.parts(spark, sf).selectExpr(
        "pk", "concat('$', p, CASE pk % 3 WHEN 0 THEN ',00' WHEN 1 THEN ',36' ELSE '' END) AS s"
    )
    shown = F.when(F.col("pk") % 11 != 0, F.col("s")).otherwise("")
    return rows.select("pk", money.drop_zero_cents(shown).alias("short"))


def minor_unit_price(spark, sf):
    rows = captures.parts(spark, sf).selectExpr(
        "pk",
        "CASE pk % 6 WHEN 4 THEN '' WHEN 5 THEN 'n/a' ELSE concat(' ', p * 100) END AS s",
        "CASE pk % 4 WHEN 0 THEN NULL ELSE CAST(pk % 4 AS DOUBLE) END AS unit",
    )
    return tidy(rows.select("pk", money.minor_unit_price(F.col("s"), F.col("unit")).alias("price")))


def page_text(spark, sf):
    html = F.col("html")
    title = F.regexp_extract(html, "<title>([^<]*)</title>", 1)
    return table(spark, sf, "pages").select(
        "page_id",
        text.strip_tags(html).alias("body"),
        text.decode_entities(title).alias("title"),
        text.truncate(text.strip_tags(html), 150).alias("summary"),
    )


def document_text(spark, sf):
    """Whole documents wrapped in markup and stripped again."""
    marked = F.concat(
        F.lit("<div>&iacute;&amp;lt;<BR />"), F.col("text"), F.lit(" &nbsp;&#039;</div>")
    )
    body = text.strip_tags(marked)
    return tidy(
        table(spark, sf, "documents").select(
            "doc_id",
            F.length(body).alias("chars"),
            F.sha2(body, 256).alias("body_sha256"),
            text.truncate(body, 90).alias("summary"),
        )
    )


def meta_lookup(spark, sf):
    """Meta tags in either attribute order behind a whole page, among look-alikes, with entities."""
    title = F.regexp_extract("html", "<title>([^<&]*)", 1)
    rows = table(spark, sf, "pages").select("page_id", "html", title.alias("t"))
    first = F.concat(
        F.lit('<meta data-a="1" property="og:title" content=" A &amp; '), "t", F.lit('">')
    )
    reversed_order = F.concat(
        F.lit("<meta content='B &quot;"),
        F.regexp_replace("t", "'", ""),
        F.lit("' name='og:title' />"),
    )
    page = F.concat(
        "html",
        F.lit('<meta charset="x"><META name="og:title:alt" content="no">'),
        F.when(F.col("page_id") % 2 == 0, first).otherwise(reversed_order),
        F.lit('<meta property="og:title" content="later"><meta name="empty" content="">'),
    )
    return rows.select(
        "page_id",
        text.meta_content(page, "og:title").alias("og_title"),
        text.meta_content(page, "empty").alias("empty"),
        text.meta_content(page, "og:type").alias("missing"),
    )


SIGNS = [
    "<script>LS.variants = [];</script>",
    '<img src="https://d1.mitiendanube.com/a.jpg">',
    "<script>Shopify.shop = 'x'; window.LS = 1;</script>",
    '<link href="/cdn/shop/a.css">',
    '<body class="archive woocommerce-page">',
    "",
]


def _signed(spark, sf):
    sign = F.element_at(F.array(*[F.lit(s) for s in SIGNS]), F.col("page_id").cast("int") % 6 + 1)
    rows = table(spark, sf, "pages")
    return rows.withColumn(
        "html", F.when(F.col("page_id") % 13 != 0, F.concat("html", sign))
    )


def page_classify(spark, sf):
    return classify_pages(_signed(spark, sf)).select("page_id", "platform")


def feed_classify(spark, sf):
    """Feed pages of both kinds, and bodies that are no feed."""
    bodies = (
        captures.shopify_feeds(spark, sf)
        .select("store_id", "page", "body")
        .unionByName(captures.woocommerce_feeds(spark, sf).select("store_id", "page", "body"))
    )
    odd = F.when(F.col("page") % 3 == 1, F.lit('{"products":5}')).otherwise(F.col("body"))
    return tidy(bodies.select("store_id", "page", pages.feed_shape(odd).alias("platform")))


def page_brand(spark, sf):
    word = F.regexp_extract("url", "//([a-z.-]+)", 1)
    short = F.substring(F.regexp_replace(word, "[^a-z]", ""), 1, 5)
    title = (
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("Shop "), short, F.lit(": a tagline")))
        .when(F.col("page_id") % 6 == 1, F.concat(F.lit("Remera | Comprar en  "), word, F.lit(" ")))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit("Inicio - "), word))
        .when(F.col("page_id") % 6 == 3, F.concat(word, F.lit(" &amp; co")))
        .when(F.col("page_id") % 6 == 4, F.lit("Inicio - x"))
    )
    site = F.lit('<meta property="og:site_name" content=" Site &eacute; ">')
    rest = F.regexp_replace("html", "(?s)<title>.*?</title>", "")
    page = F.concat(
        F.when(F.col("page_id") % 9 == 0, site).otherwise(""),
        rest,
        F.coalesce(F.concat(F.lit("<title>"), title, F.lit("</title>")), F.lit("<p>untitled</p>")),
    )
    return table(spark, sf, "pages").select(
        "page_id", pages.page_brand(page, F.col("url")).alias("brand")
    )


def page_brand_found(spark, sf):
    """Brand of the pages as they are."""
    return table(spark, sf, "pages").select(
        "page_id", pages.page_brand(F.col("html"), F.col("url")).alias("brand")
    )


def page_urls(spark, sf):
    url = F.col("url")
    typed = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(url, "^https?://", " ")).otherwise(
        F.concat(url, F.lit("//"))
    )
    return table(spark, sf, "pages").select(
        "page_id",
        text.normalize_url(typed).alias("normal"),
        text.url_origin(url).alias("origin"),
        text.url_host(url).alias("host"),
        text.page_key(url, text.url_origin(url)).alias("page_key"),
        text.last_path_segment(url).alias("segment"),
    )


def page_currency(spark, sf):
    snippet = F.element_at(
        F.array(
            F.lit('{"priceCurrency" : "ARS"}{"priceCurrency":"USD"}'),
            F.lit('Shopify.currency = {"active":"CLP","rate":"1.0"};"currency":"USD"'),
            F.lit('{"currency":"EUR","priceCurrency":"eur"}'),
            F.lit("nothing"),
        ),
        F.col("page_id").cast("int") % 4 + 1,
    )
    page = F.concat("html", snippet)
    return table(spark, sf, "pages").select(
        "page_id",
        pages.currency_in_structured_data(page).alias("structured"),
        pages.currency_in_storefront(page).alias("storefront"),
    )


def slug_labels(spark, sf):
    name = (
        F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Ñandú & Café "), "c_name"))
        .when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("--"), "c_mktsegment", F.lit(" Ūber!")))
        .when(F.col("c_custkey") % 5 == 2, F.lit("¡¿?!"))
        .when(F.col("c_custkey") % 5 == 3, F.lit(""))
        .otherwise(F.col("c_name"))
    )
    return table(spark, sf, "customer").select("c_custkey", text.slug(name).alias("slug"))


def date_labels(spark, sf):
    at = F.expr("timestampadd(MINUTE, o_orderkey % 1440, CAST(o_orderdate AS TIMESTAMP))")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.datetime_label(at).alias("es"),
        dates.datetime_label(at, "en").alias("en"),
        dates.short_date_label(at).alias("short_es"),
        dates.short_date_label(at, "en").alias("short_en"),
        dates.stamp(at).alias("stamp"),
    )


def image_resolve(spark, sf):
    link = F.expr(
        """CASE pk % 7 WHEN 0 THEN concat('//cdn.example.com/', pk, '.jpg')
        WHEN 1 THEN concat('/img/', pk, '.png') WHEN 2 THEN concat('https://x.example.com/', pk)
        WHEN 3 THEN concat('img/', pk) WHEN 4 THEN concat('{"src":"//y.example.com/', pk, '"}')
        WHEN 5 THEN concat('{"src":"","url":"http://z.example.com/', pk, '"}') ELSE '' END"""
    )
    return captures.parts(spark, sf).select(
        "pk",
        media.resolve_image(link, F.col("base")).alias("with_base"),
        media.resolve_image(link).alias("without_base"),
    )


def image_rewrite(spark, sf):
    html = F.expr(
        """concat('<img src="https://d', pk, '.mitiendanube.com/f', pk, '-1024-', 100 + pk % 900,
        '.webp"><img src="https://cdn.shopify.com/s/', pk, '.png',
        CASE pk % 5 WHEN 0 THEN '' WHEN 1 THEN '?v=12' WHEN 2 THEN '?width=900&v=3'
        WHEN 3 THEN '?v=1&width=40&x=2&width=9&width=70' ELSE '?' END, '"> https://other.com/a-10-20.jpg')"""
    )
    return captures.parts(spark, sf).select("pk", media.lighten_images(html).alias("html"))


def page_nodes(spark, sf):
    """Nodes of every structured-data block, by type."""
    pages_of = captures.structured_pages(spark, sf)
    found = pages_of.select("url", jsonld.nodes(F.col("html")).alias("n"))
    return tidy(
        found.select(
            "url",
            F.size("n").alias("nodes"),
            F.size(jsonld.nodes_of_type(F.col("n"), "Product")).alias("products"),
            F.array_join(jsonld.breadcrumb_names(F.col("n")), "|").alias("crumbs"),
        )
    )


def offer_folding(spark, sf):
    rows = captures.structured_pages(spark, sf).withColumn("n", jsonld.nodes(F.col("html")))
    product = F.get(jsonld.nodes_of_type(F.col("n"), "Product"), 0)
    offers = F.col("offers")
    folded = rows.withColumn("offers", jsonld.as_list(product, "$.offers"))
    prices = jsonld.offer_prices(offers)
    return tidy(
        folded.select(
            "url",
            F.array_min(prices).alias("low"),
            F.array_max(prices).alias("high"),
            jsonld.offer_currency(offers).alias("currency"),
            jsonld.offer_availability(offers).alias("available"),
        )
    )


# ---- SQL side -------------------------------------------------------------------

SPACE = (
    r"[\s\x0B\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)


# What the entities stand for, in the order they are replaced.
ENTITY_TEXT = [
    ("&quot;", '"'), ("&#34;", '"'), ("&#039;", "'"), ("&#39;", "'"), ("&#8217;", "'"), ("&apos;", "'"),
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
    ("&aacute;", "á"), ("&eacute;", "é"), ("&iacute;", "í"), ("&oacute;", "ó"), ("&uacute;", "ú"), ("&ntilde;", "ñ"),
]


def decoded(col: str) -> str:
    for entity, char in ENTITY_TEXT:
        char = "''" if char == "'" else char
        col = f"replace({col}, '{entity}', '{char}')"
    return col


def stripped(col: str) -> str:
    col = rf"regexp_replace({col}, '<{SPACE}*br{SPACE}*/?>', ' ', 'gi')"
    col = rf"regexp_replace({col}, '<[^>]+>', ' ', 'g')"
    col = rf"regexp_replace({col}, '{SPACE}+', ' ', 'g')"
    return f"trim({decoded(col)}, ' ')"


def cut(col: str, limit: int) -> str:
    return (
        f"CASE WHEN length({col}) > {limit} THEN "
        f"regexp_replace(substr({col}, 1, {limit}), '{SPACE}+$', '') || '…' ELSE {col} END"
    )


def _trimmed(col: str) -> str:
    return f"regexp_replace({col}, '^{SPACE}+|{SPACE}+$', '', 'g')"


_MONTHS = """['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre',
  'octubre', 'noviembre', 'diciembre']"""
_SHORT = "['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic']"
_MILLIONS = "rtrim(rtrim(format('{:,.2f}', ((p * size * 100 + 5000) // 10000) / 100.0), '0'), '.')"
_PLATFORM = """CASE WHEN page_id % 13 = 0 THEN 'generic' ELSE CASE page_id % 6
  WHEN 0 THEN 'tiendanube' WHEN 1 THEN 'tiendanube' WHEN 2 THEN 'tiendanube'
  WHEN 3 THEN 'shopify' WHEN 4 THEN 'woocommerce' ELSE 'generic' END END"""

SQL = {
    "price_parse": f"""WITH {PART_SQL} SELECT pk, CAST(CASE pk % 12 WHEN 0 THEN p WHEN 1 THEN p
      WHEN 2 THEN p + 0.5 WHEN 3 THEN p + 0.5 WHEN 5 THEN CAST(p AS DOUBLE)
      WHEN 6 THEN p WHEN 7 THEN p WHEN 8 THEN -p - 0.2
      WHEN 9 THEN 10000 + p + 0.75 END AS DOUBLE) AS price FROM c""",
    "price_format": f"""WITH {PART_SQL}, a AS (SELECT *, CASE WHEN pk % 10 <> 0
      THEN CAST(floor((p * size * 137 - 600000 + 50) / 100.0) AS BIGINT) END AS whole FROM c)
    SELECT pk, '$' || replace(format('{{:,}}', whole), ',', '.') AS es,
      COALESCE('$' || format('{{:,}}', whole), '—') AS en,
      replace(format('{{:,}}', CASE WHEN pk % 7 = 0 THEN 0 ELSE p * 1000 END), ',', '.') AS units,
      '$' || translate({_MILLIONS}, ',.', '.,') || ' M' AS millions,
      '$' || {_MILLIONS} || ' M' AS millions_en FROM a""",
    "clean_price": f"""WITH {PART_SQL} SELECT pk, CASE WHEN pk % 11 <> 0 THEN '$' || p ||
      CASE WHEN pk % 3 = 1 THEN ',36' ELSE '' END END AS short FROM c""",
    "minor_unit_price": f"""WITH {PART_SQL} SELECT pk, CASE WHEN pk % 6 < 4 THEN
      p * 100 / CASE pk % 4 WHEN 1 THEN 10.0 WHEN 3 THEN 1000.0 ELSE 100.0 END END AS price
    FROM c""",
    "page_text": f"""SELECT page_id, {stripped('html')} AS body,
      {decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
      {cut(stripped('html'), 150)} AS summary FROM pages""",
    "document_text": f"""WITH d AS (SELECT doc_id, {stripped(
      "'<div>&iacute;&amp;lt;<BR />' || text || ' &nbsp;&#039;</div>'")} AS body FROM documents)
    SELECT doc_id, length(body) AS chars, sha256(body) AS body_sha256, {cut('body', 90)} AS summary FROM d""",
    "meta_lookup": f"""WITH p AS (SELECT page_id,
      regexp_extract(html, '<title>([^<&]*)', 1) AS t FROM pages)
    SELECT page_id, {_trimmed('''CASE WHEN page_id % 2 = 0 THEN 'A & ' || t
      ELSE 'B "' || replace(t, '\\'', '') END'''.replace("'\\''", "''''"))} AS og_title,
      '' AS empty, CAST(NULL AS VARCHAR) AS missing FROM p""",
    "page_classify": f"SELECT page_id, {_PLATFORM} AS platform FROM pages",
    "feed_classify": f"""WITH {PART_SQL} SELECT store_id, k // 50 AS page,
      CASE WHEN (k // 50) % 3 = 1 THEN NULL WHEN pk % 4 = 0 THEN 'shopify' ELSE 'woocommerce' END
      AS platform FROM c WHERE pk % 4 < 2 GROUP BY ALL""",
    "page_brand": """WITH w AS (SELECT page_id, regexp_extract(url, '//([a-z.-]+)', 1) AS word
      FROM pages)
    SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'Site é' ELSE CASE page_id % 6
      WHEN 0 THEN 'Shop ' || substr(regexp_replace(word, '[^a-z]', '', 'g'), 1, 5)
      WHEN 1 THEN CASE WHEN contains(word, '-') THEN regexp_extract(word, '[^-]*$') ELSE word END
      WHEN 2 THEN regexp_extract(word, '[^-]*$')
      WHEN 3 THEN regexp_extract(word, '[^-]*$') || ' & co'
      WHEN 4 THEN 'x' ELSE regexp_extract(regexp_replace(word, '^www\\.', ''), '^[^.]*') END END
      AS brand FROM w""",
    "page_brand_found": rf"""WITH t AS (SELECT page_id,
        {decoded("regexp_extract(html, '<title>([^<]+)</title>', 1)")} AS t FROM pages)
    SELECT page_id, CASE
      WHEN regexp_matches(t, '^[^:|–\-]{{2,25}}:{SPACE}')
        THEN {_trimmed(f"regexp_extract(t, '^([^:|–{chr(92)}-]{{2,25}}):{SPACE}', 1)")}
      WHEN length({_trimmed(f"regexp_extract(t, '[{chr(92)}-–|]{SPACE}*([^{chr(92)}-–|]+){SPACE}*$', 1)")}) > 1
        THEN {_trimmed(f"regexp_extract(t, '[{chr(92)}-–|]{SPACE}*([^{chr(92)}-–|]+){SPACE}*$', 1)")}
      ELSE COALESCE(nullif({_trimmed(f"regexp_extract(t, '[^{chr(92)}-–|]*$')")}, ''), {_trimmed('t')})
      END AS brand FROM t""",
    "page_urls": """SELECT page_id,
      CASE WHEN page_id % 2 = 0 THEN regexp_replace('https://' || regexp_replace(url,
        '^https?://', ''), '/+$', '') ELSE regexp_replace(url || '//', '/+$', '') END AS normal,
      regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin,
      regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host,
      regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[^A-Za-z0-9]+', '_',
        'g') || '.html' AS page_key,
      regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS segment FROM pages""",
    "page_currency": """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ARS' END AS structured,
      CASE page_id % 4 WHEN 1 THEN 'CLP' WHEN 2 THEN 'EUR' END AS storefront FROM pages""",
    "slug_labels": """SELECT c_custkey, CASE c_custkey % 5
      WHEN 0 THEN 'Nandu_Cafe_' || regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g')
      WHEN 1 THEN c_mktsegment || '_Uber' WHEN 2 THEN 'marca' WHEN 3 THEN 'marca'
      ELSE regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g') END AS slug FROM customer""",
    "date_labels": f"""WITH o AS (SELECT o_orderkey,
      o_orderdate + to_minutes(o_orderkey % 1440) AS t FROM orders)
    SELECT o_orderkey, strftime(t, '%d') || ' de ' || {_MONTHS}[month(t)] || ' de ' ||
        strftime(t, '%Y · %H:%M') || ' hs' AS es, strftime(t, '%B %d, %Y · %I:%M %p') AS en,
      strftime(t, '%d ') || {_SHORT}[month(t)] AS short_es, strftime(t, '%b %d') AS short_en,
      strftime(t, '%Y-%m-%d_%H%M') AS stamp FROM o""",
    "image_resolve": f"""WITH {PART_SQL}, r AS (SELECT pk, base, CASE pk % 7
      WHEN 0 THEN 'https://cdn.example.com/' || pk || '.jpg'
      WHEN 2 THEN 'https://x.example.com/' || pk WHEN 4 THEN 'https://y.example.com/' || pk
      WHEN 5 THEN 'http://z.example.com/' || pk END AS without_base FROM c)
    SELECT pk, CASE WHEN pk % 7 = 1 THEN base || '/img/' || pk || '.png' ELSE without_base END
      AS with_base, without_base FROM r""",
    "image_rewrite": f"""WITH {PART_SQL} SELECT pk, '<img src="https://d' || pk ||
      '.mitiendanube.com/f' || pk || '-320-320.webp"><img src="https://cdn.shopify.com/s/' || pk ||
      '.png' || CASE pk % 5 WHEN 1 THEN '?v=12&width=320' WHEN 2 THEN '?width=320&v=3'
      WHEN 3 THEN '?v=1&width=320&x=2' ELSE '?width=320' END ||
      '"> https://other.com/a-10-20.jpg' AS html FROM c""",
    "page_nodes": f"""WITH {PART_SQL} SELECT base || '/p/g-' || pk || '/' AS url,
      CAST(CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS BIGINT)
        AS nodes,
      CAST(CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS BIGINT)
        AS products,
      CASE k % 6 WHEN 1 THEN type || '|' || brand ELSE '' END AS crumbs FROM c WHERE pk % 4 = 3""",
    "offer_folding": f"""WITH {PART_SQL} SELECT base || '/p/g-' || pk || '/' AS url,
      CAST(CASE k % 6 WHEN 0 THEN p + 0.5 WHEN 1 THEN p WHEN 2 THEN p WHEN 5 THEN 1 END AS DOUBLE)
        AS low,
      CAST(CASE k % 6 WHEN 0 THEN p + 0.5 WHEN 1 THEN p + 100.5 WHEN 2 THEN p + 10
        WHEN 5 THEN 1 END AS DOUBLE) AS high,
      CASE k % 6 WHEN 0 THEN 'ARS' WHEN 1 THEN 'UYU' END AS currency,
      CASE k % 6 WHEN 0 THEN true WHEN 1 THEN false END AS available FROM c WHERE pk % 4 = 3""",
}

QUERIES = {name: globals()[name] for name in SQL}

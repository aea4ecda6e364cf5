"""Sitemap queries on documents rendered from `part`, with their SQL counterparts.

Part pk is on site `pk % 4`-`pk div 32000`: a site grows to 8,000 pages in 2,000 leaf maps,
then sites grow in number. Every site has a root index, middle indexes and leaf
maps. The root is declared in robots.txt where pk % 4 is 0 or 1 and lies at the usual
address elsewhere; it lists the leaves directly where pk % 4 is 2. Sites of remainder
3 list no product-like address, so all their pages count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.sources import sitemaps as maps
from workload import captures
from workload.captures import PART_SQL
from workload.sales_queries import tidy
from workload.snapshots import written_once

# A leaf lists 4 pages of a store, a middle index 20 leaves.
LEAF = 4
MIDDLE = LEAF * 20
SITE = 8000

_URL = """CASE pk % 4
  WHEN 3 THEN concat(base, '/hoja/', pk)
  WHEN 2 THEN concat(base, CASE WHEN k % 7 = 0 THEN '/mx/productos/' WHEN k % 11 = 0
    THEN '/notas/' ELSE '/productos/' END, 'a-', pk, '/')
  ELSE concat(base, CASE k % 5 WHEN 0 THEN '/blog/' WHEN 1 THEN '/Producto/'
    WHEN 2 THEN '/x-p-' WHEN 3 THEN '/item/' ELSE '/p/' END, pk) END"""


def _entry(loc: Column) -> Column:
    return F.concat(F.lit("<x><loc> "), loc, F.lit(" </loc></x>"))


def _document(rows: DataFrame, url: str, tag: str) -> DataFrame:
    """One XML document per `url` from rows with `place` and `loc`."""
    return (
        rows.groupBy("store_id", "base", F.expr(url).alias("url"))
        .agg(F.array_sort(F.collect_set(F.struct("place", "loc"))).alias("items"))
        .select(
            "store_id",
            "url",
            F.concat(
                F.lit(f"<?xml?><{tag}>"),
                F.array_join(F.transform("items.loc", _entry), ""),
                F.lit(f"</{tag}>"),
            ).alias("xml"),
        )
    )


def _parts(spark, sf) -> DataFrame:
    return captures.parts(spark, sf).selectExpr(
        "pk",
        f"concat(pk % 4, '-', pk DIV {4 * SITE}) AS store_id",
        f"concat('https://s', pk % 4, '-', pk DIV {4 * SITE}, '.example.com') AS base",
        f"pk DIV 4 % {SITE} AS k",
        "pk % 4 AS kind",
    )


def _robots(spark, sf) -> DataFrame:
    bases = _parts(spark, sf).select("store_id", "base", "kind").distinct()
    declared = F.concat(
        F.lit("User-agent: *\n  Sitemap:  "), "base", F.lit("/maps/root.xml\nDisallow: /x\n")
    )
    return bases.withColumn("body", F.when(F.col("kind") < 2, declared)).drop("kind")


def _sitemaps(spark, sf) -> DataFrame:
    return written_once(spark, sf, "sitemaps", lambda: _render_sitemaps(spark, sf))


def _render_sitemaps(spark, sf) -> DataFrame:
    pages = _parts(spark, sf).selectExpr(
        "store_id",
        "base",
        "pk",
        "k",
        "kind",
        f"k DIV {LEAF} AS leaf",
        f"k DIV {MIDDLE} AS middle",
        "concat(base, CASE WHEN pk % 4 < 2 THEN '/maps/root.xml' ELSE '/sitemap.xml' END) AS root",
        f"{_URL} AS page",
    )
    leaves = _document(
        pages.selectExpr("*", "k AS place", "page AS loc"),
        "concat(base, '/maps/leaf', leaf, '.xml?v=1')",
        "urlset",
    )
    to_leaves = pages.selectExpr(
        "*", "leaf AS place", "concat(base, '/maps/leaf', leaf, '.xml?v=1') AS loc"
    )
    # a middle index also names the root again, a map that was never saved, and a page
    extra = pages.selectExpr(
        "*",
        "-1L AS place",
        "explode(array(root, concat(base, '/maps/lost.xml'), concat(base, '/about'))) AS loc",
    )
    middles = _document(
        to_leaves.unionByName(extra), "concat(base, '/maps/middle', middle, '.xml')", "sitemapindex"
    )
    to_middles = pages.where("kind <> 2").selectExpr(
        "*", "middle AS place", "concat(base, '/maps/middle', middle, '.xml') AS loc"
    )
    roots = _document(
        to_middles,
        "root",
        "SitemapIndex",
    )
    direct = _document(to_leaves.where("kind = 2"), "root", "sitemapindex")
    return leaves.unionByName(middles).unionByName(roots).unionByName(direct)


def _listed(spark, sf):
    saved = maps.location_table(_sitemaps(spark, sf))
    reachable = maps.reachable_sitemaps(_robots(spark, sf), saved)
    return maps.listed_urls(reachable, saved)


def _bases(spark, sf):
    return _parts(spark, sf).select("store_id", "base").distinct()


def sitemap_locations(spark, sf):
    return maps.sitemap_locations(_sitemaps(spark, sf)).select("store_id", "url", "is_index", "loc")


def sitemap_seeds(spark, sf):
    return tidy(maps.sitemap_seeds(_robots(spark, sf)))


def sitemap_documents(spark, sf):
    saved = _sitemaps(spark, sf)
    found = maps.reachable_sitemaps(_robots(spark, sf), saved)
    return tidy(found.select("store_id", "url", F.size("path").alias("depth")))


def sitemap_urls(spark, sf):
    return _listed(spark, sf).select("store_id", "url")


def product_urls(spark, sf):
    """Product pages, and all pages of the stores without any."""
    return maps.product_urls(_listed(spark, sf), _bases(spark, sf))


def local_product_urls(spark, sf):
    return maps.sorted_urls(maps.local_product_urls(_bases(spark, sf), _sitemaps(spark, sf)))


def first_urls(spark, sf):
    return maps.first_urls(_listed(spark, sf).select("store_id", "url"), 25)


_PAGES = f"""WITH {PART_SQL}, d AS (
  SELECT pk, (pk % 4) || '-' || (pk // {4 * SITE}) AS store_id, (pk // 4) % {SITE} AS k,
         'https://s' || (pk % 4) || '-' || (pk // {4 * SITE}) || '.example.com' AS base FROM c
), page AS (
  SELECT *, k // {LEAF} AS leaf, k // {MIDDLE} AS middle, CASE pk % 4
  WHEN 3 THEN base || '/hoja/' || pk
  WHEN 2 THEN base || CASE WHEN k % 7 = 0 THEN '/mx/productos/' WHEN k % 11 = 0 THEN '/notas/'
    ELSE '/productos/' END || 'a-' || pk || '/'
  ELSE base || CASE k % 5 WHEN 0 THEN '/blog/' WHEN 1 THEN '/Producto/' WHEN 2 THEN '/x-p-'
    WHEN 3 THEN '/item/' ELSE '/p/' END || pk END AS url,
  base || CASE WHEN pk % 4 < 2 THEN '/maps/root.xml' ELSE '/sitemap.xml' END AS root FROM d
)
"""

SQL = {
    "sitemap_locations": _PAGES
    + """, m AS (
      SELECT *, base || '/maps/leaf' || leaf || '.xml?v=1' AS leaf_url,
             base || '/maps/middle' || middle || '.xml' AS middle_url FROM page)
    SELECT store_id, leaf_url AS url, false AS is_index, url AS loc FROM m
    UNION ALL SELECT DISTINCT store_id, middle_url, true, leaf_url FROM m
    UNION ALL SELECT DISTINCT store_id, middle_url, true,
      unnest([root, base || '/maps/lost.xml', base || '/about']) FROM m
    UNION ALL SELECT DISTINCT store_id, root, true,
      CASE WHEN pk % 4 = 2 THEN leaf_url ELSE middle_url END FROM m""",
    "sitemap_seeds": _PAGES
    + """, b AS (SELECT DISTINCT store_id, base, pk % 4 < 2 AS d FROM page)
    SELECT store_id, base || '/maps/root.xml' AS url, CAST(0 AS BIGINT) AS place FROM b WHERE d
    UNION ALL SELECT store_id, base || '/sitemap.xml', CASE WHEN d THEN 1 ELSE 0 END FROM b
    UNION ALL SELECT store_id, base || '/sitemap_index.xml', CASE WHEN d THEN 2 ELSE 1 END FROM b
    UNION ALL SELECT store_id, base || '/wp-sitemap.xml', CASE WHEN d THEN 3 ELSE 2 END FROM b""",
    "sitemap_documents": _PAGES
    + """SELECT DISTINCT store_id, root AS url, CAST(1 AS BIGINT) AS depth FROM page
    UNION SELECT store_id, base || '/maps/middle' || middle || '.xml', 2 FROM page WHERE pk % 4 <> 2
    UNION SELECT store_id, base || '/maps/leaf' || leaf || '.xml?v=1',
      CASE WHEN pk % 4 = 2 THEN 2 ELSE 3 END FROM page""",
    "sitemap_urls": _PAGES + "SELECT store_id, url FROM page",
    "product_urls": _PAGES
    + """SELECT store_id, url, false AS sampled FROM page
      WHERE pk % 4 < 2 AND k % 5 <> 0 OR pk % 4 = 2 AND (k % 7 = 0 OR k % 11 <> 0)
    UNION ALL SELECT store_id, url, true FROM page WHERE pk % 4 = 3""",
    "local_product_urls": _PAGES
    + "SELECT store_id, url FROM page WHERE pk % 4 = 2 AND k % 7 <> 0 AND k % 11 <> 0",
    "first_urls": _PAGES
    + """SELECT store_id, url FROM page
    QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY url) <= 25""",
}

QUERIES = {name: globals()[name] for name in SQL}

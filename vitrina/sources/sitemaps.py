"""Saved robots files and sitemaps as product addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.pages import is_local_product_url, is_product_url
from vitrina.functions.text import trim
from vitrina.operators.ordering import first_n
from vitrina.operators.rows import join_stores
from vitrina.session import cut_lineage, written_table

# Where a sitemap is looked for.
DEFAULT_SITEMAPS = ["/sitemap.xml", "/sitemap_index.xml", "/wp-sitemap.xml"]

LOC = "<loc>([^<]+)</loc>"
IS_INDEX = "(?i)<sitemapindex"
IS_XML = r"\.xml($|\?)"
ROBOTS_SITEMAP = r"(?im)^\s*sitemap:\s*(\S+)"


def read_locations(sitemaps: DataFrame) -> DataFrame:
    """One row per sitemap document with the array `locs` of its `<loc>` texts, in document order."""
    locs = F.transform(F.regexp_extract_all("xml", F.lit(LOC), F.lit(1)), trim)
    return sitemaps.select("store_id", "url", F.col("xml").rlike(IS_INDEX).alias("is_index"), locs.alias("locs"))


def location_table(sitemaps: DataFrame) -> DataFrame:
    """`read_locations`, written: the XML is searched once and every consumer reads the table.

    A table that is one already is given back as it is.
    """
    if "locs" in sitemaps.columns:
        return sitemaps
    return written_table(read_locations(sitemaps), "locations")


def exploded(locations: DataFrame, *more: str) -> DataFrame:
    """One row per location; whatever documents are joined with is joined before this."""
    return locations.select("store_id", "url", *more, "is_index", F.posexplode("locs").alias("place", "loc"))


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """Every `<loc>` of every sitemap document, in document order."""
    return exploded(sitemaps if "locs" in sitemaps.columns else read_locations(sitemaps))


def sitemap_seeds(robots: DataFrame) -> DataFrame:
    """Sitemaps a store declares in robots.txt, then the usual addresses.

    `robots(store_id, base, body)` has one row per store; a missing file is a null body.
    """
    declared = F.regexp_extract_all(
        F.coalesce("body", F.lit("")), F.lit(ROBOTS_SITEMAP), F.lit(1)
    )
    usual = F.array(*[F.concat("base", F.lit(path)) for path in DEFAULT_SITEMAPS])
    return robots.select(
        "store_id", F.posexplode(F.concat(declared, usual)).alias("place", "url")
    )


def reachable_sitemaps(
    robots: DataFrame, sitemaps: DataFrame, max_documents: int | None = None
) -> DataFrame:
    """Documents found breadth-first from the seeds, each with its `path` of places.

    All saved documents count, or only the first `max_documents` of each store. `sitemaps` are
    saved documents or their `location_table`. One step per level of the site, with the set of
    documents seen so far: recursive SQL has only UNION ALL here, which would walk every path
    through indexes that name each other.
    """
    locations = location_table(sitemaps)
    known = locations.select("store_id", "url").distinct()
    # short rows: the links between documents only
    children = cut_lineage(
        exploded(locations.where("is_index"))
        .where(F.col("loc").rlike(IS_XML))
        .select("store_id", "url", "place", "loc")
    )
    earliest = F.min("path").alias("path")
    frontier = cut_lineage(
        sitemap_seeds(robots)
        .withColumn("path", F.array("place"))
        .groupBy("store_id", "url")
        .agg(earliest)
        .join(known, ["store_id", "url"], "left_semi")
    )
    found = frontier
    while not frontier.isEmpty():
        step = (
            frontier.join(children, ["store_id", "url"])
            .select(
                "store_id",
                F.col("loc").alias("url"),
                F.concat("path", F.array("place")).alias("path"),
            )
            .groupBy("store_id", "url")
            .agg(earliest)
            .join(known, ["store_id", "url"], "left_semi")
            .join(found, ["store_id", "url"], "left_anti")
        )
        frontier = cut_lineage(step)
        found = found.unionByName(frontier)
    if max_documents is None:
        return found
    order = [F.size("path"), F.col("path")]
    return first_n(found, ["store_id"], order, max_documents).drop("rank")


def listed_urls(reachable: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Distinct page addresses, with the place each was first listed at."""
    leaves = location_table(sitemaps).where(~F.col("is_index"))
    return (
        exploded(leaves.join(reachable, ["store_id", "url"]), "path")
        .select(
            "store_id",
            F.col("loc").alias("url"),
            F.struct(F.size("path").alias("depth"), "path", "place").alias("listed_at"),
        )
        .groupBy("store_id", "url")
        .agg(F.min("listed_at").alias("listed_at"))
    )


def product_urls(listed: DataFrame, bases: DataFrame, sample: int | None = None) -> DataFrame:
    """Product addresses of each store; a store without any gives all its pages, or the first `sample`.

    `bases(store_id, base)` has one row per store.
    """
    urls = join_stores(listed, bases, ["url"]).withColumn(
        "is_product", is_product_url(F.col("url"), F.col("base"))
    )
    chosen = urls.where("is_product")
    known = chosen.select("store_id").distinct()
    unclear = join_stores(urls, known, ["url"], "left_anti")
    sampled = unclear.where(F.startswith("url", "base"))
    if sample is not None:
        sampled = first_n(sampled, ["store_id"], [F.col("listed_at")], sample)
    return chosen.select("store_id", "url", F.lit(False).alias("sampled")).unionByName(
        sampled.select("store_id", "url", F.lit(True).alias("sampled"))
    )


def local_product_urls(
    bases: DataFrame, sitemaps: DataFrame, max_child_maps: int | None = None
) -> DataFrame:
    """Tienda Nube: product pages of the root sitemap, or of its child maps (the first few if limited)."""
    root = bases.select("store_id", "base", F.concat("base", F.lit("/sitemap.xml")).alias("url"))
    locations = location_table(sitemaps)
    top = locations.join(root, ["store_id", "url"])
    child_maps = exploded(top.where("is_index"), "base").where(F.col("loc").rlike(IS_XML))
    if max_child_maps is not None:
        child_maps = first_n(child_maps, ["store_id"], [F.col("place")], max_child_maps)
    # a child map that is named twice is read once
    child_maps = child_maps.select("store_id", "base", F.col("loc").alias("url")).distinct()
    leaves = locations.join(child_maps, ["store_id", "url"])
    pages = exploded(top.where(~F.col("is_index")).unionByName(leaves), "base")
    return (
        pages.where(is_local_product_url(F.col("loc"), F.col("base")))
        .select("store_id", F.col("loc").alias("url"))
        .distinct()
    )


def sorted_urls(urls: DataFrame) -> DataFrame:
    """Distinct addresses in address order."""
    return urls.select("store_id", "url").distinct().orderBy("store_id", "url")


def first_urls(urls: DataFrame, limit: int) -> DataFrame:
    """The first addresses of each store in address order."""
    return first_n(urls, ["store_id"], [F.col("url")], limit).drop("rank")

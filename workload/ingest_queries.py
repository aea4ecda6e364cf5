"""Snapshot documents: written from tables, read back, and rejected when damaged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.dates import output_name
from vitrina.plans import sales
from vitrina.session import joined_in_place, scratch_path, written_table
from vitrina.sources import export
from vitrina.sources.snapshots import load_snapshots, parse_documents
from vitrina.sources.tables import read_observations, write_observations
from workload import captures
from workload.captures import PART_SQL
from workload.catalog_queries import CATALOG
from workload.sales_queries import SNAP, SOLD_ORDER, tidy
from workload.sales_queries import SQL as SALES_SQL
from workload.snapshots import PART_KEYS, SHELF, shelved_observations, snapshots, written_once


def documents(spark, sf) -> DataFrame:
    """Snapshot documents of the derived stores; every other snapshot is an HTML report."""
    with joined_in_place(spark):
        return written_once(spark, sf, "documents", lambda: _documents(spark, sf))


def _documents(spark, sf) -> DataFrame:
    product = F.struct(
        "pos",
        F.col("product_id").alias("id"),
        "name",
        "price",
        "stock",
        F.col("sold_qty").alias("soldQty"),
        "available",
    )
    key = [*SHELF, "snap_ord", "scraped_at"]
    header = snapshots(spark, sf).select("store_id", "snap_ord", "brand", "platform", "currency")
    rows = (
        shelved_observations(spark, sf)
        .groupBy(*key)
        .agg(F.array_sort(F.collect_list(product)).alias("products"))
        .join(header, ["store_id", "snap_ord"])
    )
    millis = F.unix_millis("scraped_at").cast("string")
    json = F.to_json(
        F.struct(
            "platform",
            "brand",
            "currency",
            F.when(F.col("snap_ord") % 3 == 0, millis)
            .otherwise(F.date_format("scraped_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .alias("scrapedAt"),
            "products",
        )
    )
    html = F.concat(
        F.lit('<!doctype html><html><head><script type="application/json" id="scrap-data">'),
        json,
        F.lit('</script><script>"</script>"</script></head></html>'),
    )
    is_html = F.col("snap_ord") % 2 == 0
    name = F.concat(
        F.date_format("scraped_at", "yyyyMMdd"),
        F.format_string(".part%05d", F.col("part")),
        F.when(is_html, ".html").otherwise(".json"),
    )
    return rows.select(
        "store_id",
        "snap_ord",
        "part",
        name.alias("source_file"),
        F.when(is_html, html).otherwise(json).alias("body"),
    )


def damaged_documents(spark, sf) -> DataFrame:
    """The same documents with a different fault in six of ten snapshots, two faults in a seventh."""
    case = (F.col("snap_ord") + F.col("store_id").cast("int")) % 10
    undated = F.regexp_replace("body", '"scrapedAt":"?[^",]*"?,', "")
    body = F.col("body")
    broken = (
        F.when(case == 0, F.concat(F.lit("x"), F.replace(body, F.lit("{"), F.lit("("))))
        .when(case == 1, F.regexp_replace(body, '"scrapedAt":"[^"]*",', ""))
        .when(case == 2, F.lit("<html><body>no data here</body></html>"))
        .when(case == 3, F.regexp_replace(body, r'(\[\{"pos":\d+,)"id":"\d+",', "$1"))
        .when(case == 4, F.regexp_replace(body, r'(?s)"products":\[.*\]\}', '"products":[]}'))
        .when(case == 5, F.regexp_replace(body, '"scrapedAt":"[^"]*"', '"scrapedAt":"some day"'))
        .when(case == 6, F.regexp_replace(undated, r'("pos":\d+,)"id":"\d+",', "$1"))
        .otherwise(body)
    )
    return documents(spark, sf).withColumn("body", broken)


def snapshot_scan(spark, sf):
    parsed = parse_documents(documents(spark, sf))
    return tidy(
        parsed.select(
            "store_id", "source_file", "scraped_at", "brand", "platform", "currency", "n_products"
        )
    )


def snapshot_ingest(spark, sf):
    loaded = load_snapshots(documents(spark, sf))
    return tidy(
        loaded.observations.select(
            "store_id", "snap_ord", "product_id", "name", "price", "stock", "sold_qty", "available"
        )
    )


def snapshot_headers(spark, sf):
    loaded = load_snapshots(documents(spark, sf)).snapshots
    return tidy(
        loaded.select("store_id", "snap_ord", "scraped_at", "platform", "currency", "n_products")
    )


def snapshot_rejects(spark, sf):
    rejects = load_snapshots(damaged_documents(spark, sf)).rejects
    return rejects.select("store_id", "source_file", F.array_join("errors", "; ").alias("errors"))


def snapshot_ingest_valid(spark, sf):
    loaded = load_snapshots(damaged_documents(spark, sf))
    rows = loaded.observations.groupBy("store_id", "snapshot_id", "snap_ord").agg(
        F.count(F.lit(1)).alias("products")
    )
    return tidy(rows)


def snapshot_export(spark, sf):
    rows = export.snapshot_rows(captures.stores(spark, sf), captures.catalog(spark, sf))
    return tidy(rows.withColumn("sizes", F.array_join("variants.size", "|")).drop("pos", "variants"))


def snapshot_documents(spark, sf):
    """Written as documents of at most 40 products and read back in catalog order."""
    written = export.snapshot_documents(
        captures.stores(spark, sf), captures.catalog(spark, sf), max_products=40
    )
    loaded = load_snapshots(written).observations
    place = F.shiftright("pos", 40) * 40 + F.col("pos") % (1 << 40) + 1
    return tidy(
        loaded.select(
            "store_id", "snapshot_id", place.alias("place"), "product_id", "price", "stock", "sold_qty"
        )
    )


def _stored(spark, sf):
    """Documents read and stored by day: the tables that a comparison starts from."""
    loaded = load_snapshots(documents(spark, sf))
    path = scratch_path(spark, "stored_observations")
    write_observations(loaded.observations, path)
    return path, written_table(loaded.snapshots, "stored_snapshots")


_stores: dict[tuple[str, str], tuple] = {}


def _report(spark, sf):
    """A new report on tables that were stored once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _stores:
        _stores[key] = _stored(spark, sf)
    path, heads = _stores[key]
    return sales.sales_report(read_observations(spark, path), heads)


def report_kpis(spark, sf):
    """All the way from the documents."""
    path, heads = _stored(spark, sf)
    return tidy(sales.sales_report(read_observations(spark, path), heads)["kpis"])


def report_displayed(spark, sf):
    return tidy(_report(spark, sf)["displayed_kpis"])


def report_method(spark, sf):
    return _report(spark, sf)["method"]


def report_products(spark, sf):
    return tidy(_report(spark, sf)["product_detail"].drop("first_sale"))


def report_trend(spark, sf):
    return tidy(_report(spark, sf)["period_trend"].select("store_id", "period", "sold"))


def report_top_sellers(spark, sf):
    top = _report(spark, sf)["top_sellers"]
    return tidy(top.select("store_id", "rank", "product_id", "name", "sold", "from_stock", "to_stock"))


def report_top_revenue(spark, sf):
    top = _report(spark, sf)["top_revenue"]
    return tidy(top.select("store_id", "rank", "product_id", "name", "revenue"))


def report_restocks(spark, sf):
    return tidy(_report(spark, sf)["restocks"].drop("first_restock"))


def report_new_products(spark, sf):
    return tidy(_report(spark, sf)["new_products"].drop("pos"))


def report_availability(spark, sf):
    return _report(spark, sf)["availability_changes"].drop("pos")


def report_lifetime(spark, sf):
    return tidy(_report(spark, sf)["lifetime_best_sellers"].drop("pos"))


def report_brand_conflicts(spark, sf):
    """Every fourth store's documents are of two shops."""
    odd = (F.col("store_id").cast("int") % 4 == 1) & (F.col("snap_ord") % 5 == 2)
    renamed = F.regexp_replace("body", '"brand":"[^"]*"', '"brand":"Somewhere else"')
    shouted = F.regexp_replace("body", '"brand":"Brand ', '"brand":"BRAND ')
    body = F.when(odd, renamed).when(F.col("snap_ord") % 3 == 1, shouted).otherwise(F.col("body"))
    loaded = load_snapshots(documents(spark, sf).withColumn("body", body))
    return sales.sales_report(loaded.observations, loaded.snapshots)["brand_conflicts"]


def output_names(spark, sf):
    shops = captures.stores(spark, sf)
    name = output_name(export.REPORT_KIND, F.concat("brand", F.lit(" Ñandú")), F.col("scraped_at"))
    return shops.select("store_id", name.alias("report_name"))


_FILE = (
    "strftime(scraped_at, '%Y%m%d') || printf('.part%05d', part) || "
    "CASE WHEN snap_ord % 2 = 0 THEN '.html' ELSE '.json' END"
)
_DOCS = (
    SNAP
    + f""", docs AS (
  SELECT store_id, snap_ord, scraped_at, pos // {PART_KEYS} AS part, count(*) AS n_products
  FROM snap GROUP BY 1, 2, 3, 4
), faults AS (
  SELECT *, (snap_ord + CAST(store_id AS INT)) % 10 AS fault, {_FILE} AS source_file,
         snap_ord % 3 = 0 AS millis
  FROM docs
)
"""
)

_STORES = """, shops AS (
  SELECT DISTINCT store_id, 'https://s' || store_id || '.example.com' AS source,
    CASE WHEN CAST(store_id AS INT) % 2 = 0 THEN 'Marketing name of shop ' ELSE 'S' END
      || store_id AS brand,
    strftime(TIMESTAMP '2026-08-01 12:30:00' + to_days(CAST(store_id AS INT)),
             '%Y-%m-%d_%H%M') AS stamp FROM c
)
"""
_SNAPSHOT_ID = "'Catalog_' || replace(shops.brand, ' ', '_') || '_' || stamp AS snapshot_id"

SQL = {
    "snapshot_scan": _DOCS
    + """SELECT store_id, source_file, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at,
    brand, platform, currency, n_products
    FROM faults JOIN (SELECT store_id, snap_ord, brand, platform, currency FROM dim)
    USING (store_id, snap_ord)""",
    "snapshot_ingest": SNAP
    + """SELECT store_id, snap_ord, product_id, name, CAST(price AS DOUBLE) AS price,
    CAST(stock AS DOUBLE) AS stock, CAST(sold_qty AS DOUBLE) AS sold_qty, available FROM snap""",
    "snapshot_headers": SNAP
    + """SELECT store_id, snap_ord, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at,
    platform, currency, (SELECT count(*) FROM snap s WHERE s.store_id = dim.store_id
      AND s.snap_ord = dim.snap_ord) AS n_products FROM dim""",
    "snapshot_rejects": _DOCS
    + """SELECT store_id, source_file, CASE fault
      WHEN 0 THEN CASE WHEN snap_ord % 2 = 0 THEN 'not valid JSON' ELSE 'not valid JSON' END
      WHEN 1 THEN 'no "scrapedAt"' WHEN 2 THEN 'HTML without an embedded dataset'
      WHEN 3 THEN '1 product(s) without "id"' WHEN 4 THEN '"products" is empty'
      WHEN 5 THEN '"scrapedAt" is not a date: some day'
      ELSE 'no "scrapedAt"; ' || n_products || ' product(s) without "id"' END AS errors
    FROM faults WHERE fault <= 6""",
    "snapshot_ingest_valid": _DOCS
    + """, kept AS (
      SELECT DISTINCT store_id, snap_ord AS old_ord FROM faults WHERE fault > 6
    ), renumbered AS (
      SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY old_ord) AS snap_ord FROM kept
    )
    SELECT r.store_id, strftime(scraped_at, '%Y%m%d') || CASE WHEN old_ord % 2 = 0 THEN '.html'
      ELSE '.json' END AS snapshot_id, r.snap_ord, count(*) AS products
    FROM renumbered r JOIN snap s ON s.store_id = r.store_id AND s.snap_ord = old_ord
    GROUP BY ALL""",
    "snapshot_export": CATALOG
    + _STORES
    + f"""SELECT store_id, {_SNAPSHOT_ID}, id AS product_id, name, catalog.brand, price,
    stock_total AS stock, sold_qty, available, sizes,
    strftime(strptime(stamp, '%Y-%m-%d_%H%M'), '%Y-%m-%d %H:%M:%S') AS scraped_at
    FROM catalog JOIN shops USING (store_id)""",
    "snapshot_documents": CATALOG
    + _STORES
    + f"""SELECT store_id, {_SNAPSHOT_ID.replace(' AS', " || '.json' AS")}, id AS product_id, price,
    stock_total AS stock, sold_qty, row_number() OVER (PARTITION BY store_id
      ORDER BY available DESC, name, pos, url, id) AS place
    FROM placed JOIN shops USING (store_id)""",
    "report_kpis": SNAP
    + """SELECT * REPLACE (CAST(sold AS DOUBLE) AS sold,
      CAST(lifetime_units AS DOUBLE) AS lifetime_units) FROM kpis""",
    "report_products": SNAP
    + """SELECT store_id, product_id, name, CAST(sold AS DOUBLE) AS sold,
    CAST(revenue AS DOUBLE) AS revenue, CAST(from_stock AS DOUBLE) AS from_stock,
    CAST(to_stock AS DOUBLE) AS to_stock FROM prod JOIN fact USING (product_id) WHERE sold > 0""",
    "report_trend": SNAP
    + """SELECT store_id, period, CAST(trend.sold AS DOUBLE) AS sold FROM trend
    JOIN kpis USING (store_id) WHERE n_scraps >= 3 AND NOT availability_only""",
    "report_displayed": SALES_SQL["displayed_kpis"],
    "report_method": SALES_SQL["method_label"],
    "report_top_sellers": SNAP
    + f"""SELECT store_id, rank, product_id, name, CAST(sold AS DOUBLE) AS sold,
    CAST(from_stock AS DOUBLE) AS from_stock, CAST(to_stock AS DOUBLE) AS to_stock FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {SOLD_ORDER}) AS rank
    FROM prod JOIN fact USING (product_id) WHERE sold > 0 QUALIFY rank <= 14)""",
    "report_top_revenue": SNAP
    + f"""SELECT store_id, rank, product_id, name, CAST(revenue AS DOUBLE) AS revenue FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, {SOLD_ORDER}) AS rank
    FROM prod JOIN fact USING (product_id) WHERE sold > 0 QUALIFY rank <= 8)""",
    "report_restocks": SNAP
    + """SELECT store_id, product_id, name, CAST(restocked AS DOUBLE) AS restock FROM prod
    JOIN fact USING (product_id) WHERE restocked > 0""",
    "report_new_products": SNAP
    + """SELECT store_id, product_id, name, CAST(sold_qty AS DOUBLE) AS sold_qty,
    CAST(COALESCE(stock, 0) AS DOUBLE) AS stock FROM last
    WHERE product_id NOT IN (SELECT product_id FROM first)""",
    "report_availability": SALES_SQL["availability_transitions"],
    "report_lifetime": SNAP
    + """SELECT store_id, product_id, name, CAST(sold_qty AS DOUBLE) AS sold_qty, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sold_qty DESC, pos) AS rank
    FROM last WHERE sold_qty IS NOT NULL QUALIFY rank <= 8)""",
    "report_brand_conflicts": SNAP
    + """, odd AS (
      SELECT store_id, CASE WHEN CAST(store_id AS INT) % 4 = 1 AND snap_ord % 5 = 2 THEN 'Somewhere else'
        WHEN snap_ord % 3 = 1 THEN 'BRAND ' || store_id ELSE brand END AS brand FROM dim
    )
    SELECT DISTINCT store_id, brand FROM odd WHERE store_id IN (
      SELECT store_id FROM odd GROUP BY 1 HAVING count(DISTINCT trim(lower(brand))) > 1)""",
    "output_names": f"WITH {PART_SQL}"
    + _STORES
    + """SELECT store_id, 'Sales_' || replace(brand, ' ', '_') || '_Nandu_' || stamp
    AS report_name FROM shops""",
}

QUERIES = {name: globals()[name] for name in SQL}

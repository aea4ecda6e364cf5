"""Comparison queries on the derived snapshots, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.operators import presence, rollups
from vitrina.operators.pairing import (
    last_rows,
    matched_pairs,
    number_snapshots,
    pair_deltas,
    with_signals,
)
from vitrina.plans import sales
from workload.snapshots import observations, repeated_observations, snapshots

TIME = "yyyy-MM-dd HH:mm:ss"


def tidy(df: DataFrame) -> DataFrame:
    """Plain output types: times as text, money as double, whole units as bigint."""
    out = []
    for field in df.schema.fields:
        kind, col = field.dataType.simpleString(), F.col(f"`{field.name}`")
        if kind.startswith("timestamp"):
            col = F.date_format(col, TIME)
        elif kind.startswith("decimal"):
            col = col.cast("double")
        elif kind == "double":
            col = F.round(col, 4)
        elif kind == "int":
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


# ---- Spark side -----------------------------------------------------------------


def snapshot_order(spark: SparkSession, sf: str) -> DataFrame:
    """Captures numbered anew: two of each, at equal times, that only their file names order."""
    again = F.explode(F.array(F.lit("b"), F.lit("a"))).alias("copy")
    twice = snapshots(spark, sf).select("store_id", "scraped_at", "platform", again)
    numbered = number_snapshots(twice.withColumn("source_file", F.concat("copy", F.lit(".json"))))
    return tidy(numbered.select("store_id", "snap_ord", "scraped_at", "platform", "source_file"))


def snapshot_ends(spark, sf):
    snaps = snapshots(spark, sf)
    return tidy(rollups.store_spans(snaps).select("store_id", "first_at", "last_at", "n_scraps"))


def comparable_stores(spark, sf):
    return sales.comparable_stores(snapshots(spark, sf))


def pair_join(spark, sf):
    return tidy(matched_pairs(observations(spark, sf)).drop("pos", "stock", "sold_qty"))


def signal_deltas(spark, sf):
    pairs = with_signals(matched_pairs(observations(spark, sf)))
    return tidy(pairs.select("product_id", "snap_ord", "sold_delta", "stock_drop"))


def best_signal_units(spark, sf):
    deltas = pair_deltas(observations(spark, sf))
    return tidy(deltas.where(F.col("sold") > 0).select("product_id", "snap_ord", "sold"))


def restock_units(spark, sf):
    deltas = pair_deltas(observations(spark, sf))
    return tidy(deltas.where(F.col("restocked") > 0).select("product_id", "snap_ord", "restocked"))


def start_price_revenue(spark, sf):
    deltas = pair_deltas(observations(spark, sf))
    return tidy(deltas.where(F.col("sold") > 0).select("product_id", "snap_ord", "revenue"))


def last_row_wins(spark, sf):
    rows = last_rows(repeated_observations(spark, sf), "price", "stock", "sold_qty")
    return tidy(rows.select("product_id", "snap_ord", "price", "stock", "sold_qty"))


def repeated_id_totals(spark, sf):
    deltas = pair_deltas(repeated_observations(spark, sf))
    return tidy(
        deltas.groupBy("store_id", "snap_ord").agg(
            F.count(F.lit(1)).alias("pairs"),
            F.sum("sold").alias("sold"),
            F.sum("restocked").alias("restocked"),
            F.sum("revenue").alias("revenue"),
        )
    )


def product_totals(spark, sf):
    totals = rollups.product_totals(pair_deltas(observations(spark, sf)))
    return tidy(
        totals.select(
            "product_id",
            "sold",
            "revenue",
            "restocked",
            F.floor(F.col("first_sale") / 1e19).cast("bigint").alias("first_sale_in"),
            F.floor(F.col("first_restock") / 1e19).cast("bigint").alias("first_restock_in"),
        )
    )


def stock_span(spark, sf):
    facts = rollups.product_facts(observations(spark, sf))
    return tidy(facts.select("product_id", "from_stock", "to_stock"))


def latest_names(spark, sf):
    """Names that change from capture to capture, and go missing in some."""
    at = F.col("snap_ord") + F.col("product_id").cast("int")
    name = F.when(at % 7 == 0, F.lit(None)).when(at % 7 == 1, F.lit("")).otherwise(F.concat("name", F.lit(" v"), "snap_ord"))
    return rollups.product_facts(observations(spark, sf).withColumn("name", name)).select("product_id", "name")


def period_trend(spark, sf):
    return tidy(sales.period_trend(observations(spark, sf), snapshots(spark, sf)))


def _kpis(spark, sf):
    return sales.store_kpis(observations(spark, sf), snapshots(spark, sf))


def trend_listing(spark, sf):
    obs, snaps = observations(spark, sf), snapshots(spark, sf)
    trend = sales.period_trend(obs, snaps)
    shown = sales.listing(sales.trend_listing(trend, sales.store_kpis(obs, snaps)), "period_trend")
    return tidy(shown.select("store_id", "period", "sold"))


def store_kpis(spark, sf):
    return tidy(_kpis(spark, sf))


def displayed_kpis(spark, sf):
    return tidy(sales.displayed_kpis(_kpis(spark, sf)))


def method_label(spark, sf):
    return sales.method_label(_kpis(spark, sf))


def signal_coverage(spark, sf):
    return tidy(
        _kpis(spark, sf).select(
            "store_id", "active", "stock_known", "used_sold_qty", "availability_only"
        )
    )


def _detail(spark, sf):
    obs = observations(spark, sf)
    return sales.product_detail(obs, pair_deltas(obs))


def product_sales_detail(spark, sf):
    return tidy(sales.listing(_detail(spark, sf), "product_detail").drop("first_sale"))


def top_sellers(spark, sf):
    top = sales.bar_share(sales.top_sellers(_detail(spark, sf), sales.TOP_BARS), "sold")
    return tidy(top.select("store_id", "rank", "product_id", "name", "sold", "bar"))


def top_revenue(spark, sf):
    top = sales.bar_share(sales.top_revenue(_detail(spark, sf)), "revenue")
    return tidy(top.select("store_id", "rank", "product_id", "name", "revenue", "bar"))


def restocks(spark, sf):
    obs = observations(spark, sf)
    rows = sales.listing(sales.restock_list(obs, pair_deltas(obs)), "restocks")
    return tidy(rows.select("store_id", "product_id", "name", "restock"))


def new_products(spark, sf):
    rows = presence.new_products(observations(spark, sf), snapshots(spark, sf))
    return tidy(sales.listing(rows, "new_products").drop("pos"))


def discontinued(spark, sf):
    return presence.discontinued_products(observations(spark, sf), snapshots(spark, sf))


def effective_availability(spark, sf):
    flag = presence.effective_availability(
        F.when(F.col("pos") % 3 != 0, F.col("available")), F.col("stock")
    )
    return tidy(
        observations(spark, sf).select("product_id", "snap_ord", flag.alias("is_available"))
    )


def availability_transitions(spark, sf):
    rows = presence.availability_changes(observations(spark, sf), snapshots(spark, sf))
    return sales.listing(rows, "availability_changes").drop("pos")


def lifetime_best_sellers(spark, sf):
    return tidy(
        presence.lifetime_best_sellers(observations(spark, sf), snapshots(spark, sf)).drop("pos")
    )


def lifetime_units(spark, sf):
    last = presence.last_slice(observations(spark, sf), snapshots(spark, sf))
    return last.groupBy("store_id").agg(
        F.sum(F.coalesce("sold_qty", F.lit(0))).alias("lifetime_units")
    )


def brand_consistency(spark, sf):
    snaps = snapshots(spark, sf)
    odd = snaps.withColumn(
        "brand",
        F.when((F.col("store_id") % 4 == 0) & (F.col("snap_ord") == 3), "Other")
        .when(F.col("snap_ord") % 2 == 0, F.upper("brand"))
        .otherwise(F.concat(F.lit(" "), F.col("brand"))),
    )
    return tidy(rollups.brand_consistency(odd))


def brand_conflicts(spark, sf):
    """The names of the stores whose snapshots are of different brands."""
    odd = F.when((F.col("store_id") % 4 == 0) & (F.col("snap_ord") == 3), "Other").when(
        F.col("snap_ord") % 2 == 0, F.upper("brand")
    )
    snaps = snapshots(spark, sf).withColumn("brand", F.coalesce(odd, F.concat(F.lit(" "), F.col("brand"))))
    return rollups.brand_conflicts(snaps)


# ---- SQL side -------------------------------------------------------------------

SNAP = """
WITH q AS (
  SELECT l_partkey AS pid, date_trunc('quarter', l_shipdate) AS scraped_at,
         CAST(sum(l_quantity) AS BIGINT) AS qty, CAST(max(l_quantity) AS BIGINT) AS mq,
         count(*) AS n, CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS price
  FROM lineitem GROUP BY 1, 2
), snap AS (
  SELECT CAST(pid % 20 AS VARCHAR) AS store_id, CAST(pid AS VARCHAR) AS product_id, pid AS pos,
         CAST(scraped_at AS TIMESTAMP) AS scraped_at, price, p_name AS name,
         dense_rank() OVER (PARTITION BY pid % 20 ORDER BY scraped_at) AS snap_ord,
         CASE WHEN pid % 5 <> 0 THEN greatest(mq - 10, 0) END AS stock,
         CASE WHEN pid % 5 <> 0 AND pid % 2 = 0 AND pid % 7 <> 0 THEN CAST(sum(qty) OVER (
           PARTITION BY pid, CASE WHEN pid % 11 = 0 THEN year(scraped_at) END
           ORDER BY scraped_at) AS BIGINT) END AS sold_qty,
         CASE WHEN pid % 5 <> 0 THEN mq > 10 ELSE n % 2 = 1 END AS available
  FROM q JOIN part ON p_partkey = pid
), dim AS (
  SELECT DISTINCT store_id, snap_ord, scraped_at, 'Brand ' || store_id AS brand,
         CASE WHEN CAST(store_id AS INT) % 5 = 0 THEN 'shopify'
              WHEN CAST(store_id AS INT) % 2 = 0 THEN 'tiendanube' ELSE 'generic' END AS platform,
         CASE WHEN CAST(store_id AS INT) % 5 = 0 THEN 'USD' ELSE 'ARS' END AS currency
  FROM snap
), ends AS (
  SELECT store_id, max(snap_ord) AS last_ord, min(scraped_at) AS first_at,
         max(scraped_at) AS last_at, count(*) AS n_scraps FROM dim GROUP BY 1
), pair AS (
  SELECT b.store_id, b.product_id, b.snap_ord, b.pos, a.price AS start_price,
         a.stock AS start_stock, a.sold_qty AS start_sold_qty,
         CASE WHEN a.sold_qty IS NOT NULL AND b.sold_qty IS NOT NULL
              THEN greatest(b.sold_qty - a.sold_qty, 0) END AS sold_delta,
         a.stock - b.stock AS stock_drop
  FROM snap b JOIN snap a ON a.store_id = b.store_id AND a.product_id = b.product_id
       AND b.snap_ord = a.snap_ord + 1
), delta AS (
  SELECT *, sold * COALESCE(start_price, 0) AS revenue FROM (
    SELECT *, CASE WHEN sold_delta IS NOT NULL
                   THEN greatest(sold_delta, COALESCE(stock_drop, 0))
                   WHEN stock_drop > 0 THEN stock_drop ELSE 0 END AS sold,
           CASE WHEN sold_delta - stock_drop > 0 THEN sold_delta - stock_drop
                WHEN stock_drop < 0 THEN -stock_drop ELSE 0 END AS restocked
    FROM pair)
), prod AS (
  SELECT store_id, product_id, CAST(sum(sold) AS BIGINT) AS sold, sum(revenue) AS revenue,
         CAST(sum(restocked) AS BIGINT) AS restocked,
         min(snap_ord) FILTER (WHERE sold > 0) AS first_sale_in,
         min(snap_ord) FILTER (WHERE restocked > 0) AS first_restock_in
  FROM delta GROUP BY 1, 2
), fact AS (
  SELECT product_id, arg_max(name, snap_ord) AS name,
         arg_min(stock, snap_ord) FILTER (WHERE stock IS NOT NULL) AS from_stock,
         arg_max(stock, snap_ord) FILTER (WHERE stock IS NOT NULL) AS to_stock
  FROM snap GROUP BY 1
), first AS (SELECT * FROM snap WHERE snap_ord = 1
), last AS (SELECT snap.* FROM snap JOIN ends USING (store_id) WHERE snap_ord = last_ord
), flip AS (
  SELECT l.store_id, l.product_id, l.name,
         CASE WHEN f.available AND NOT l.available THEN 'sold_out'
              WHEN NOT f.available AND l.available THEN 'back' END AS change
  FROM last l JOIN first f USING (store_id, product_id)
), gone AS (
  SELECT DISTINCT store_id, product_id FROM first
  WHERE product_id NOT IN (SELECT product_id FROM last)
), period AS (
  SELECT a.store_id, a.snap_ord AS period, a.scraped_at AS from_at, b.scraped_at AS to_at,
         greatest(epoch(b.scraped_at - a.scraped_at) / 86400.0, 0.04) AS exact
  FROM dim a JOIN dim b ON a.store_id = b.store_id AND b.snap_ord = a.snap_ord + 1
), trend AS (
  SELECT p.store_id, period, from_at, to_at,
         greatest(CAST(floor(exact + 0.5) AS BIGINT), 1) AS days,
         CAST(COALESCE(sum(sold), 0) AS BIGINT) AS sold, COALESCE(sum(revenue), 0) AS revenue,
         COALESCE(sum(sold), 0) / greatest(exact, 0.5) AS per_day
  FROM period p LEFT JOIN delta d ON d.store_id = p.store_id AND d.snap_ord = p.period + 1
  GROUP BY p.store_id, period, from_at, to_at, exact
), kpi AS (
  SELECT e.store_id, 'Brand ' || e.store_id AS brand,
         (SELECT any_value(platform) FROM dim d WHERE d.store_id = e.store_id) AS platform,
         (SELECT any_value(currency) FROM dim d WHERE d.store_id = e.store_id) AS currency,
         first_at, last_at, greatest(epoch(last_at - first_at) / 86400.0, 0.5) AS span, n_scraps,
         (SELECT count(*) FROM last l WHERE l.store_id = e.store_id) AS active,
         (SELECT count(*) FROM gone g WHERE g.store_id = e.store_id) AS discontinued,
         (SELECT count(stock) FROM last l WHERE l.store_id = e.store_id) AS stock_known,
         COALESCE((SELECT bool_or(sold_delta > 0) FROM delta d WHERE d.store_id = e.store_id),
                  false) AS used_sold_qty,
         CAST(COALESCE((SELECT sum(sold) FROM delta d WHERE d.store_id = e.store_id), 0)
              AS BIGINT) AS sold,
         COALESCE((SELECT sum(revenue) FROM delta d WHERE d.store_id = e.store_id), 0) AS revenue,
         CAST((SELECT COALESCE(sum(sold_qty), 0) FROM last l WHERE l.store_id = e.store_id)
              AS BIGINT) AS lifetime_units,
         (SELECT count(*) FROM flip f WHERE f.store_id = e.store_id AND change = 'sold_out')
           AS sold_out_n,
         (SELECT count(*) FROM flip f WHERE f.store_id = e.store_id AND change = 'back') AS back_n
  FROM ends e
), kpis AS (
  SELECT store_id, brand, platform, currency,
         strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at,
         strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at,
         greatest(CAST(floor(span + 0.5) AS BIGINT), 1) AS total_days, n_scraps, active,
         discontinued, stock_known, used_sold_qty,
         stock_known = 0 AND NOT used_sold_qty AS availability_only, sold,
         CAST(revenue AS DOUBLE) AS revenue,
         CAST(floor(revenue * 0.9 + 0.5) AS DOUBLE) AS revenue_transfer,
         round(CASE WHEN sold = 0 THEN 0 ELSE CAST(revenue AS DOUBLE) / sold END, 4) AS ticket,
         round(sold / span, 4) AS per_day,
         round(CAST(revenue AS DOUBLE) / span, 4) AS per_day_revenue,
         round(CAST(revenue AS DOUBLE) * 30 / span, 4) AS monthly,
         lifetime_units, sold_out_n, back_n
  FROM kpi
)
"""

REPEATED = """
WITH r AS (
  SELECT CAST(l_partkey % 20 AS VARCHAR) AS store_id, CAST(l_partkey AS VARCHAR) AS product_id,
         l_orderkey * 10 + l_linenumber AS pos,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS BIGINT) AS stock,
         CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS sold_qty,
         dense_rank() OVER (PARTITION BY l_partkey % 20
                            ORDER BY date_trunc('quarter', l_shipdate)) AS snap_ord
  FROM lineitem
), a AS (
  SELECT * FROM r QUALIFY row_number() OVER (
    PARTITION BY store_id, product_id, snap_ord ORDER BY pos DESC) = 1
), pair AS (
  SELECT r.store_id, r.snap_ord, a.price, a.stock - r.stock AS stock_drop,
         CASE WHEN a.sold_qty IS NOT NULL AND r.sold_qty IS NOT NULL
              THEN greatest(r.sold_qty - a.sold_qty, 0) END AS sold_delta
  FROM r JOIN a ON a.store_id = r.store_id AND a.product_id = r.product_id
       AND r.snap_ord = a.snap_ord + 1
), delta AS (
  SELECT *, CASE WHEN sold_delta IS NOT NULL THEN greatest(sold_delta, COALESCE(stock_drop, 0))
                 WHEN stock_drop > 0 THEN stock_drop ELSE 0 END AS sold,
         CASE WHEN sold_delta - stock_drop > 0 THEN sold_delta - stock_drop
              WHEN stock_drop < 0 THEN -stock_drop ELSE 0 END AS restocked
  FROM pair
)
"""


def _bar(value: str) -> str:
    return (
        f"round(greatest(4.0, CAST({value} AS DOUBLE) / greatest(CAST(max({value}) OVER "
        f"(PARTITION BY store_id) AS DOUBLE), 1) * 100), 4) AS bar"
    )


_TIMES = (
    "strftime(from_at, '%Y-%m-%d %H:%M:%S') AS from_at, "
    "strftime(to_at, '%Y-%m-%d %H:%M:%S') AS to_at"
)
SOLD_ORDER = "sold DESC, first_sale_in, CAST(product_id AS BIGINT)"

SQL = {
    "snapshot_order": SNAP
    + "SELECT store_id, 2 * snap_ord - 1 + c AS snap_ord, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') "
    "AS scraped_at, platform, CASE c WHEN 0 THEN 'a' ELSE 'b' END || '.json' AS source_file "
    "FROM dim, (SELECT unnest([0, 1]) AS c)",
    "snapshot_ends": SNAP
    + "SELECT store_id, strftime(first_at, '%Y-%m-%d %H:%M:%S') AS first_at, "
    "strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at, n_scraps FROM ends",
    "comparable_stores": SNAP + "SELECT store_id FROM ends WHERE n_scraps >= 2",
    "pair_join": SNAP
    + "SELECT store_id, product_id, snap_ord, CAST(start_price AS DOUBLE) AS start_price, "
    "start_stock, start_sold_qty FROM pair",
    "signal_deltas": SNAP + "SELECT product_id, snap_ord, sold_delta, stock_drop FROM pair",
    "best_signal_units": SNAP + "SELECT product_id, snap_ord, sold FROM delta WHERE sold > 0",
    "restock_units": SNAP
    + "SELECT product_id, snap_ord, restocked FROM delta WHERE restocked > 0",
    "start_price_revenue": SNAP
    + "SELECT product_id, snap_ord, CAST(revenue AS DOUBLE) AS revenue FROM delta WHERE sold > 0",
    "last_row_wins": REPEATED
    + "SELECT product_id, snap_ord, CAST(price AS DOUBLE) AS price, stock, sold_qty FROM a",
    "repeated_id_totals": REPEATED
    + "SELECT store_id, snap_ord, count(*) AS pairs, CAST(sum(sold) AS BIGINT) AS sold, "
    "CAST(sum(restocked) AS BIGINT) AS restocked, CAST(sum(sold * price) AS DOUBLE) AS revenue "
    "FROM delta GROUP BY 1, 2",
    "product_totals": SNAP
    + "SELECT product_id, sold, CAST(revenue AS DOUBLE) AS revenue, restocked, first_sale_in, "
    "first_restock_in FROM prod",
    "stock_span": SNAP + "SELECT product_id, from_stock, to_stock FROM fact",
    "latest_names": SNAP
    + """SELECT product_id, CASE WHEN (snap_ord + CAST(product_id AS INT)) % 7 < 2 THEN product_id
      ELSE name || ' v' || snap_ord END AS name
    FROM snap QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY snap_ord DESC) = 1""",
    "period_trend": SNAP
    + f"SELECT store_id, period, {_TIMES}, days, sold, CAST(revenue AS DOUBLE) AS revenue, "
    "round(per_day, 4) AS per_day FROM trend",
    "trend_listing": SNAP
    + "SELECT store_id, period, trend.sold FROM trend JOIN kpis USING (store_id) "
    "WHERE n_scraps >= 3 AND NOT availability_only",
    "store_kpis": SNAP + "SELECT * FROM kpis",
    "displayed_kpis": SNAP
    + """SELECT store_id, CASE WHEN NOT availability_only THEN sold END AS sold,
    CASE WHEN NOT availability_only THEN revenue END AS revenue,
    CASE WHEN NOT availability_only THEN ticket END AS ticket,
    CASE WHEN NOT availability_only THEN per_day END AS per_day,
    CASE WHEN NOT availability_only THEN monthly END AS monthly,
    CASE WHEN NOT availability_only AND platform = 'tiendanube' THEN revenue_transfer END
      AS revenue_transfer,
    CASE WHEN availability_only THEN sold_out_n END AS sold_out_n,
    CASE WHEN availability_only THEN back_n END AS back_n, active, discontinued FROM kpis""",
    "method_label": SNAP
    + "SELECT store_id, CASE WHEN availability_only THEN 'availability-only' "
    "WHEN used_sold_qty THEN 'counter' ELSE 'stock-only' END AS method FROM kpis",
    "signal_coverage": SNAP
    + "SELECT store_id, active, stock_known, used_sold_qty, availability_only FROM kpis",
    "product_sales_detail": SNAP
    + "SELECT store_id, product_id, name, sold, CAST(revenue AS DOUBLE) AS revenue, from_stock, "
    "to_stock FROM prod JOIN fact USING (product_id) WHERE sold > 0",
    "top_sellers": SNAP
    + f"""SELECT store_id, rank, product_id, name, sold, {_bar('sold')} FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY {SOLD_ORDER}) AS rank
    FROM prod JOIN fact USING (product_id) WHERE sold > 0 QUALIFY rank <= 10)""",
    "top_revenue": SNAP
    + f"""SELECT store_id, rank, product_id, name, CAST(revenue AS DOUBLE) AS revenue,
    {_bar('revenue')} FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY revenue DESC, {SOLD_ORDER}) AS rank
    FROM prod JOIN fact USING (product_id) WHERE sold > 0 QUALIFY rank <= 8)""",
    "restocks": SNAP
    + "SELECT store_id, product_id, name, restocked AS restock FROM prod "
    "JOIN fact USING (product_id) WHERE restocked > 0",
    "new_products": SNAP
    + "SELECT store_id, product_id, name, sold_qty, COALESCE(stock, 0) AS stock FROM last "
    "WHERE product_id NOT IN (SELECT product_id FROM first)",
    "discontinued": SNAP + "SELECT store_id, product_id FROM gone",
    "effective_availability": SNAP
    + "SELECT product_id, snap_ord, "
    "COALESCE(CASE WHEN pos % 3 <> 0 THEN available END, stock > 0) AS is_available FROM snap",
    "availability_transitions": SNAP
    + "SELECT store_id, product_id, name, change FROM flip WHERE change IS NOT NULL",
    "lifetime_best_sellers": SNAP
    + """SELECT store_id, product_id, name, sold_qty, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sold_qty DESC, pos) AS rank
    FROM last WHERE sold_qty IS NOT NULL QUALIFY rank <= 8)""",
    "lifetime_units": SNAP
    + "SELECT store_id, CAST(sum(COALESCE(sold_qty, 0)) AS BIGINT) AS lifetime_units "
    "FROM last GROUP BY 1",
    "brand_consistency": SNAP
    + """SELECT store_id, count(DISTINCT trim(lower(CASE
      WHEN CAST(store_id AS INT) % 4 = 0 AND snap_ord = 3 THEN 'Other'
      WHEN snap_ord % 2 = 0 THEN upper(brand) ELSE ' ' || brand END))) AS n_brands,
    n_brands > 1 AS mixed FROM dim GROUP BY 1""",
    "brand_conflicts": SNAP
    + """SELECT DISTINCT store_id, CASE WHEN snap_ord = 3 THEN 'Other'
      WHEN snap_ord % 2 = 0 THEN upper(brand) ELSE ' ' || brand END AS brand
    FROM dim WHERE CAST(store_id AS INT) % 4 = 0 AND EXISTS (
      SELECT 1 FROM dim d WHERE d.store_id = dim.store_id AND d.snap_ord = 3)""",
}

QUERIES = {name: globals()[name] for name in SQL}

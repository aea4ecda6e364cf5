"""The sales report: every result table of a comparison, for all stores at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cached_property
from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.operators import presence, rollups
from vitrina.operators.ordering import first_n
from vitrina.operators.pairing import CELL_KEY, PRODUCT_KEY, pair_deltas
from vitrina.session import joined_in_place, written_table
from vitrina.sources.history import History, store_deltas, store_history

# What the report needs of a pair.
DELTA_COLUMNS = [*CELL_KEY, "pos", "sold_delta", "sold", "restocked", "revenue"]

# Rows shown by the report's lists.
TOP_BARS = 10
TOP_TABLE = 14
TOP_REVENUE = 8
TOP_LIFETIME = 8
MIN_BAR = 4.0


def comparable_stores(snapshots: DataFrame) -> DataFrame:
    """Stores with the two snapshots a comparison needs."""
    return (
        snapshots.groupBy("store_id")
        .agg(F.count(F.lit(1)).alias("n_scraps"))
        .where(F.col("n_scraps") >= 2)
        .select("store_id")
    )


def store_kpis(
    observations: DataFrame, snapshots: DataFrame, deltas: DataFrame | None = None
) -> DataFrame:
    """One row per store. Each part is summed per store on its own, then added up."""
    deltas = pair_deltas(observations) if deltas is None else deltas
    traded = deltas.groupBy("store_id").agg(
        F.sum("sold").alias("sold"),
        F.sum("revenue").alias("revenue"),
        F.bool_or(F.col("sold_delta") > 0).alias("used_sold_qty"),
    )
    listed = (
        presence.last_slice(observations, snapshots)
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("active"),
            F.count("stock").alias("stock_known"),
            F.sum(F.coalesce("sold_qty", F.lit(0))).alias("lifetime_units"),
        )
    )
    gone = (
        presence.discontinued_products(observations, snapshots)
        .groupBy("store_id")
        .agg(F.count(F.lit(1)).alias("discontinued"))
    )
    flipped = (
        presence.availability_changes(observations, snapshots)
        .groupBy("store_id")
        .agg(
            F.count_if(F.col("change") == "sold_out").alias("sold_out_n"),
            F.count_if(F.col("change") == "back").alias("back_n"),
        )
    )
    parts = traded
    for part in (listed, gone, flipped):
        parts = parts.unionByName(part, allowMissingColumns=True)
    zero = F.lit(0)
    counts = ["active", "stock_known", "lifetime_units", "discontinued", "sold_out_n", "back_n"]
    totals = parts.groupBy("store_id").agg(
        *[
            F.coalesce(F.sum(name), zero).alias(name)
            for name in ["sold", "revenue", *counts]
        ],
        F.coalesce(F.bool_or("used_sold_qty"), F.lit(False)).alias("used_sold_qty"),
    )
    revenue = F.col("revenue").cast("double")
    span = F.col("span_days")
    return (
        rollups.store_spans(snapshots)
        .join(totals, "store_id")
        .withColumn(
            "availability_only", (F.col("stock_known") == 0) & ~F.col("used_sold_qty")
        )
        .select(
            "store_id",
            "brand",
            "platform",
            "currency",
            "first_at",
            "last_at",
            "total_days",
            "n_scraps",
            "active",
            "discontinued",
            "stock_known",
            "used_sold_qty",
            "availability_only",
            "sold",
            "revenue",
            rollups.transfer_revenue(F.col("revenue")).alias("revenue_transfer"),
            F.when(F.col("sold") == 0, F.lit(0.0))
            .otherwise(revenue / F.nullif(F.col("sold"), zero))
            .alias("ticket"),
            (F.col("sold").cast("double") / span).alias("per_day"),
            (revenue / span).alias("per_day_revenue"),
            (revenue * 30 / span).alias("monthly"),
            "lifetime_units",
            "sold_out_n",
            "back_n",
        )
    )


def method_label(kpis: DataFrame) -> DataFrame:
    """Which public signal the store's figures rest on."""
    method = (
        F.when(F.col("availability_only"), "availability-only")
        .when(F.col("used_sold_qty"), "counter")
        .otherwise("stock-only")
    )
    return kpis.select("store_id", method.alias("method"))


def displayed_kpis(kpis: DataFrame) -> DataFrame:
    """Figures a report shows: no units without a numeric signal, transfer revenue
    only on the platform that has that discount (or when the platform is unknown)."""
    units = ~F.col("availability_only")
    transfer = F.coalesce(F.col("platform"), F.lit("tiendanube")) == "tiendanube"

    def shown(name: str, when: Column) -> Column:
        return F.when(when, F.col(name)).alias(name)

    return kpis.select(
        "store_id",
        *[shown(name, units) for name in ("sold", "revenue", "ticket", "per_day", "monthly")],
        shown("revenue_transfer", units & transfer),
        shown("sold_out_n", ~units),
        shown("back_n", ~units),
        "active",
        "discontinued",
    )


def product_rollup(observations: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every product that sold or was restocked: its sums, name and known stock."""
    moved = (F.col("sold") > 0) | (F.col("restocked") > 0)
    return rollups.product_facts(observations, rollups.product_totals(deltas).where(moved))


def stored_rollup(history: History, deltas: History) -> DataFrame:
    """`product_rollup` of a stored history; no row of either is exchanged."""
    rollup = product_rollup(history.regular, deltas.regular)
    if history.crowded is None:
        return rollup
    return rollup.unionByName(product_rollup(history.crowded, deltas.crowded))


def sold_products(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("sold") > 0).select(
        *PRODUCT_KEY, "name", "sold", "revenue", "from_stock", "to_stock", "first_sale"
    )


def restocked_products(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("restocked") > 0).select(
        *PRODUCT_KEY, "name", F.col("restocked").alias("restock"), "first_restock"
    )


def product_detail(observations: DataFrame, deltas: DataFrame) -> DataFrame:
    """Every product that sold, with its revenue and first and last known stock."""
    return sold_products(product_rollup(observations, deltas))


def _sold_order() -> list[Column]:
    return [F.col("sold").desc(), F.col("first_sale")]


def top_sellers(detail: DataFrame, n: int = TOP_TABLE) -> DataFrame:
    return first_n(detail, ["store_id"], _sold_order(), n)


def top_revenue(detail: DataFrame, n: int = TOP_REVENUE) -> DataFrame:
    return first_n(detail, ["store_id"], [F.col("revenue").desc(), *_sold_order()], n)


def bar_share(top: DataFrame, value: str, group: Sequence[str] = ("store_id",)) -> DataFrame:
    """Length of each bar of a short list, in percent of its longest, at least 4."""
    longest = F.greatest(F.max(value).over(Window.partitionBy(*group)), F.lit(1))
    share = F.col(value).cast("double") / longest.cast("double") * 100
    return top.withColumn("bar", F.greatest(F.lit(MIN_BAR), share))


def restock_list(observations: DataFrame, deltas: DataFrame) -> DataFrame:
    """Products seen to re-enter stock, with the units."""
    return restocked_products(product_rollup(observations, deltas))


def period_trend(
    observations: DataFrame, snapshots: DataFrame, deltas: DataFrame | None = None
) -> DataFrame:
    deltas = pair_deltas(observations) if deltas is None else deltas
    return rollups.period_totals(deltas, snapshots)


def trend_listing(trend: DataFrame, kpis: DataFrame) -> DataFrame:
    """Periods of the stores whose report shows a trend."""
    shown = kpis.where((F.col("n_scraps") > 2) & ~F.col("availability_only")).select("store_id")
    return trend.join(shown, "store_id", "left_semi")


# Order of each list. Sorting by store first keeps a store's rows together while the
# sort's range partitions still split a large store.
LIST_ORDER = {
    "product_detail": ["sold desc", "first_sale"],
    "restocks": ["restock desc", "first_restock"],
    "new_products": ["coalesce(sold_qty, 0) desc", "pos"],
    "availability_changes": ["change", "pos"],
    "period_trend": ["period"],
}


def listing(df: DataFrame, kind: str) -> DataFrame:
    def term(text: str) -> Column:
        name = text.removesuffix(" desc")
        return F.expr(name).desc() if text.endswith(" desc") else F.expr(name)

    return df.orderBy("store_id", *[term(text) for text in LIST_ORDER[kind]])


class SalesReport(Mapping):
    """All result tables of a comparison by name.

    The snapshot list, the history by product, the pair deltas, the rows of both ends, the KPI
    row of each store and the product sums feed several tables. Each is written once to the
    shared folder, when the first table that needs it is asked for.

    Only the snapshot list is cut to comparable stores: the other stores have no pairs and no
    row in the list, so their observations reach no result.
    """

    def __init__(self, observations: DataFrame | History, snapshots: DataFrame):
        self.observations, self.given = observations, snapshots

    @cached_property
    def snapshots(self) -> DataFrame:
        comparable = comparable_stores(self.given)
        return written_table(self.given.join(comparable, "store_id", "left_semi"), "compared_snapshots")

    @cached_property
    def history(self) -> History:
        return self.observations if isinstance(self.observations, History) else store_history(self.observations)

    @cached_property
    def deltas(self) -> History:
        return store_deltas(self.history, DELTA_COLUMNS)

    @cached_property
    def ends(self) -> presence.Ends:
        rows = self.history.rows() if isinstance(self.observations, History) else self.observations
        return presence.cut_ends(rows, self.snapshots)

    @cached_property
    def kpis(self) -> DataFrame:
        return written_table(store_kpis(self.ends, self.snapshots, self.deltas.rows()), "kpis")

    @cached_property
    def rollup(self) -> DataFrame:
        with joined_in_place(self.snapshots.sparkSession):
            return written_table(stored_rollup(self.history, self.deltas), "product_rollup")

    def period_trend(self) -> DataFrame:
        trend = rollups.period_totals(self.deltas.rows(), self.snapshots)
        return listing(trend_listing(trend, self.kpis), "period_trend")

    TABLES: ClassVar = {
        "kpis": lambda r: r.kpis,
        "displayed_kpis": lambda r: displayed_kpis(r.kpis),
        "method": lambda r: method_label(r.kpis),
        "period_trend": period_trend,
        "product_detail": lambda r: listing(sold_products(r.rollup), "product_detail"),
        "top_sellers": lambda r: top_sellers(sold_products(r.rollup)),
        "top_revenue": lambda r: top_revenue(sold_products(r.rollup)),
        "restocks": lambda r: listing(restocked_products(r.rollup), "restocks"),
        "new_products": lambda r: listing(presence.new_products(r.ends, r.snapshots), "new_products"),
        "availability_changes": lambda r: listing(
            presence.availability_changes(r.ends, r.snapshots), "availability_changes"
        ),
        "lifetime_best_sellers": lambda r: presence.lifetime_best_sellers(r.ends, r.snapshots, TOP_LIFETIME),
        "brand_conflicts": lambda r: rollups.brand_conflicts(r.snapshots),
    }

    def __getitem__(self, name: str) -> DataFrame:
        return self.TABLES[name](self)

    def __iter__(self):
        return iter(self.TABLES)

    def __len__(self) -> int:
        return len(self.TABLES)


def sales_report(observations: DataFrame | History, snapshots: DataFrame) -> SalesReport:
    """All result tables, made as they are asked for."""
    return SalesReport(observations, snapshots)

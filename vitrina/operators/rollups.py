"""Sums of the pair deltas per product, period and store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.functions.dates import days_between
from vitrina.functions.money import round_half_up
from vitrina.functions.text import blank_to_null, trim
from vitrina.operators.pairing import PRODUCT_KEY, history_place


def stock_span(observations: DataFrame) -> DataFrame:
    """First and last known stock of every product, and the place of its latest row.

    Numbers only, so Spark hashes them and sorts nothing.
    """
    at = history_place()
    known = F.when(F.col("stock").isNotNull(), at)
    return observations.groupBy(*PRODUCT_KEY).agg(
        F.min_by("stock", known).alias("from_stock"),
        F.max_by("stock", known).alias("to_stock"),
        F.max(at).alias("latest"),
    )


def product_facts(observations: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Latest name, first and last known stock of every product, or of the `wanted` ones only.

    The aggregate finds the place of the latest row, and a join takes the name from there:
    names are never carried through the history. A name that is null or empty gives the id.
    """
    spans = stock_span(observations)
    if wanted is not None:
        spans = spans.join(wanted, PRODUCT_KEY)
    names = observations.select(*PRODUCT_KEY, history_place().alias("latest"), "name")
    named = spans.join(names, [*PRODUCT_KEY, "latest"]).drop("latest")
    return named.withColumn("name", F.coalesce(blank_to_null(F.col("name")), F.col("product_id")))


def product_totals(deltas: DataFrame) -> DataFrame:
    """Units, revenue and restocks per product, with the place of the first of each."""
    at = history_place()
    return deltas.groupBy(*PRODUCT_KEY).agg(
        F.sum("sold").alias("sold"),
        F.sum("revenue").alias("revenue"),
        F.sum("restocked").alias("restocked"),
        F.min(F.when(F.col("sold") > 0, at)).alias("first_sale"),
        F.min(F.when(F.col("restocked") > 0, at)).alias("first_restock"),
    )


def periods(snapshots: DataFrame) -> DataFrame:
    """Consecutive snapshot pairs of every store, keyed by the later snapshot."""
    start = snapshots.select(
        "store_id",
        (F.col("snap_ord") + 1).cast("int").alias("snap_ord"),
        F.col("scraped_at").alias("from_at"),
    )
    end = snapshots.select("store_id", "snap_ord", F.col("scraped_at").alias("to_at"))
    exact = F.greatest(days_between(F.col("from_at"), F.col("to_at")), F.lit(0.04))
    return end.join(start, ["store_id", "snap_ord"]).withColumn("days_exact", exact)


def period_totals(deltas: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Units and revenue per period; a period without sales keeps its row."""
    sums = deltas.groupBy("store_id", "snap_ord").agg(
        F.sum("sold").alias("sold"), F.sum("revenue").alias("revenue")
    )
    zero = F.lit(0)
    exact = F.col("days_exact")
    return (
        periods(snapshots)
        .join(sums, ["store_id", "snap_ord"], "left")
        .select(
            "store_id",
            (F.col("snap_ord") - 1).alias("period"),
            "from_at",
            "to_at",
            F.greatest(F.lit(1), F.floor(exact + 0.5)).alias("days"),
            F.coalesce("sold", zero).alias("sold"),
            F.coalesce("revenue", zero).alias("revenue"),
            (F.coalesce("sold", zero).cast("double") / F.greatest(exact, F.lit(0.5))).alias(
                "per_day"
            ),
        )
    )


def store_spans(snapshots: DataFrame) -> DataFrame:
    """One row per store: what its last snapshot declares and how long the span is."""
    span = F.greatest(days_between(F.col("first_at"), F.col("last_at")), F.lit(0.5))
    return (
        snapshots.groupBy("store_id")
        .agg(
            F.max_by(F.struct("brand", "platform", "currency"), "snap_ord").alias("_last"),
            F.min_by("scraped_at", "snap_ord").alias("first_at"),
            F.max_by("scraped_at", "snap_ord").alias("last_at"),
            F.count(F.lit(1)).alias("n_scraps"),
        )
        .select("store_id", "_last.*", "first_at", "last_at", "n_scraps")
        .withColumn("span_days", span)
        .withColumn("total_days", F.greatest(F.lit(1), F.floor(F.col("span_days") + 0.5)))
    )


def brand_consistency(snapshots: DataFrame) -> DataFrame:
    """How many different brand names a store's snapshots carry."""
    brands = snapshots.select("store_id", trim(F.lower("brand")).alias("brand_key")).distinct()
    return brands.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_brands"), (F.count(F.lit(1)) > 1).alias("mixed")
    )


def brand_conflicts(snapshots: DataFrame) -> DataFrame:
    """The names used by stores whose snapshots seem to be of different brands."""
    mixed = brand_consistency(snapshots).where("mixed")
    return snapshots.select("store_id", "brand").distinct().join(mixed, "store_id", "left_semi")


def transfer_revenue(revenue: Column) -> Column:
    """Revenue when buyers take the usual 10 % transfer discount, whole units."""
    return round_half_up(revenue * F.lit("0.9").cast("decimal(2,1)"))

"""First and last snapshot of a store: what changed between the two ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.operators.ordering import first_n
from vitrina.operators.pairing import CELL_KEY, PRODUCT_KEY, last_rows
from vitrina.session import written_table

FIRST = 1
DAY = "snapshot_date"


# What the comparison of the ends needs.
END_COLUMNS = [*CELL_KEY, "pos", "name", "stock", "sold_qty", "available"]


@dataclass(frozen=True)
class Ends:
    """Rows of each store's first and of its last snapshot, cut once. Takes the place of the
    observations wherever a function of this module asks for them."""

    first: DataFrame
    last: DataFrame


def cut_ends(observations: DataFrame, snapshots: DataFrame) -> Ends:
    """Both ends in one read of the observations, written to the shared folder.

    In a table stored by day Spark skips the folders of all days that are no store's end.
    """
    last = last_ordinals(snapshots).withColumn("_end", F.lit("last"))
    first = first_ordinals(snapshots).withColumn("_end", F.lit("first"))
    keys = ["store_id", "snap_ord"] + ([DAY] if DAY in observations.columns else [])
    places = last.unionByName(first).groupBy(*keys).agg(
        F.bool_or(F.col("_end") == "first").alias("is_first"), F.bool_or(F.col("_end") == "last").alias("is_last")
    )
    # always true; Spark prunes folders at run time only for a side that is filtered
    wanted = places.where(F.col("is_first") | F.col("is_last"))
    rows = observations.select(*END_COLUMNS, *[k for k in keys if k == DAY]).join(wanted, keys)
    cut = written_table(rows.select(*END_COLUMNS, "is_first", "is_last"), "ends")
    return Ends(cut.where("is_first").select(*END_COLUMNS), cut.where("is_last").select(*END_COLUMNS))


def last_ordinals(snapshots: DataFrame) -> DataFrame:
    """Number and day of each store's last snapshot."""
    last = snapshots.groupBy("store_id").agg(
        F.max("snap_ord").alias("snap_ord"),
        F.to_date(F.max_by("scraped_at", "snap_ord")).alias(DAY),
    )
    # always true; Spark prunes folders at run time only for a side that is filtered
    return last.where(F.col("snap_ord") >= FIRST)


def last_slice(observations: DataFrame | Ends, snapshots: DataFrame) -> DataFrame:
    """Rows of each store's last snapshot.

    Joined on store and snapshot, so a large store is spread by snapshot when the
    list of stores is too long to broadcast. In a table stored by day the day joins
    too, which lets Spark skip the folders of days that are no store's last.
    """
    if isinstance(observations, Ends):
        return observations.last
    keys = ["store_id", "snap_ord"]
    if DAY in observations.columns:
        keys.append(DAY)
    return observations.join(last_ordinals(snapshots).select(*keys), keys)


def first_ordinals(snapshots: DataFrame) -> DataFrame:
    """Number and day of each store's first snapshot."""
    first = snapshots.where(F.col("snap_ord") == FIRST)
    return first.select("store_id", "snap_ord", F.to_date("scraped_at").alias(DAY))


def first_slice(observations: DataFrame | Ends, snapshots: DataFrame) -> DataFrame:
    """Rows of each store's first snapshot.

    The filter reaches the scan where the number is stored. In a table stored by day the
    day joins, which lets Spark skip the folders of days that are no store's first.
    """
    if isinstance(observations, Ends):
        return observations.first
    rows = observations.where(F.col("snap_ord") == FIRST)
    if DAY in observations.columns:
        rows = rows.join(first_ordinals(snapshots), ["store_id", "snap_ord", DAY])
    return rows


def listed_products(rows: DataFrame) -> DataFrame:
    """Distinct product keys of a slice.

    Counted distinct with the snapshot in the key: the join on the product key then
    shuffles them again, which lets the adaptive skew join split the other side.
    """
    return rows.select(*CELL_KEY).distinct().select(*PRODUCT_KEY)


def effective_availability(available: Column, stock: Column) -> Column:
    """The published flag, or what a known stock implies, or unknown."""
    return F.coalesce(available, stock > 0)


def availability_changes(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Products available at one end and not at the other: `sold_out` or `back`."""
    first = last_rows(first_slice(observations, snapshots), "available", "stock").select(
        *PRODUCT_KEY,
        effective_availability(F.col("available"), F.col("stock")).alias("was_available"),
    )
    last = last_slice(observations, snapshots).select(
        *PRODUCT_KEY,
        "pos",
        "name",
        effective_availability(F.col("available"), F.col("stock")).alias("is_available"),
    )
    change = F.when(F.col("was_available") & ~F.col("is_available"), "sold_out").when(
        ~F.col("was_available") & F.col("is_available"), "back"
    )
    return (
        last.join(first, PRODUCT_KEY)
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .select(*PRODUCT_KEY, "pos", "name", "change")
    )


def new_products(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of the last snapshot whose product is not in the first."""
    seen = listed_products(first_slice(observations, snapshots))
    return (
        last_slice(observations, snapshots)
        .join(seen, PRODUCT_KEY, "left_anti")
        .select(
            *PRODUCT_KEY,
            "pos",
            "name",
            "sold_qty",
            F.coalesce(F.col("stock"), F.lit(0)).alias("stock"),
        )
    )


def discontinued_products(observations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Distinct products of the first snapshot that the last one lacks."""
    still = listed_products(last_slice(observations, snapshots))
    return listed_products(first_slice(observations, snapshots)).join(still, PRODUCT_KEY, "left_anti")


def lifetime_best_sellers(
    observations: DataFrame, snapshots: DataFrame, n: int = 8
) -> DataFrame:
    """Highest published counters in the last snapshot, per store."""
    counted = last_slice(observations, snapshots).where(F.col("sold_qty").isNotNull())
    return first_n(
        counted.select(*PRODUCT_KEY, "pos", "name", "sold_qty"),
        ["store_id"],
        [F.col("sold_qty").desc(), F.col("pos")],
        n,
    )

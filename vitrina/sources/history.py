"""Observations stored by product, so that a comparison shuffles them once.

The pair join, the sums of a product and its facts all meet rows of one product. Stored by the
hash of the product they exchange nothing more. A product id that is repeated without end would
make one file of a bucket large, so the rows of crowded products lie in a plain table and are
joined and summed by the ways that the adaptive skew join can split.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.operators.pairing import CELL_KEY, PRODUCT_KEY, pair_deltas
from vitrina.session import joined_in_place, written_table
from vitrina.sources.buckets import bucketed_table

# What a comparison needs of a row.
COLUMNS = [*CELL_KEY, "pos", "name", "price", "stock", "sold_qty", "available"]
# A product with more rows than this is crowded.
CROWDED = 1_000_000


@dataclass(frozen=True)
class History:
    """Rows that lie by product, and those of crowded products, if there are any."""

    regular: DataFrame
    crowded: DataFrame | None = None

    def each(self, result: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A result whose rows belong to one product each."""
        if self.crowded is None:
            return result(self.regular)
        return result(self.regular).unionByName(result(self.crowded))

    def rows(self) -> DataFrame:
        return self.each(lambda rows: rows)


def store_history(observations: DataFrame, buckets: int | None = None, crowded: int = CROWDED) -> History:
    """The observations by product; all rows of a product are in one of the two tables."""
    counts = observations.groupBy(*PRODUCT_KEY).agg(F.count(F.lit(1)).alias("n"))
    many = written_table(counts.where(F.col("n") > crowded).select(*PRODUCT_KEY), "crowded_products")
    rows = observations.select(*COLUMNS)
    order = [*PRODUCT_KEY, "snap_ord", "pos"]
    if many.isEmpty():
        return History(bucketed_table(rows, "history", PRODUCT_KEY, order, buckets))
    plain = rows.join(many, PRODUCT_KEY, "left_anti")
    return History(
        bucketed_table(plain, "history", PRODUCT_KEY, order, buckets),
        written_table(rows.join(many, PRODUCT_KEY, "left_semi"), "crowded_history"),
    )


def store_deltas(history: History, columns: list[str], buckets: int | None = None) -> History:
    """The pair deltas of a history, stored as it is. Those of regular products already lie by product."""

    def deltas(rows: DataFrame) -> DataFrame:
        return pair_deltas(rows).select(*columns)

    with joined_in_place(history.regular.sparkSession):
        regular = bucketed_table(deltas(history.regular), "pair_deltas", PRODUCT_KEY, buckets=buckets, dealt=True)
    if history.crowded is None:
        return History(regular)
    return History(regular, written_table(deltas(history.crowded), "crowded_deltas"))

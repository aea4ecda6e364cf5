"""The comparison on small hand-made shops."""

import random

import pytest
from pyspark.sql import functions as F

from vitrina.operators import presence, rollups
from vitrina.operators.pairing import matched_pairs, pair_deltas
from vitrina.plans import sales


def kpis(shop_tables):
    return sales.store_kpis(*shop_tables).first()


def test_stock_that_went_down_was_sold(shop):
    row = kpis(
        shop(
            (0, [{"id": 1, "name": "A", "price": 1000, "stock": 10}]),
            (7, [{"id": 1, "name": "A", "price": 1000, "stock": 6}]),
        )
    )
    assert (row.sold, row.revenue, row.total_days) == (4, 4000, 7)
    assert row.availability_only is False
    assert row.revenue_transfer == 3600
    assert row.ticket == 1000 and row.per_day == pytest.approx(4 / 7)
    assert row.monthly == pytest.approx(4000 * 30 / 7)


def test_counter_sees_sales_behind_a_restock(shop):
    observations, snapshots = shop(
        (0, [{"id": 1, "name": "A", "price": 1000, "stock": 10, "sold": 100}]),
        (7, [{"id": 1, "name": "A", "price": 1000, "stock": 8, "sold": 105}]),
    )
    row = kpis((observations, snapshots))
    assert row.sold == 5 and row.used_sold_qty
    restock = sales.restock_list(observations, pair_deltas(observations)).first()
    assert restock.restock == 3


def test_larger_stock_drop_wins_over_the_counter(shop):
    observations, _ = shop(
        (0, [{"id": 1, "price": 10, "stock": 10, "sold": 100}]),
        (1, [{"id": 1, "price": 10, "stock": 2, "sold": 103}]),
    )
    row = pair_deltas(observations).first()
    assert row.sold == 8 and row.restocked == 0


def test_counter_that_restarts_counts_nothing_but_stock_still_can(shop):
    observations, _ = shop(
        (0, [{"id": 1, "price": 10, "stock": 10, "sold": 100}, {"id": 2, "price": 10, "sold": 50}]),
        (1, [{"id": 1, "price": 10, "stock": 7, "sold": 2}, {"id": 2, "price": 10, "sold": 1}]),
    )
    rows = {r.product_id: r for r in pair_deltas(observations).collect()}
    assert rows["1"].sold_delta == 0 and rows["1"].sold == 3
    assert rows["2"].sold_delta == 0 and rows["2"].sold == 0


def test_stock_that_rose_is_a_restock_without_negative_sales(shop):
    observations, snapshots = shop(
        (0, [{"id": 1, "price": 1000, "stock": 5}]),
        (7, [{"id": 1, "price": 1000, "stock": 12}]),
    )
    row = pair_deltas(observations).first()
    assert row.sold == 0 and row.restocked == 7
    assert kpis((observations, snapshots)).sold == 0


def test_availability_only_store_invents_no_units(shop):
    tables = shop(
        (0, [{"id": 1, "name": "A", "price": 90, "available": True},
             {"id": 2, "name": "B", "price": 50, "available": False}]),
        (5, [{"id": 1, "name": "A", "price": 90, "available": False},
             {"id": 2, "name": "B", "price": 50, "available": True}]),
        platform="shopify",
    )
    row = kpis(tables)
    assert row.availability_only and row.sold == 0
    assert (row.sold_out_n, row.back_n) == (1, 1)
    changes = {r.name: r.change for r in presence.availability_changes(*tables).collect()}
    assert changes == {"A": "sold_out", "B": "back"}
    shown = sales.displayed_kpis(sales.store_kpis(*tables)).first()
    assert shown.sold is None and shown.sold_out_n == 1
    assert sales.method_label(sales.store_kpis(*tables)).first().method == "availability-only"


def test_sales_are_valued_at_the_price_the_period_started_with(shop):
    observations, snapshots = shop(
        (0, [{"id": 1, "price": 100, "stock": 10}]),
        (3, [{"id": 1, "price": 200, "stock": 8}]),
        (6, [{"id": 1, "price": 200, "stock": 5}]),
    )
    assert kpis((observations, snapshots)).revenue == 2 * 100 + 3 * 200
    trend = sales.period_trend(observations, snapshots).orderBy("period").collect()
    assert [(r.period, r.sold, r.days) for r in trend] == [(1, 2, 3), (2, 3, 3)]


def test_missing_price_values_sales_at_nothing(shop):
    observations, _ = shop((0, [{"id": 1, "stock": 4}]), (1, [{"id": 1, "stock": 1}]))
    row = pair_deltas(observations).first()
    assert row.sold == 3 and row.revenue == 0


def test_new_and_discontinued_products(shop):
    tables = shop(
        (0, [{"id": 1, "price": 1, "stock": 5}, {"id": 3, "price": 1, "stock": 5}]),
        (7, [{"id": 1, "price": 1, "stock": 5}, {"id": 2, "name": "N", "price": 3, "sold": 44}]),
    )
    new = presence.new_products(*tables).collect()
    assert [(r.name, r.sold_qty, r.stock) for r in new] == [("N", 44, 0)]
    row = kpis(tables)
    assert (row.sold, row.active, row.discontinued) == (0, 2, 1)


def test_snapshots_are_ordered_by_time_then_file(shop):
    observations, snapshots = shop(
        (7, [{"id": 1, "price": 100, "stock": 6}]),
        (0, [{"id": 1, "price": 100, "stock": 10}]),
    )
    assert kpis((observations, snapshots)).sold == 4
    same_time, _ = shop(
        (3, [{"id": 1, "price": 1, "stock": 9}]), (3, [{"id": 1, "price": 1, "stock": 4}])
    )
    assert pair_deltas(same_time).first().sold == 5


def test_period_shorter_than_a_day(shop):
    observations, snapshots = shop(
        (0, [{"id": 1, "price": 1, "stock": 9}]), (0, [{"id": 1, "price": 1, "stock": 4}])
    )
    period = sales.period_trend(observations, snapshots).first()
    assert period.days == 1 and period.per_day == 10


def test_a_gap_breaks_the_chain(shop):
    observations, snapshots = shop(
        (0, [{"id": 1, "price": 1, "stock": 9}, {"id": 2, "price": 1, "stock": 1}]),
        (1, [{"id": 2, "price": 1, "stock": 1}]),
        (2, [{"id": 1, "price": 1, "stock": 2}, {"id": 2, "price": 1, "stock": 1}]),
    )
    assert kpis((observations, snapshots)).sold == 0
    periods = sales.period_trend(observations, snapshots).collect()
    assert len(periods) == 2 and all(r.sold == 0 for r in periods)


def test_repeated_ids_each_meet_the_last_earlier_row(shop):
    observations, _ = shop(
        (0, [{"id": 1, "price": 5, "stock": 99}, {"id": 1, "price": 7, "stock": 10}]),
        (1, [{"id": 1, "price": 1, "stock": 8}, {"id": 1, "price": 1, "stock": 4}]),
    )
    rows = pair_deltas(observations).orderBy("pos").collect()
    assert [(r.sold, r.revenue) for r in rows] == [(2, 14), (6, 42)]


def test_names_stock_span_and_tied_ranks(shop):
    observations, _ = shop(
        (0, [{"id": "b", "name": "old", "price": 1, "stock": None},
             {"id": "a", "name": "A", "price": 1, "stock": 5}]),
        (1, [{"id": "b", "name": "B", "price": 1, "stock": 6},
             {"id": "a", "name": "", "price": 1, "stock": 3}]),
        (2, [{"id": "a", "name": None, "price": 1, "stock": 1},
             {"id": "b", "name": "B", "price": 1, "stock": 2}]),
    )
    detail = sales.product_detail(observations, pair_deltas(observations))
    top = sales.top_sellers(detail).orderBy("rank").collect()
    # both sold four; "a" sold first, and its latest name is missing
    assert [(r.product_id, r.name, r.sold) for r in top] == [("a", "a", 4), ("b", "B", 4)]
    assert [(r.from_stock, r.to_stock) for r in top] == [(5, 1), (6, 2)]
    assert [r["rank"] for r in sales.top_sellers(detail, 1).collect()] == [1]


def test_bars_are_shares_of_the_longest_with_a_floor(spark):
    rows = spark.createDataFrame([("s", 200), ("s", 50), ("s", 1)], "store_id string, sold bigint")
    bars = sorted(r.bar for r in sales.bar_share(rows, "sold").collect())
    assert bars == [4.0, 25.0, 100.0]


def test_stores_do_not_mix_and_single_snapshots_are_left_out(spark, shop):
    one = shop((0, [{"id": 1, "price": 2, "stock": 9}]), (4, [{"id": 1, "price": 2, "stock": 3}]))
    two = shop(
        (0, [{"id": 1, "price": 3, "stock": 9}]),
        (4, [{"id": 1, "price": 3, "stock": 8}]),
        store="t",
    )
    alone = shop((0, [{"id": 1, "price": 3, "stock": 9}]), store="u")
    observations = one[0].unionByName(two[0]).unionByName(alone[0])
    snapshots = one[1].unionByName(two[1]).unionByName(alone[1])
    report = sales.sales_report(observations, snapshots)
    found = {r.store_id: (r.sold, r.revenue) for r in report["kpis"].collect()}
    assert found == {"s": (6, 12), "t": (1, 3)}
    assert {r.store_id for r in report["top_sellers"].collect()} == {"s", "t"}
    assert report["period_trend"].count() == 0  # a trend needs two periods
    for name, table in report.items():
        assert table.columns, name
        table.collect()


def test_brand_names_are_compared_without_case_and_space(spark, shop):
    _, same = shop((0, [{"id": 1}]), (1, [{"id": 1}]))
    snapshots = same.withColumn(
        "brand", F.when(F.col("snap_ord") == 1, " MARCA test").otherwise(F.col("brand"))
    )
    assert not rollups.brand_consistency(snapshots).first().mixed
    other = same.withColumn("brand", F.concat("brand", "source_file"))
    assert rollups.brand_consistency(other).first().mixed
    assert rollups.brand_conflicts(other).count() == 2


def brute_force(snapshots):
    """Units, revenue and restocks per product, straight from the definition."""
    sold, revenue, restock = {}, {}, {}
    for before, after in zip(snapshots, snapshots[1:]):
        last = {p["id"]: p for p in before}
        for b in after:
            a = last.get(b["id"])
            if a is None:
                continue
            counted = (
                max(0, b["sold"] - a["sold"])
                if a["sold"] is not None and b["sold"] is not None
                else None
            )
            drop = (
                a["stock"] - b["stock"]
                if a["stock"] is not None and b["stock"] is not None
                else None
            )
            units = max(counted or 0, drop or 0, 0)
            back = 0
            if counted is not None and drop is not None:
                back = max(0, counted - drop)
            elif drop is not None:
                back = max(0, -drop)
            key = str(b["id"])
            sold[key] = sold.get(key, 0) + units
            revenue[key] = revenue.get(key, 0) + units * (a["price"] or 0)
            restock[key] = restock.get(key, 0) + back
    return {k: (sold[k], revenue[k], restock[k]) for k in sold}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_shops_match_brute_force(shop, seed):
    rng = random.Random(seed)

    def maybe(value):
        return value if rng.random() < 0.8 else None

    history = [
        [
            {
                "id": rng.randrange(12),
                "name": "x",
                "price": maybe(rng.randrange(1, 50)),
                "stock": maybe(rng.randrange(20)),
                "sold": maybe(rng.randrange(100)),
            }
            for _ in range(15)
        ]
        for _ in range(6)
    ]
    observations, _ = shop(*enumerate(history))
    totals = rollups.product_totals(pair_deltas(observations)).collect()
    got = {r.product_id: (r.sold, r.revenue, r.restocked) for r in totals}
    assert got == brute_force(history)
    assert matched_pairs(observations).count() == sum(
        sum(1 for b in after if b["id"] in {a["id"] for a in before})
        for before, after in zip(history, history[1:])
    )

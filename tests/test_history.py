"""One parse for all results, and a history that is shuffled once."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_scale import conf, hot_observations, plan  # noqa: F401
from vitrina.operators import presence, rollups
from vitrina.operators.pairing import PRODUCT_KEY, pair_deltas
from vitrina.plans import sales
from vitrina.session import joined_in_place
from vitrina.sources import history, snapshots, tables
from vitrina.sources.buckets import bucketed_table
from vitrina.sources.snapshots import load_snapshots
from workload import sales_queries

HEAD = '{{"brand":"B","currency":"ARS","scrapedAt":"2026-08-0{}T00:00:00Z","products":[{}]}}'


def documents(spark, rows):
    return spark.createDataFrame(rows, "store_id string, source_file string, body string")


def shop_documents(spark):
    rows = []
    for store in ("s", "t"):
        for day in (1, 2, 3):
            products = ",".join(f'{{"id":{i},"name":"n{i}","price":{i},"stock":{20 - day}}}' for i in range(5))
            rows.append((store, f"{day}.json", HEAD.format(day, products)))
    return documents(spark, [*rows, ("s", "bad.json", "{")])


def test_documents_are_parsed_once(spark, conf):  # noqa: F811
    """Every result reads the parse table: no result's plan parses or reads the documents."""
    loaded = load_snapshots(shop_documents(spark))
    results = [loaded.snapshots, loaded.observations, loaded.rejects, loaded.warnings]
    for df in results:
        assert "from_json" not in plan(df).lower() and "jsontostructs" not in plan(df).lower()
        assert "ExistingRDD" not in plan(df) and "LocalTableScan" not in plan(df)
    assert loaded.observations.count() == 30 and loaded.rejects.count() == 1
    heads = re.findall(r"ReadSchema: struct<([^\n]*)>", plan(loaded.rejects))
    assert heads and all("products:" not in schema for schema in heads)
    parsing = plan(snapshots.parse_documents(shop_documents(spark)))
    assert parsing.count("from_json(StructField(platform") == 1


def test_products_are_numbered_without_an_exchange(spark, conf):  # noqa: F811
    conf(autoBroadcastJoinThreshold="-1")
    rows = load_snapshots(shop_documents(spark)).observations
    assert "Exchange" not in plan(rows) and "SortMergeJoin" in plan(rows)
    assert {(r.store_id, r.snap_ord, r.n) for r in rows.groupBy("store_id", "snap_ord").agg(F.count("*").alias("n")).collect()} == {
        (store, day, 5) for store in "st" for day in (1, 2, 3)
    }


def test_equal_times_are_numbered_by_file_and_parts_share_a_number(spark):
    rows = [
        ("s", "b.json", HEAD.format(2, '{"id":1}')),
        ("s", "a.json", HEAD.format(2, '{"id":1}')),
        ("s", "z.json", HEAD.format(1, '{"id":1}')),
        ("s", "z.part00001.json", HEAD.format(1, '{"id":2}')),
    ]
    got = load_snapshots(documents(spark, rows)).observations.collect()
    assert sorted((r.snap_ord, r.snapshot_id, r.product_id) for r in got) == [
        (1, "z.json", "1"), (1, "z.json", "2"), (2, "a.json", "1"), (3, "b.json", "1"),
    ]


def test_large_and_unreadable_prices(spark):
    products = '{"id":1,"price":1000000000000000,"stock":9},{"id":2,"price":"abc","stock":9},{"id":3,"price":"","stock":9}'
    later = products.replace('"stock":9', '"stock":6')
    rows = [("s", "1.json", HEAD.format(1, products)), ("s", "2.json", HEAD.format(2, later))]
    loaded = load_snapshots(documents(spark, rows))
    assert loaded.rejects.count() == 0
    assert {(r.source_file, *r.warnings) for r in loaded.warnings.collect()} == {
        (f"{n}.json", "1 product(s) with an unreadable price") for n in (1, 2)
    }
    kpis = sales.sales_report(loaded.observations, loaded.snapshots)["kpis"].first()
    assert kpis.sold == 9 and kpis.revenue == Decimal(3 * 10**15)


@pytest.fixture
def stored(spark):
    return history.store_history(hot_observations(spark, 6000))


def test_a_stored_history_exchanges_nothing_more(spark, conf, stored):  # noqa: F811
    """Pairs, sums and facts of products read the buckets as they lie."""
    conf(autoBroadcastJoinThreshold="-1")
    assert stored.crowded is None
    with joined_in_place(spark):
        deltas = history.store_deltas(stored, sales.DELTA_COLUMNS)
        for df in (
            pair_deltas(stored.regular),
            rollups.product_totals(deltas.regular),
            rollups.stock_span(stored.regular),
            rollups.product_facts(stored.regular),
            sales.stored_rollup(stored, deltas),
        ):
            shown = plan(df)
            assert "Exchange" not in shown, shown
            assert "SortAggregate" not in shown and "ObjectHashAggregate" not in shown
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_a_stored_history_gives_the_same_results(spark, stored):
    rows = hot_observations(spark, 6000)
    plain = sales.product_rollup(rows, pair_deltas(rows)).orderBy(*PRODUCT_KEY)
    split = history.store_history(rows, crowded=100)
    assert split.crowded.select("product_id").distinct().count() == 1
    for one in (stored, split):
        deltas = history.store_deltas(one, sales.DELTA_COLUMNS)
        got = sales.stored_rollup(one, deltas).select(*plain.columns).orderBy(*PRODUCT_KEY)
        assert got.collect() == plain.collect()
        assert one.rows().count() == rows.count()


def test_facts_are_of_the_latest_row_also_where_its_name_is_missing(spark):
    schema = "store_id string, product_id string, snap_ord int, pos bigint, name string, stock int"
    rows = [
        ("s", "a", 1, 5, "old", None), ("s", "a", 3, 0, "new", 4), ("s", "a", 3, 7, "newest", None),
        ("s", "b", 1, 0, "had a name", 9), ("s", "b", 2, 0, None, 8),
        ("s", "c", 1, 0, "had a name", None), ("s", "c", 2, 0, "", None), ("t", "a", 1, 0, "other shop", 1),
    ]
    facts = rollups.product_facts(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, facts.collect()), key=str) == sorted(
        [("s", "a", 4, 4, "newest"), ("s", "b", 9, 8, "b"), ("s", "c", None, None, "c"), ("t", "a", 1, 1, "other shop")], key=str
    )
    assert "SortAggregate" not in plan(facts)


def test_both_ends_are_cut_in_one_pruned_read(spark, conf, shop, tmp_path):  # noqa: F811
    observations, heads = shop(*[(day, [{"id": 1, "stock": 9 - day, "price": 1}]) for day in range(5)])
    path, dim = str(tmp_path / "rows"), str(tmp_path / "heads")
    at = heads.select("store_id", "snap_ord", "scraped_at")
    tables.write_observations(observations.join(at, ["store_id", "snap_ord"]), path)
    heads.write.parquet(dim)
    rows, heads = tables.read_observations(spark, path), spark.read.parquet(dim)
    plans = []
    real = presence.written_table
    presence.written_table = lambda df, name: plans.append(plan(df)) or real(df, name)
    try:
        ends = presence.cut_ends(rows, heads)
    finally:
        presence.written_table = real
    assert len(plans) == 1 and plans[0].count(f"{path}") == 1 and "dynamicpruning" in plans[0]
    assert [r.stock for r in ends.first.collect()] == [9] and [r.stock for r in ends.last.collect()] == [5]
    only = presence.cut_ends(rows, heads.where("snap_ord = 1"))
    assert [r.stock for r in only.first.collect()] == [r.stock for r in only.last.collect()] == [9]


def test_a_report_makes_only_what_is_asked_for(spark, shop, monkeypatch):
    observations, heads = shop((0, [{"id": 1, "stock": 9, "price": 1}]), (1, [{"id": 1, "stock": 7, "price": 1}]))
    written = []
    for module in (sales, history, presence):
        real = module.written_table
        monkeypatch.setattr(module, "written_table", lambda df, name, real=real: written.append(name) or real(df, name))
    report = sales.sales_report(observations, heads)
    assert report["brand_conflicts"].count() == 0 and written == ["compared_snapshots"]
    assert report["new_products"].count() == 0 and written[1:] == ["ends"]
    assert report["kpis"].first().sold == 2 and written[2:] == ["crowded_products", "kpis"]
    assert {name: report[name].count() for name in report}["top_sellers"] == 1
    assert written[4:] == ["product_rollup"]
    again = sales.sales_report(history.store_history(observations), heads)
    assert again["kpis"].collect() == report["kpis"].collect()


def test_stores_with_one_snapshot_are_not_compared(spark, shop):
    _, heads = shop((0, [{"id": 1}]), (1, [{"id": 1}]))
    _, single = shop((0, [{"id": 1}]), store="single")
    both = heads.unionByName(single)
    assert [r.store_id for r in sales.comparable_stores(both).collect()] == ["s"]


def test_buckets_survive_their_name(spark):
    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id", F.lit(dt.date(2026, 1, 1)).alias("d"))
    table = bucketed_table(rows, "numbers_of_sevens", ["k"], ["id"], 3)
    assert table.count() == 100 and "numbers_of_sevens" not in str(spark.sql("SHOW TABLES").collect())
    assert "Exchange" not in plan(table.groupBy("k").count())


def test_comparable_stores_reads_every_store(spark, tmp_path):
    at = lambda month: dt.datetime(1996, month, 1)
    lines = [(20 * i + store, at(m), 1.0, 1.0) for i, (store, m) in enumerate([(3, 1), (3, 5), (4, 1), (4, 8), (5, 1)])]
    columns = "l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = sales_queries.comparable_stores(spark, str(tmp_path))
    assert sorted(r.store_id for r in got.collect()) == ["3", "4"]

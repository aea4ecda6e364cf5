"""Plans and rankings that must hold when one key has much of the table."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from vitrina.operators import presence
from vitrina.operators.ordering import first_n, rank_in_blocks, rank_within
from vitrina.operators.pairing import pair_deltas
from vitrina.operators.rollups import product_totals
from vitrina.operators.rows import join_stores, keep_computed
from vitrina.session import joined_in_place
from vitrina.sources import tables
from workload import captures, ingest_queries, snapshots


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    before = {}

    def change(**pairs):
        for key, value in pairs.items():
            name = "spark.sql." + key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name))
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.set(name, value)


def hot_observations(spark, n=60_000):
    """A third of all rows are one product id of one snapshot."""
    hot = F.col("id") % 3 == 0
    return spark.range(n).select(
        F.lit("s").alias("store_id"),
        F.when(hot, 2).otherwise(F.col("id") % 4 + 1).cast("int").alias("snap_ord"),
        F.col("id").alias("pos"),
        F.when(hot, "0").otherwise((F.col("id") % 997).cast("string")).alias("product_id"),
        F.lit("n").alias("name"),
        F.lit(2).cast("decimal(18,4)").alias("price"),
        (F.col("id") % 50).alias("stock"),
        F.lit(None).cast("bigint").alias("sold_qty"),
        F.lit(True).alias("available"),
    )


def test_pair_join_splits_a_hot_product(spark, conf, tmp_path):
    path = str(tmp_path / "hot")
    hot_observations(spark).repartition(8).write.parquet(path)
    rows = spark.read.parquet(path)
    plain = product_totals(pair_deltas(rows)).orderBy("product_id").collect()
    conf(
        autoBroadcastJoinThreshold="-1",
        shuffle__partitions="8",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        adaptive__skewJoin__skewedPartitionFactor="2",
        adaptive__advisoryPartitionSizeInBytes="10KB",
    )
    split = product_totals(pair_deltas(rows)).orderBy("product_id")
    assert split.collect() == plain
    assert "skew=true" in final_plan(pair_deltas(rows)).replace("isSkewJoin", "skew")


def test_first_slice_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "obs")
    hot_observations(spark, 900).write.parquet(path)
    shown = plan(presence.first_slice(spark.read.parquet(path), None).select("product_id"))
    assert "EqualTo(snap_ord,1)" in shown
    schema = re.search(r"ReadSchema: struct<([^>]*)>", shown).group(1)
    assert set(schema.split(",")) == {"product_id:string", "snap_ord:int"}


def test_end_slices_skip_days_of_a_stored_table(spark, shop, tmp_path):
    observations, snapshots = shop(
        *[(day, [{"id": 1, "stock": 9 - day, "price": 1}]) for day in range(5)]
    )
    at = snapshots.select("store_id", "snap_ord", "scraped_at")
    path, heads = str(tmp_path / "rows"), str(tmp_path / "heads")
    tables.write_observations(observations.join(at, ["store_id", "snap_ord"]), path)
    snapshots.write.parquet(heads)
    rows, snapshots = tables.read_observations(spark, path), spark.read.parquet(heads)
    for end, stock in ((presence.last_slice, 5), (presence.first_slice, 9)):
        found = end(rows, snapshots)
        assert "dynamicpruning" in plan(found)
        assert [r.stock for r in found.collect()] == [stock]


def test_pair_aggregates_hash_and_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "obs")
    hot_observations(spark, 900).write.parquet(path)
    shown = plan(product_totals(pair_deltas(spark.read.parquet(path))))
    assert "SortAggregate" not in shown and "ObjectHashAggregate" not in shown
    assert "name:string" not in shown and "available" not in shown


def test_top_lists_are_pruned_before_the_shuffle(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = first_n(rows, ["g"], [F.col("v").desc()], 3)
    assert "WindowGroupLimit" in plan(top) and "Partial" in plan(top)
    assert sorted(r.v for r in top.collect()) == [994, 995, 996, 997, 998, 999]


def test_long_lists_are_numbered_in_blocks(spark, conf):
    conf(optimizer__windowGroupLimitThreshold="10")
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = first_n(rows, ["g"], [F.col("v").desc()], 500)
    assert "WindowGroupLimit" not in plan(top)
    assert sorted(r.v for r in top.collect()) == list(range(2000, 3000))


@pytest.mark.parametrize("blocks", [1, 7])
def test_rank_within_numbers_every_row(spark, blocks):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("g"),
        (F.col("id") * 7919 % 101).alias("v"),
        F.col("id"),
    )
    order = [F.col("v").desc(), F.col("id")]
    got = {(r.g, r.id): r["rank"] for r in rank_within(rows, ["g"], order, blocks=blocks).collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    want = {
        (g, row[1]): place
        for g, members in groups.items()
        for place, row in enumerate(sorted(members), 1)
    }
    assert got == want


def test_rank_in_blocks_is_spread_over_blocks(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    ranked = rank_in_blocks(rows, ["g"], (F.col("v") / 10).cast("int"), [F.col("v")])
    assert all(r["rank"] == r.v + 1 for r in ranked.collect())


def test_store_joins_carry_a_copy_number_in_the_key(spark, conf):
    big = spark.range(500).selectExpr("if(id < 490, 's', 't') AS store_id", "string(id) AS u")
    some = spark.createDataFrame([("s", 1), ("t", 2)], "store_id string, x int")
    assert join_stores(big, some, ["u"]).count() == 500
    assert join_stores(big, some.where("x = 1"), ["u"]).count() == 490
    assert join_stores(big, some, ["u"], "left_anti").count() == 0
    conf(autoBroadcastJoinThreshold="-1")
    shown = plan(join_stores(big, some.distinct(), ["u"]))
    assert re.search(r"SortMergeJoin \[store_id#\d+, _copy#\d+\]", shown)


def test_computed_conditions_are_not_pushed_below_their_columns(spark):
    rows = spark.range(10).withColumn("t", F.concat(F.lit("x"), F.col("id").cast("string")))
    kept = keep_computed(rows, F.length("t") > 1)
    assert kept.count() == 10 and "Filter" not in plan(kept)
    assert keep_computed(rows, F.col("id") > 7).count() == 2


def test_every_join_side_is_shuffled_directly(spark, conf, shop, tmp_path):
    """The adaptive skew join splits a side only when its sort reads a shuffle."""
    path, heads = str(tmp_path / "rows"), str(tmp_path / "heads")
    observations, snapshots = shop((0, [{"id": 1, "stock": 2}]), (1, [{"id": 1, "stock": 1}]))
    observations.write.parquet(path)
    snapshots.write.parquet(heads)
    rows, snapshots = spark.read.parquet(path), spark.read.parquet(heads)
    conf(autoBroadcastJoinThreshold="-1")
    for df in (
        pair_deltas(rows),
        presence.last_slice(rows, snapshots),
        presence.availability_changes(rows, snapshots),
        presence.new_products(rows, snapshots),
        presence.discontinued_products(rows, snapshots),
    ):
        lines = [re.sub(r"^[\s:+\-|*]*(\(\d+\) )?", "", line) for line in plan(df).splitlines()]
        sorts = [i for i, line in enumerate(lines) if line.startswith("Sort [")]
        assert sorts and any("SortMergeJoin" in line for line in lines)
        assert all(lines[i + 1].startswith("Exchange hashpartitioning") for i in sorts), lines


def stored_parts(spark, at):
    columns = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    rows = [(i, f"part {i}", "Brand#1", "TIN", i % 9, 900.0 + i) for i in range(400)]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


def test_captures_of_one_file_are_read_in_many_tasks(spark, conf, tmp_path):
    conf(shuffle__partitions="7")
    at = stored_parts(spark, str(tmp_path))
    for made in (captures.shopify_feeds, captures.woocommerce_feeds, captures.embedded_pages, captures.structured_pages):
        assert made(spark, at).rdd.getNumPartitions() == 7


def test_documents_are_gathered_in_one_exchange_of_the_lines(spark, conf, tmp_path):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    at = stored_parts(spark, str(tmp_path))
    day = lambda i: dt.datetime(1996, 1 + i % 12, 1)
    lines = [(i % 400, day(i), 1.0 + i % 40, 10.0 + i) for i in range(900)]
    columns = "l_partkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double"
    spark.createDataFrame(lines, columns).write.parquet(f"{at}/lineitem.parquet")
    with joined_in_place(spark):
        rows = snapshots.shelved_observations(spark, at)
        assert len(re.findall(r"Exchange hashpartitioning\(store_id#\d+, part#\d+L", plan(rows))) == 2  # lines and names
        assert "Exchange hashpartitioning(pid" not in plan(rows)
    texts = ingest_queries.documents(spark, at).collect()
    held = {(r.store_id, r.snap_ord): r.body.count('"pos":') for r in texts}
    assert sum(held.values()) == len({(p, (d.month - 1) // 3) for p, d, *_ in lines}) and len(held) == len(texts)

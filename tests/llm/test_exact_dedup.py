"""Exact dedup as a tree merge: every level exchanges, sorts and merges."""

import hashlib
import re

from pyspark.sql import functions as F

from vitrina.llm import exact_dedup

SCHEMA = "doc_id long, text string, lang string, run int, _key string, _row string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def many(spark, n=3000):
    """A third of the rows has one text; the others have two rows a text."""
    text = F.when(F.col("id") % 3 == 0, F.lit("the  common\ttext")).otherwise(F.concat(F.lit("t "), (F.col("id") / 2).cast("int")))
    return spark.range(n).select((n - F.col("id")).alias("doc_id"), text.alias("text")).repartition(7)


def test_every_level_exchanges_sorts_and_merges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        runs = exact_dedup.merged_runs(exact_dedup.digests(many(spark)))
        plan = plan_of(runs)
        assert plan.count("shufflepartitionidpassthrough(direct_shuffle_partition_id(run") == 2
        assert plan.count("Exchange") == 3 and "HashAggregate" not in plan  # one deals the table itself
        assert len(re.findall(r"Sort \[run#\d+ ASC NULLS FIRST, text_sha256", plan)) == 2
        assert len(re.findall(r"Filter \(_place#\d+ = 1\)", plan)) == 2
        got = {(r.text_sha256, r.keep_id, r.group_size) for r in runs.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    held = {}
    for r in many(spark).collect():
        plain = re.sub(r"[\x20\x09-\x0D]+", " ", r.text)
        held.setdefault(hashlib.sha256(plain.encode()).hexdigest(), []).append(r.doc_id)
    assert got == {(digest, min(ids), len(ids)) for digest, ids in held.items()}


def test_a_merged_run_is_sorted_and_in_one_partition(spark):
    runs = exact_dedup.digests(many(spark)).select(
        *exact_dedup.KEY, F.col("doc_id").alias("keep_id"), F.lit(1).alias("group_size"), (F.col("doc_id") % 4).cast("int").alias("run")
    )
    merged = exact_dedup.merged(runs.repartitionById(4, F.col("run")))
    rows = merged.withColumn("part", F.spark_partition_id()).collect()
    assert all(r.part == r.run for r in rows)
    for run in range(4):
        digests = [r.text_sha256 for r in rows if r.run == run]
        assert digests == sorted(set(digests))


def test_the_smallest_id_is_kept_over_nulls_and_repeats(spark):
    rows = [(None, "a b"), (7, "a  b"), (5, "a\nb"), (5, "a b"), (None, "z"), (None, "z"), (3, None), (2, ""), (9, " ")]
    table = spark.createDataFrame([(*r, "x", 1, "k", "r") for r in rows], SCHEMA)
    rows = exact_dedup.exact_dedup(table).collect()
    got = sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in rows)
    assert got == sorted(
        [(0, 5, 4, False), (7, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (0, 0, 2, True), (0, 0, 2, True)]
        + [(3, 2, 2, False), (2, 2, 2, True), (9, 9, 1, True)]
    )
    kept = exact_dedup.keep_first(table)
    assert kept.columns == table.columns
    left = sorted((r.doc_id or 0, re.sub(r"\s+", " ", r.text)) for r in kept.collect())
    assert left == [(0, "z"), (2, ""), (5, "a b"), (9, " ")]


def test_one_row_repeated_without_end_stays_once(spark):
    table = spark.range(5000).select(
        F.lit(4).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang")
    )
    assert exact_dedup.keep_first(table).collect() == [(4, "same", "en")]
    assert "Window" not in plan_of(exact_dedup.keep_first(table)).split("LeftSemi")[0]

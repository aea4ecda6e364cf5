"""Mixing sources to target weights along a curriculum.

A source's documents form a stream in hash order, repeated as often as its target asks for.
Its weight over training time is a schedule of knots. The schedule is integrated to cumulative
token demand; inverting that demand at a document's place in the stream gives its training
position, and documents are range-sorted by position.

Places in a stream are prefix sums. A source may hold most of the corpus, so its stream is cut
by leading hash bits into pieces whose sums are added up first; no task reads a whole source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import shuffle_width, whole_text, words
from vitrina.session import written_table

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: A table of at most so many sources is broadcast, a longer one is joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: (time, rate) knots per weight: heavy sources come early, light ones late.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (1.0, 1.5)),
)


def sized(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False
) -> DataFrame:
    """doc_id, source, size in words, and the hash that orders a stream; `row` holds the row if `whole`."""
    row = [F.struct("*").alias("row")] if whole else []
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words(whole_text(text))).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("place"),
        *row,
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target and the number of its weight, one row per source.

    Sources in order of most * size / weight fill up one after another; the first that stays
    below its limit sets the share per weight of all that follow.
    """
    everything = Window.partitionBy()
    named = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))
    kind = F.pmod(rank - 1, F.lit(len(weights)))
    listed = named.select(
        "source",
        "source_size",
        rank.alias("_rank"),
        kind.alias("kind"),
        F.element_at(F.array(*map(F.lit, weights)), kind + 1).cast("double").alias("weight"),
    ).withColumn("_full", F.lit(most) * F.col("source_size") / F.col("weight"))
    filled = everything.orderBy("_full", "_rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = listed.withColumn(
        "_share",
        (F.sum("source_size").over(everything) - F.coalesce(most * F.sum("source_size").over(before), F.lit(0)))
        / F.sum("weight").over(onward),
    )
    open_place = F.when(F.col("_full") > F.col("_share"), F.struct("_full", "_rank", "_share"))
    level = F.min(open_place).over(everything)["_share"]
    limit = (F.lit(most) * F.col("source_size")).cast("double")
    return share.select(
        "source",
        "source_size",
        "kind",
        F.least(limit, F.coalesce(F.col("weight") * level, limit)).alias("target"),
    )


def streams(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with `start`: words of the same source before the row in hash order.

    `sizes` are the same rows without what they carry. Rows are shuffled once, by source and piece.
    """
    bits = min(32, math.ceil(math.log2(4 * shuffle_width(sizes.sparkSession))))
    piece = F.shiftright(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), 32 - bits)
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    keys = ["_source", "_piece"]
    cut = lambda df: df.withColumn("_source", named).withColumn("_piece", piece)
    earlier = Window.partitionBy("_source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut(sizes)
        .groupBy(*keys)
        .agg(F.sum("size").alias("_size"))
        .select(*keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys).orderBy("place", "doc_id", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(rows).withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(offsets, keys).select(*rows.columns, (F.col("_offset") + F.col("_inside")).alias("start"))


def training_time(demand: Column, kind: Column, schedules=SCHEDULES) -> Column:
    """The time, 0 to 1, at which a schedule's integral reaches `demand` (its share, 0 to 1)."""
    by_kind = F.lit(None).cast("double")
    for number, knots in enumerate(schedules):
        parts = [(t0, r0, t1, r1, (t1 - t0) * (r0 + r1) / 2) for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
        area = demand * F.lit(float(sum(part[-1] for part in parts)))
        held, time = 0.0, F.lit(None).cast("double")
        for t0, r0, t1, r1, size in parts:
            need = area - F.lit(held)
            root = F.sqrt(F.lit(r0 * r0) + F.lit(2 * (r1 - r0) / (t1 - t0)) * need)
            time = F.when(need >= 0, F.lit(t0) + F.lit(2.0) * need / (F.lit(r0) + root)).otherwise(time)
            held += size
        by_kind = F.when(kind == number, time).otherwise(by_kind)
    return by_kind


def _taken(rows: DataFrame, sizes: DataFrame, weights: Sequence[float], most: int) -> DataFrame:
    """`rows` with source_size, target, kind, start, taken and copies."""
    goals = targets(sizes, weights, most).withColumnRenamed("source", "_goal_of")
    if goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    held = streams(rows, sizes).join(goals, F.col("source").eqNullSafe(F.col("_goal_of")))
    size, total = F.col("size"), F.col("source_size")
    rest = F.col("_quota") - F.col("_passes") * total - F.col("start")
    nothing = F.lit(0).cast("long")
    some = F.when(F.col("_part") > 0, 1).otherwise(0)
    return (
        held.withColumn("_quota", F.round("target").cast("long"))
        .withColumn("_passes", F.when(total > 0, F.floor(F.col("_quota") / total)).otherwise(0).cast("long"))
        .withColumn("_part", F.greatest(nothing, F.least(size, rest)))
        .withColumn("taken", size * F.col("_passes") + F.col("_part"))
        .withColumn("copies", F.when(size > 0, F.col("_passes") + some).otherwise(0).cast("long"))
        .drop("_quota", "_passes", "_part", "_goal_of")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules=SCHEDULES,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies, position; one row per row.

    `taken` counts the words that the mix takes, repeats included: whole passes over the
    source, then the documents at the start of its stream, the last of them cut at the
    target. `copies` counts the passes that take any of it. `position` is the training time
    of the first copy, null where nothing is taken. Rows are range-sorted by position.

    A null text has size 0 and takes nothing; a null source is a source of its own, sorted
    last; equal ids keep their own places, by size. All sources empty: targets are 0. An empty
    table gives no rows. Other columns are not read. Reruns give the same rows.
    """
    sizes = written_table(sized(docs, doc_id, text, source), "sizes")
    counted = _taken(sizes, sizes, weights, most)
    time = training_time(F.col("start") / F.col("target"), F.col("kind"), schedules)
    return counted.select(
        "doc_id", "source", "size", "source_size", "target", "taken", "copies",
        F.when(F.col("taken") > 0, time).alias("position"),
    ).orderBy("position", "source", "doc_id")


def mixed_rows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    schedules=SCHEDULES,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """The mix itself: a row of `docs` for each copy that it takes, range-sorted by training position.

    A copy that is cut at its source's target has its first words only, with one space
    between them. All cases are those of `mix`.
    """
    sizes = written_table(sized(docs, doc_id, text, source), "sizes")
    counted = _taken(sized(docs, doc_id, text, source, whole=True), sizes, weights, most)
    each = counted.where(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    )
    place = F.least((F.col("start") + F.col("copy") * F.col("source_size")) / F.col("target"), F.lit(1.0))
    left = F.col("taken") - F.col("copy") * F.col("size")
    own = F.col("row").getField(text)
    cut = F.array_join(F.slice(words(F.coalesce(own, F.lit(""))), F.lit(1), left.cast("int")), " ")
    whole = F.when(left < F.col("size"), cut).otherwise(own)
    columns = [whole.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    placed = each.select(
        training_time(place, F.col("kind"), schedules).alias("_position"),
        F.col("start").alias("_start"),
        F.struct(*columns).alias("_row"),
    )
    return placed.orderBy("_position", "_start").select("_row.*")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, (rank - 1) % 3 AS kind, CAST([5, 2, 1][1 + (rank - 1) % 3] AS DOUBLE) AS weight FROM named
), shared AS (
  SELECT *, 3 * source_size / weight AS filled,
         (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (
            ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (
            ORDER BY 3 * source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed
), level AS (
  SELECT arg_min(share, (filled, rank)) AS level FROM shared WHERE filled > share
), goals AS (
  SELECT source, source_size, kind,
         least(CAST(3 * source_size AS DOUBLE), coalesce(weight * level, 3 * source_size)) AS target
  FROM shared LEFT JOIN level ON true
), placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.kind,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CAST(round(g.target) AS BIGINT) AS quota
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS passes FROM placed
), parted AS (
  SELECT *, greatest(0, least(size, quota - passes * source_size - start)) AS part FROM passed
), taken AS (
  SELECT *, size * passes + part AS taken, CASE WHEN target > 0 THEN start / target END AS demand FROM parted
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken,
       CAST(CASE WHEN size > 0 THEN passes + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS copies,
       CASE WHEN taken > 0 THEN CASE kind
         WHEN 0 THEN 2.0::DOUBLE * demand / (1.5::DOUBLE + sqrt(2.25::DOUBLE + -2.0::DOUBLE * demand))
         WHEN 1 THEN 2.0::DOUBLE * demand / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * demand))
         ELSE 2.0::DOUBLE * demand / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * demand))
       END END AS position
FROM taken
"""

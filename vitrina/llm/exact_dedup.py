"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is one run of digests. In each round a run is cut by the next three bits
of the digest, and the eight runs whose numbers differ in the same three bits exchange their
pieces, each of which then holds one eighth of the digests of all eight. A run is one task: it
sorts what it was sent by digest and id, so that the eight pieces are merged and equal digests
are neighbours, and passes on the first row of each stretch of equal digests, which has the
smallest id, with the stretch's sum of counts. After the last round every digest is in one run,
and no run ever holds more than its share of the digests, so the tree has no root that gathers
the corpus. A text that makes up a third of the corpus is one row per run from the first merge on.

Two texts count as equal when SHA-256, length in bytes and a second hash all agree; every
level of the tree compares the three together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import SPACES, shuffle_width, whole_text
from vitrina.session import written_table

#: Runs merged at once: two to this power.
MERGE_BITS = 3
KEY = ["text_sha256", "n_bytes", "second"]


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text_sha256, n_bytes, second: of the text with each run of white space as one space."""
    plain = docs.select(
        F.col(doc_id).alias("doc_id"), F.regexp_replace(whole_text(text), SPACES, " ").alias("_plain")
    )
    return plain.select(
        "doc_id",
        F.sha2(F.col("_plain").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("_plain").alias("n_bytes"),
        F.xxhash64("_plain").alias("second"),
    )


def merged_runs(rows: DataFrame) -> DataFrame:
    """One row per digest: the smallest doc_id (nulls only if there is no other) and the row count."""
    rounds, width = 1, shuffle_width(rows.sparkSession)
    while 1 << (MERGE_BITS * rounds) < width:
        rounds += 1
    bits = MERGE_BITS * rounds
    home = F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long").bitwiseAND((1 << bits) - 1)
    runs = rows.select(
        *KEY,
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.pmod(F.spark_partition_id(), F.lit(1 << bits)).cast("long").alias("run"),
    )
    for level in range(rounds):
        cut = ((1 << MERGE_BITS) - 1) << (MERGE_BITS * level)
        stays = F.col("run").bitwiseAND(((1 << bits) - 1) ^ cut)
        sent = runs.withColumn("run", stays.bitwiseOR(home.bitwiseAND(cut)).cast("int"))
        runs = merged(sent.repartitionById(1 << bits, F.col("run")))
    return runs.drop("run")


def merged(runs: DataFrame) -> DataFrame:
    """Runs, each in a partition of its own, sorted by digest and id, with one row per digest.

    The window needs no exchange, as a run is in one partition, and runs along the sort order.
    """
    along = Window.partitionBy("run", *KEY).orderBy(F.col("keep_id").asc_nulls_last())
    stretch = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        runs.withColumn("_place", F.row_number().over(along))
        .withColumn("_sum", F.sum("group_size").over(stretch))
        .where("_place = 1")
        .select("run", *KEY, "keep_id", F.col("_sum").alias("group_size"))
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; all empty texts are equal. Texts are read whole. Rows that
    repeat an id with an equal text share its fate: all rows with the smallest id have
    `kept`. A null id is smallest only where a group has no other. Other columns are not read.
    An empty table gives no rows.
    """
    rows = written_table(digests(docs, doc_id, text), "digests")
    groups = merged_runs(rows)
    # The row side of a hot digest is split by the adaptive skew join.
    return rows.join(groups, KEY).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one for each distinct text, with all their columns.

    A null text counts as empty, and of all empty texts one row stays. Of rows that repeat both
    id and text one stays, by a hash of the whole row. A group whose ids are all null keeps one
    row. Texts are compared whole. An empty table gives no rows. Columns may have any names.
    """

    def key(identity: Column, digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(identity.cast("string"), F.lit("-")), digest).alias("_key")

    staying = exact_dedup(docs, doc_id, text).where("kept")
    keys = staying.select(key(F.col("doc_id"), F.col("text_sha256"))).distinct()
    plain = F.regexp_replace(whole_text(text), SPACES, " ")
    rows = docs.select(F.struct("*").alias("_row"), key(F.col(doc_id), F.sha2(plain.cast("binary"), 256)))
    # repeats of one row are taken together before they are sent
    left = rows.join(keys, "_key", "left_semi").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return left.select("_row.*")


SQL = r"""
WITH digested AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept,
       text_sha256
FROM digested
WINDOW same AS (PARTITION BY text_sha256)
"""

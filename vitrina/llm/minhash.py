"""Near duplicates by min-max hashing.

A document's set holds the hashes of its distinct word shingles. Under each permutation both the
least and the greatest value are kept, so `PERMUTATIONS` evaluations give twice as many signature values.
Bands of `ROWS` values meet in buckets. With 252 values in 42 bands of six, a pair of similarity 0.8 that is missed by
every band has a probability of 3e-6.

Documents with equal sets form a class, and only classes are compared. First every class is
checked against one leader, that of most of its buckets, in a few rounds with other leaders; that joins a
large group of near copies into few components with one check each. Then every pair that
meets in a bucket and lies in different components is considered, none left out: first in a third
of the buckets, then, with the links found there, in the rest. A bitmap of
parities bounds the symmetric difference of two sets from below, so pairs that cannot be
similar enough fall inside the join, and the rest is checked on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import LOWER, blocks, mix64, word_hashes, word_spans
from vitrina.session import written_table

PERMUTATIONS = 128
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
SHINGLE_WORDS = 5
SIMILARITY = (80, 100)
#: Rounds differ in cost only: pairs that no round links are all considered afterwards.
LEADER_ROUNDS = 4
#: Buckets are gone through in so many parts, by these shares: most pairs that are similar meet in a
#: few buckets of the first part, and those of later parts know them to be linked.
BUCKET_SHARES = (1, 2)
#: Longs of a parity bitmap.
PARITY = 8

_MULTIPLIERS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
_SHIFTS = mix64(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) << np.uint64(40))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every row of a block, sorted inside the row, and their offsets.

    A row with fewer words than `size` has its whole sequence as its only shingle; one
    without words has none.
    """
    rows = len(starts) - 1
    low = LOWER[data]
    first, end, row = word_spans(low, starts)
    word = word_hashes(low, first, end)
    count = np.bincount(row, minlength=rows)
    if len(word) >= size:
        at = np.flatnonzero(row[size - 1 :] == row[: len(row) - size + 1])
    else:
        at = np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = mix64(h * _STEP + word[at + j])
    held = row[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.searchsorted(row, short)
        extra = count[short].astype(np.uint64)
        for j in range(size - 1):
            more = count[short] > j
            extra[more] = mix64(extra[more] * _STEP + word[begin[more] + j])
        h, held = np.concatenate((h, extra)), np.concatenate((held, short))
    order = np.lexsort((h, held))
    h, held = h[order], held[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (held[1:] != held[:-1])
        h, held = h[keep], held[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(held, minlength=rows))))


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation, one row for each non-empty set."""
    begin = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(begin), 2 * PERMUTATIONS), np.uint64)
    for p in range(PERMUTATIONS):
        value = h * _MULTIPLIERS[p] + _SHIFTS[p]
        out[:, 2 * p] = np.minimum.reduceat(value, begin)
        out[:, 2 * p + 1] = np.maximum.reduceat(value, begin)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(signature), band + 1, np.uint64)
        for value in range(band * ROWS, (band + 1) * ROWS):
            key = mix64(key * _STEP + signature[:, value])
        keys[:, band] = key
    return keys


def set_digests(h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums over each set that do not depend on its order."""
    out = []
    for seed in (0x51ED270B, 0x2545F491):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(h ^ np.uint64(seed)), dtype=np.uint64)))
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out


def parities(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A bitmap per non-empty set: each element flips one bit.

    Two bitmaps differ in at most as many bits as the sets differ in elements.
    """
    begin = offsets[:-1][np.diff(offsets) > 0]
    cell = mix64(h ^ np.uint64(0x7F4A7C15))
    bit = np.uint64(1) << (cell & np.uint64(63))
    place = (cell >> np.uint64(6)) % np.uint64(PARITY)
    out = np.empty((len(begin), PARITY), np.uint64)
    for i in range(PARITY):
        out[:, i] = np.bitwise_xor.reduceat(np.where(place == i, bit, np.uint64(0)), begin)
    return out


def _lists(values: np.ndarray, full: np.ndarray) -> pa.ListArray:
    """A row's longs for each full row, an empty list for the others."""
    ends = np.concatenate(([0], np.cumsum(full * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1).view(np.int64)))


def _signature_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in blocks(batch.column(1)):
                h, offsets = shingle_sets(data, starts, size)
                count = np.diff(offsets)
                full = count > 0
                keys, parity = np.zeros((0, BANDS), np.uint64), np.zeros((0, PARITY), np.uint64)
                if full.any():
                    keys, parity = band_keys(signatures(h, offsets)), parities(h, offsets)
                a, b = set_digests(h, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(count.astype(np.int64)),
                        pa.array(a),
                        pa.array(b),
                        _lists(keys, full),
                        _lists(parity, full),
                    ],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "parity"],
                )

    return rows


def _set_rows(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, starts in blocks(batch.column(0)):
                h, offsets = shingle_sets(data, starts, size)
                a, b = set_digests(h, offsets)
                whole = h.tobytes()
                sets = [whole[8 * i : 8 * j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.diff(offsets).astype(np.int64)), pa.array(a), pa.array(b), pa.array(sets, pa.binary())],
                    ["n_shingles", "set_a", "set_b", "shingles"],
                )

    return rows


def _linked_rows(similarity: tuple[int, int]):
    part, whole = similarity

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(whole * common >= part * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return rows


def connected(edges: DataFrame) -> DataFrame:
    """v, root: the least vertex that each vertex of `edges` (v, m; m < v) reaches.

    Large-star and small-star steps in turn until nothing changes; each is a join and an
    aggregate over edges, so a vertex with very many links is never gathered.
    """
    edges = written_table(edges.distinct(), "edges")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return edges.select("v", F.col("m").alias("root"))
        seen = tuple(state)
        around = edges.select(F.col("v").alias("u"), F.col("m").alias("w")).union(edges.select("m", "v"))
        least = around.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("to"))
        large = around.join(least, "u").where("w > u").select(F.col("w").alias("v"), F.col("to").alias("m"))
        large = large.distinct()
        least = large.groupBy("v").agg(F.min("m").alias("to"))
        beside = large.join(least, "v").where("m > to").select(F.col("m").alias("v"), F.col("to").alias("m"))
        edges = written_table(beside.union(least.select("v", "to")).distinct(), "edges")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of `docs`.

    Words are the runs of non-space characters with A-Z in lower case. Documents are linked when
    the intersection of their sets is at least similarity of the union; component_id is the smallest doc_id that is
    reachable, itself included, and `kept` rows carry it as their id. A text without words
    or a null text has no shingles and is linked with nothing. Rows that repeat an id and a
    text are all kept or none; a null id is a component's id only where it has no other. An
    empty table gives no rows. Other columns are not read.
    """
    part, whole = similarity
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>, parity array<long>"
    signed = own.mapInArrow(_signature_rows(shingle_words), schema)
    rows = written_table(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    sets = ["n_shingles", "set_a", "set_b"]
    filled = rows.where("n_shingles > 0")
    classes = written_table(
        filled.groupBy(*sets).agg(F.min("row").alias("cid"), F.min("doc_id").alias("least_id")), "classes"
    )
    present = classes.select("cid").join(rows.select(F.col("row").alias("cid"), "doc_id", *sets, "bands"), "cid")
    entries = present.select("cid", "n_shingles", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("band")
    members = written_table(entries.join(shared, "band"), "members")
    differ = F.lit(whole + part)

    def likely(apart: Column, x: str, y: str) -> Column:
        """Sets of sizes x and y that differ in at least `apart` elements may be similar enough."""
        return differ * apart <= F.lit(whole - part) * (F.col(x) + F.col(y))

    # Full sets of the classes that share a bucket with another, computed from their texts again.
    meeting = present.join(members.select("cid").distinct(), "cid").select("cid", "doc_id", *sets)
    wanted = written_table(meeting, "meeting")
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    # The same plan at every size: texts are dealt by id, never the ids to all tasks.
    texts = own.join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
    computed = texts.mapInArrow(
        _set_rows(shingle_words), "n_shingles long, set_a long, set_b long, shingles binary"
    )
    full = written_table(computed.join(wanted.select("cid", *sets), sets).select("cid", "shingles"), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        left = full.select(F.col("cid").alias("x"), F.col("shingles").alias("of_x"))
        right = full.select(F.col("cid").alias("y"), F.col("shingles").alias("of_y"))
        both = pairs.join(right, "y").join(left, "x").select("x", "y", "of_x", "of_y")
        found = both.mapInArrow(_linked_rows(similarity), "x long, y long")
        return found.select(F.greatest("x", "y").alias("v"), F.least("x", "y").alias("m"))

    near, roots = None, None
    for number in range(LEADER_ROUNDS):
        # The bucket's least class by another order each time.
        order = F.col("cid") if number == 0 else F.xxhash64("cid", F.lit(number))
        leaders = members.groupBy("band").agg(
            F.min_by("cid", order).alias("leader"), F.min_by("n_shingles", order).alias("leader_size")
        )
        met = members.join(leaders, "band").where(F.col("cid") != F.col("leader"))
        met = met.where(likely(F.abs(F.col("n_shingles") - F.col("leader_size")), "n_shingles", "leader_size"))
        if roots is not None:
            of_leader = roots.select(F.col("v").alias("leader"), F.col("root").alias("leader_root"))
            met = met.join(roots.withColumnRenamed("v", "cid"), "cid", "left").join(of_leader, "leader", "left")
            met = met.where(F.coalesce("root", "cid") != F.coalesce("leader_root", "leader"))
        often = met.groupBy("cid", "leader").agg(F.count(F.lit(1)).alias("bands"))
        # Most bands first, then the least leader.
        chosen = often.groupBy("cid").agg(F.max("bands").alias("bands"))
        chosen = often.join(chosen, ["cid", "bands"]).groupBy("cid").agg(F.min("leader").alias("leader"))
        found = links(chosen.select(F.col("leader").alias("x"), F.col("cid").alias("y")))
        near = written_table(found if near is None else near.union(found), "links")
        roots = connected(near)

    bits = [F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY)]
    bitmaps = filled.select(F.col("row").alias("cid"), *bits)
    part_of = F.pmod(F.xxhash64("band"), F.lit(sum(BUCKET_SHARES)))
    apart = F.greatest(
        F.abs(F.col("n_shingles") - F.col("y_size")).cast("int"),
        sum((F.bit_count(F.col(f"p{i}").bitwiseXOR(F.col(f"q{i}"))) for i in range(PARITY)), F.lit(0)),
    )
    done = 0
    for share in BUCKET_SHARES:
        # What the buckets before have linked is one component by now and meets no more.
        here = members.where((part_of >= done) & (part_of < done + share))
        done += share
        labelled = here.join(roots.withColumnRenamed("v", "cid"), "cid", "left").select(
            "band", "cid", "n_shingles", F.coalesce("root", "cid").alias("root")
        )
        mixed = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        still = labelled.join(mixed.where("low < high").select("band"), "band")
        open_members = written_table(still.join(bitmaps, "cid"), "open")
        other = open_members.select(
            "band", F.col("cid").alias("y"), F.col("n_shingles").alias("y_size"), F.col("root").alias("y_root"),
            *(F.col(f"p{i}").alias(f"q{i}") for i in range(PARITY)),
        )
        mine = open_members.withColumnRenamed("band", "x_band").withColumnRenamed("cid", "x")
        crossing = mine.join(
            other,
            (F.col("x_band") == F.col("band"))
            & (F.col("root") < F.col("y_root"))
            & likely(apart, "n_shingles", "y_size"),
        )
        pairs = crossing.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        rest = written_table(pairs.distinct(), "pairs")
        if rest.isEmpty():
            continue
        found = written_table(links(rest), "links")
        if not found.isEmpty():
            near = near.union(found)
            roots = connected(near)

    linked = classes.join(roots.withColumnRenamed("v", "cid"), "cid", "left").select(
        *sets, "least_id", F.coalesce("root", "cid").alias("root")
    )
    ids_of = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = linked.join(ids_of, "root").select(*sets, "component_id")
    result = ["doc_id", "n_shingles", "component_id"]
    joined = filled.join(named, sets).select(*result)
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    Rows that share an id are one document. A null or empty text is linked with nothing and
    stays; so does a null id, which is a document like another. Texts are read whole. An empty
    table gives no rows. Columns may have any names.
    """
    found = near_duplicates(docs, doc_id, text, shingle_words, similarity).where("kept")
    ids = found.select(F.col("doc_id").alias("_kept_id")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"))
    return rows.join(ids, F.col("_id").eqNullSafe(F.col("_kept_id")), "left_semi").select("_row.*")


def oracle(shingle_words: int, similarity: tuple[int, int] = SIMILARITY) -> str:
    """DuckDB SQL for `near_duplicates` over documents."""
    part, whole = similarity
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < {shingle_words} THEN array_to_string(words, ' ')
           ELSE array_to_string(words[i:i + {shingle_words - 1}], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {shingle_words - 2}, 2))) AS i
        FROM split WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM common
  JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE {whole} * common.n >= {part} * (p.n + q.n - common.n)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.to_id
), least AS (
  SELECT doc_id, min(to_id) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

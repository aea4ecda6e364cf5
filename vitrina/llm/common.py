"""Shared pieces: white space, folds, counted floors, and text blocks inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.session import ship_package

#: White space as the contracts define it, as a Java class and as a list for trim().
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
BLOCK_BYTES = 1 << 21


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A given table; the operators' Python workers get this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as an empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % parts


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """Array of the runs of non-space characters."""
    bare = F.rtrim(F.ltrim(text, F.lit(SPACE_CHARS)), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def count_floor(df: DataFrame, count: str, limit: int) -> int:
    """The least count such that at most `limit` rows have it or a larger one.

    A histogram of the counts is gathered, never the rows. Its length is bounded: counts
    above `limit` are taken together by their binary logarithm.
    """
    kind = F.when(F.col(count) <= limit, F.col(count)).otherwise(
        F.pow(F.lit(2.0), F.floor(F.log2(F.col(count).cast("double")))).cast("long")
    )
    steps = df.groupBy(kind.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, None
    for c, n in sorted(((r.c, r.n) for r in steps), reverse=True):
        held += n
        if held > limit:
            break
        least = c
    return least if least is not None else max([r.c for r in steps], default=0) + 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `limit` bytes: first row, last row + 1, bytes, starts inside them.

    A longer text has a block of its own. `starts` has one entry more than rows.
    """
    data, offsets = utf8(column)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's stretch of `values`; empty stretches give 0."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[starts[1:]] - total[starts[:-1]]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = made
    return _powers[0], _powers[1]


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end, and row of every word of a block; words end with their row."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~IS_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[starts] = True
    gap = ~solid
    opens = solid.copy()
    opens[1:] &= gap[:-1] | cut[1:n]
    closes = solid.copy()
    closes[:-1] &= gap[1:] | cut[1:n]
    first, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return first, end, np.searchsorted(starts, first, "right") - 1


def word_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of a block, by prefix sums of a polynomial in an odd base."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))

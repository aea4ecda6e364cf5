"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions and its norm. The triangle inequality
of angles turns two rows' angles to one direction into an interval of the cosine between them,
and the norms turn that into bounds of their score, widened by more than rounding can cost.
A row is scored, in integers, only if its bounds overlap the window that an anchor still asks
for: above its last positive so far, or inside the span of its negatives' windows.

Rows are dealt into blocks and anchors into slices, so that a task holds one block of bounded
size and the anchors of a slice stream past it. A task passes on the first few of each anchor;
these are merged by rank. Nothing is gathered per label, so a label may hold most rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrina.llm.common import shuffle_width
from vitrina.session import written_table

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: low * positive <= per * negative <= high * positive
WINDOW = (30, 90, 100)
REFERENCES = 8
#: A row whose integer vector is this long or longer takes no part: its scores might pass a long.
LONGEST = 2.0**29.5
#: Share of the product of two norms by which a bound is widened. Angles near 0 are known to
#: about 2e-8, and bounds are computed in single precision.
SLACK = np.float32(1e-5)
#: A block holds at most so many rows, and so many bytes of vectors.
BLOCK_ROWS = 1 << 17
BLOCK_BYTES = 64 << 20
LEAST_BLOCK_ROWS = 256
SLICE_ANCHORS = 1 << 16
#: Rows and anchors whose bounds are computed at once.
ROW_CHUNK = 1 << 13
ANCHOR_CHUNK = 64
NO_ID = np.iinfo(np.int64).max
STORED = "key long, id long, is_anchor boolean, label string, vector array<int>, norm double, angles array<double>"
FOUND = "anchor_key long, anchor_id long, place int, positive_id long, positive_score long, found_id long, score long"


# --- stored rows ---------------------------------------------------------------------------


def _ragged(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column without null rows or items."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False)
    return values.astype(dtype), offsets - offsets[0]


def _square(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Ragged rows as a matrix; shorter rows are filled up with zeros."""
    out = np.zeros((len(offsets) - 1, width), values.dtype)
    lengths = np.diff(offsets)
    if (lengths == width).all():
        out[:] = values.reshape(-1, width)
    else:
        row = np.repeat(np.arange(len(lengths)), lengths)
        out[row, np.arange(len(values)) - np.repeat(offsets[:-1], lengths)] = values
    return out


def angles_to(vectors: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of every row to every reference direction; a row of zeros is at a right angle to all."""
    width = max(vectors.shape[1], references.shape[1])
    rows = np.pad(vectors.astype(np.float64), ((0, 0), (0, width - vectors.shape[1])))
    named = np.pad(references, ((0, 0), (0, width - references.shape[1])))
    cosines = rows @ named.T / np.where(norms > 0, norms, 1.0)[:, None]
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _stored(references: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _ragged(batch["vector"], np.float64)
            lengths = np.diff(offsets)
            with np.errstate(over="ignore"):
                values = np.clip(np.floor(SCALE * values), -LONGEST, LONGEST)
            whole = _square(values, offsets, int(lengths.max(initial=0)))
            norms = np.sqrt((whole**2).sum(axis=1))
            kept = np.flatnonzero(norms < LONGEST)
            if not len(kept):
                continue
            whole, norms = whole[kept], norms[kept]
            angles = angles_to(whole, norms, references)
            inside = np.repeat(np.isin(np.arange(len(lengths)), kept), lengths)
            starts = np.concatenate(([0], np.cumsum(lengths[kept]))).astype(np.int32)
            places = np.arange(0, angles.size + 1, angles.shape[1] or 1, dtype=np.int32)
            if not angles.shape[1]:
                places = np.zeros(len(kept) + 1, np.int32)
            taken = batch.take(pa.array(kept))
            columns = [taken[name] for name in ("key", "id", "is_anchor", "label")]
            columns += [
                pa.ListArray.from_arrays(pa.array(starts), pa.array(values[inside].astype(np.int32))),
                pa.array(norms),
                pa.ListArray.from_arrays(pa.array(places), pa.array(angles.ravel())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["key", "id", "is_anchor", "label", "vector", "norm", "angles"]
            )

    return rows


def stored_rows(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    is_anchor: Column | None = None,
    references: int = REFERENCES,
) -> DataFrame:
    """The rows that take part, with integer vector, norm, and angles to the reference directions.

    Directions are those of `references` rows drawn by hash; they change speed, never results.
    """
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    anchor = F.lit(True) if is_anchor is None else F.coalesce(is_anchor, F.lit(False))
    taking = rows.where(F.col(label).isNotNull() & F.col(embedding).isNotNull()).where(whole)
    named = taking.select(
        F.monotonically_increasing_id().alias("key"),
        F.col(vec_id).cast("long").alias("id"),
        anchor.alias("is_anchor"),
        F.col(label).cast("string").alias("label"),
        F.col(embedding).cast("array<double>").alias("vector"),
    )
    drawn = taking.select(F.col(embedding).cast("array<double>").alias("vector"))
    drawn = drawn.orderBy(F.xxhash64("vector"), "vector").limit(references).collect()
    directions = [np.array(r.vector) for r in drawn]
    with np.errstate(over="ignore", invalid="ignore"):
        directions = [d / np.sqrt((d**2).sum()) for d in directions if len(d)]
    directions = [d for d in directions if np.isfinite(d).all() and d.any()]
    width = max(map(len, directions), default=0)
    table = np.array([np.pad(d, (0, width - len(d))) for d in directions]).reshape(len(directions), width)
    return written_table(named.mapInArrow(_stored(table), STORED), "vectors")


# --- blocks of rows, anchors streaming past them -------------------------------------------


class Rows:
    """A block of rows, or some anchors: labels, ids, integer vectors, norms, angles."""

    def __init__(self, table: pa.Table):
        values, offsets = _ragged(table["vector"], np.int64)
        self.width = int(np.diff(offsets).max(initial=0))
        self.vectors = _square(values, offsets, self.width)
        self.norms = table["norm"].combine_chunks().to_numpy()
        angles, places = _ragged(table["angles"], np.float64)
        self.angles = _square(angles, places, int(np.diff(places).max(initial=0)))
        self.keys = table["key"].combine_chunks().to_numpy()
        self.ids = table["id"].combine_chunks().fill_null(NO_ID).to_numpy()
        self.labels = np.array(table["label"].to_pylist(), dtype=object)

    def ordered(self) -> Rows:
        """By label, so that a label's rows are one stretch, then by id."""
        self.names, codes = np.unique(self.labels.astype(str), return_inverse=True)
        order = np.lexsort((self.ids, codes))
        for name in ("vectors", "norms", "angles", "keys", "ids", "labels"):
            setattr(self, name, getattr(self, name)[order])
        self.edges = np.searchsorted(codes[order], np.arange(len(self.names) + 1))
        self.cosines, self.sines = self.turned()
        self.longest = float(self.norms.max(initial=0.0))
        return self

    def turned(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cos(self.angles).astype(np.float32), np.sin(self.angles).astype(np.float32)

    def stretch(self, label: str) -> tuple[int, int]:
        at = int(np.searchsorted(self.names, label))
        if at < len(self.names) and self.names[at] == label:
            return int(self.edges[at]), int(self.edges[at + 1])
        return 0, 0


def score_bounds(
    cos_a: np.ndarray, sin_a: np.ndarray, norm_a: np.ndarray, cos_b: np.ndarray, sin_b: np.ndarray, norm_b: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of every row of a with every row of b.

    Two rows at angles s and t to one direction are between |s - t| and s + t apart (or as far
    from a full turn), so their cosine lies between cos(s + t) and cos(s - t).
    """
    low = np.full((len(norm_a), len(norm_b)), -1.0, np.float32)
    high = np.full_like(low, 1.0)
    for r in range(cos_a.shape[1]):
        along = np.multiply.outer(cos_a[:, r], cos_b[:, r])
        across = np.multiply.outer(sin_a[:, r], sin_b[:, r])
        np.maximum(low, along - across, out=low)
        np.minimum(high, along + across, out=high)
    size = np.multiply.outer(norm_a, norm_b)
    return size * (low - SLACK) - 1.0, size * (high + SLACK) + 1.0


def exact_type(longest: float):
    """A type in which all sums of products are exact: they are integers below the norms' product."""
    return np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else np.int64


def first_by_score(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple:
    """The first n by falling score, then rising id."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        near = scores >= least
        scores, ids, rows = scores[near], ids[near], rows[near]
    order = np.lexsort((ids, -scores))[:n]
    return scores[order], ids[order], rows[order]


class Asked:
    """What one anchor asks of a block: a list of score windows, and the first n found in each."""

    def __init__(self, windows: list[tuple[int, int]], n: int):
        self.windows, self.n = windows, n
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        self.top = float(max((high for _, high in windows), default=-math.inf))
        self.least = min((low for low, _ in windows), default=math.inf)

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        for place, (low, high) in enumerate(self.windows):
            inside = (scores >= low) & (scores <= high)
            if not inside.any():
                continue
            held = self.found[place]
            merged = [np.concatenate((a, b[inside])) for a, b in zip(held, (scores, ids, rows), strict=True)]
            self.found[place] = first_by_score(*merged, self.n)
            if len(self.found[place][0]) == self.n:
                # an equal score with a smaller id may still come
                self.windows[place] = (max(low, int(self.found[place][0][-1])), high)
        self.least = min(low for low, _ in self.windows)


def scan(block: Rows, anchors: Rows, asked: list[Asked], stretches: list[list[tuple[int, int]]]) -> tuple[int, int]:
    """Fills `asked` from the given stretches of the block. Returns pairs bounded and pairs scored."""
    cos_a, sin_a = anchors.turned()
    width = max(block.width, anchors.width)
    kind = exact_type(block.longest * float(anchors.norms.max(initial=0.0)))
    own = np.pad(anchors.vectors, ((0, 0), (0, width - anchors.width))).astype(kind)
    bounded = scored = 0
    for first in range(0, len(block.keys), ROW_CHUNK):
        end = min(first + ROW_CHUNK, len(block.keys))
        wanted = np.zeros((len(asked), end - first), bool)
        for i, spans in enumerate(stretches):
            for a, b in spans:
                wanted[i, max(a - first, 0) : max(b - first, 0)] = True
        live = np.flatnonzero(wanted.any(axis=1))
        if not len(live):
            continue
        columns = np.flatnonzero(wanted.any(axis=0)) + first
        low, high = score_bounds(
            cos_a[live], sin_a[live], anchors.norms[live],
            block.cosines[columns], block.sines[columns], block.norms[columns],
        )
        least = np.array([asked[i].least for i in live], np.float64)[:, None]
        top = np.array([asked[i].top for i in live], np.float64)[:, None]
        overlaps = wanted[np.ix_(live, columns - first)] & (high >= least) & (low <= top)
        bounded += overlaps.size
        used = np.flatnonzero(overlaps.any(axis=0))
        if not len(used):
            continue
        rows = columns[used]
        theirs = np.pad(block.vectors[rows], ((0, 0), (0, width - block.width))).astype(kind)
        scores = own[live] @ theirs.T
        scored += int(overlaps.sum())
        for place, i in enumerate(live):
            hit = overlaps[place, used]
            hit &= block.keys[rows] != anchors.keys[i]
            if hit.any():
                asked[i].take(scores[place, hit].astype(np.int64), block.ids[rows[hit]], rows[hit])
    return bounded, scored


def _positives(block: Rows, anchors: Rows, table: pa.Table, settings: dict) -> list[Asked]:
    everything = (-(1 << 62), 1 << 62)
    asked = [Asked([everything], settings["positives"]) for _ in anchors.keys]
    scan(block, anchors, asked, [[block.stretch(name)] for name in anchors.labels])
    return asked


def _negatives(block: Rows, anchors: Rows, table: pa.Table, settings: dict) -> list[Asked]:
    low, high, per = settings["window"]
    asked, stretches = [], []
    for name, held in zip(anchors.labels, table["positives"].to_pylist(), strict=True):
        scores = [p["positive_score"] for p in held or []]
        asked.append(Asked([(-(-low * s // per), high * s // per) for s in scores], settings["negatives"]))
        a, b = block.stretch(name)
        stretches.append([(0, a), (b, len(block.keys))] if held else [])
    scan(block, anchors, asked, stretches)
    return asked


def _found(anchors: Rows, table: pa.Table, asked: list[Asked], negatives: bool) -> pa.RecordBatch:
    out: dict[str, list] = {name: [] for name in ("key", "id", "place", "positive", "positive_score", "found", "score")}
    held = table["positives"].to_pylist() if negatives else None
    ids = table["id"].to_pylist()
    for i, one in enumerate(asked):
        for place, (scores, found, _) in enumerate(one.found):
            positive = held[i][place] if negatives else {"place": 0, "positive_id": None, "positive_score": None}
            n = len(scores)
            out["key"] += [int(anchors.keys[i])] * n
            out["id"] += [ids[i]] * n
            out["place"] += [positive["place"]] * n
            out["positive"] += [positive["positive_id"]] * n
            out["positive_score"] += [positive["positive_score"]] * n
            out["found"] += [None if f == NO_ID else f for f in found.tolist()]
            out["score"] += scores.tolist()
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)],
        [part.split()[0] for part in FOUND.split(", ")],
    )


def _streamed(answer, settings: dict, negatives: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, block = None, [], None
        for batch in batches:
            tasks, kinds = batch["task"].to_numpy(), batch["kind"].to_numpy()
            edges = np.flatnonzero((np.diff(tasks) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                if tasks[a] != task:
                    task, held, block = tasks[a], [], None
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if not held:
                    continue
                if block is None:
                    block = Rows(pa.Table.from_batches(held)).ordered()
                for at in range(a, b, ANCHOR_CHUNK):
                    table = pa.Table.from_batches([batch.slice(at, min(ANCHOR_CHUNK, b - at))])
                    anchors = Rows(table)
                    yield _found(anchors, table, answer(block, anchors, table, settings), negatives)

    return run


def _passed(rows: DataFrame, anchors: DataFrame, blocks: int, slices: int, answer, settings, negatives) -> DataFrame:
    """What every anchor finds in every block, the anchors streaming past the block of a task."""
    spread = F.xxhash64("key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["key", "id", "label", "vector", "norm", "angles"]
    positives = "array<struct<place:int,positive_id:long,positive_score:long>>"
    block_side = rows.select(
        *columns, F.lit(0).alias("kind"), F.lit(None).cast(positives).alias("positives"),
        F.pmod(spread, F.lit(blocks)).cast("int").alias("block"), every(slices).alias("slice"),
    )
    anchor_side = anchors.select(
        *columns, F.lit(1).alias("kind"), F.col("positives").cast(positives).alias("positives"),
        F.pmod(spread, F.lit(slices)).cast("int").alias("slice"), every(blocks).alias("block"),
    )
    both = block_side.unionByName(anchor_side)
    both = both.withColumn("task", F.col("block") * slices + F.col("slice")).drop("block", "slice")
    dealt = both.repartitionById(blocks * slices, F.col("task")).sortWithinPartitions("task", "kind")
    return dealt.mapInArrow(_streamed(answer, settings, negatives), FOUND)


def mine_negatives(
    rows: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    is_anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int, int] = WINDOW,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For every anchor (all rows, unless `is_anchor` says which) and each of its first
    `positives` other rows of the same label, the first `negatives` rows of another label with
    low * positive_score <= per * negative_score <= high * positive_score. Scores are inner
    products of the components' floor(256 * x); higher scores come first, ties by smaller id.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor
    do rows whose integer vector is 2^29.5 long or longer. Shorter vectors count as filled up
    with zeros, so an empty vector scores 0 with all. A null id comes last among equal scores.
    Rows that repeat an id are rows of their own: each may be an anchor, a positive of the
    others, a negative. A positive score below 0 has no negatives. Other columns are not read.
    An empty table gives no rows.
    """
    spark = rows.sparkSession
    stored = stored_rows(rows, vec_id, embedding, label, is_anchor)
    size = stored.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_anchor").alias("anchors"), F.max(F.size("vector")).alias("width")
    ).first()
    most = max(LEAST_BLOCK_ROWS, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(size.width or 1, 1))))
    enough = math.ceil(size.rows / LEAST_BLOCK_ROWS)
    blocks = max(1, math.ceil(size.rows / most), min(shuffle_width(spark), enough))
    slices = max(1, math.ceil(size.anchors / SLICE_ANCHORS))
    settings = {"positives": positives, "negatives": negatives, "window": window}
    anchors = stored.where("is_anchor")

    by_score = [F.col("score").desc(), F.col("found_id").asc_nulls_last()]
    near = _passed(stored, anchors.withColumn("positives", F.lit(None)), blocks, slices, _positives, settings, False)
    place = F.row_number().over(Window.partitionBy("anchor_key").orderBy(*by_score))
    first = near.withColumn("_place", place).where(F.col("_place") <= positives)
    lists = first.groupBy(F.col("anchor_key").alias("key")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("_place").alias("place"),
                    F.col("found_id").alias("positive_id"),
                    F.col("score").alias("positive_score"),
                )
            )
        ).alias("positives")
    )
    asking = written_table(anchors.join(lists, "key"), "anchors")
    hard = _passed(stored, asking, blocks, slices, _negatives, settings, True)
    rank = F.row_number().over(Window.partitionBy("anchor_key", "place").orderBy(*by_score))
    return (
        hard.withColumn("rank", rank)
        .where(F.col("rank") <= negatives)
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("found_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


SQL = r"""
WITH taking AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM taking a JOIN taking b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER nearest AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
  AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW nearest AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER nearest <= 10
"""

"""Toxicity scores by a character n-gram classifier with naive Bayes scaled features.

The presence of each hashed byte n-gram (ASCII letters in lower case) is counted among toxic and other labelled
texts. Its log-count ratio scales it, and a logistic regression on the scaled features is
fitted; n-grams whose ratio is not clear of its own uncertainty are left out. A text's score is then the sum of a
weight for each distinct n-gram that it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import LOWER, blocks

ORDERS = (4, 5, 6, 7)
SLOT_BITS = 20
#: The classifier is fitted on at most about so many labelled texts, drawn by a hash.
LABELLED_TEXTS = 20_000
SMOOTHING = 0.5
#: A log-count ratio must be so many of its standard errors away from zero.
CLEAR = 2.5
#: N-grams that the classifier uses at most, those with the clearest ratios.
FEATURES = 4096
LEAST_TEXTS = 3
#: Bytes of text whose n-grams are worked out at a time.
STRETCH = 1 << 18
PENALTY = 1.0
TOXIC_FROM = 0.3


def gram_slots(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """Slot of the n-gram that begins at each byte; -1 where it would leave its row."""
    n = len(data)
    padded = np.concatenate((LOWER[data], np.full(order, 32, np.uint8)))
    key = np.full(n, order, np.uint64)
    for i in range(order):
        key = key * np.uint64(257) + padded[i : i + n]
    slots = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)
    for back in range(1, order):
        ends = starts[1:] - back
        slots[ends[ends >= starts[:-1]]] = -1
    return slots


def _long_row_slots(data: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """Distinct slots of one long text, by overlapping stretches that share a bitmap."""
    held = np.zeros(1 << SLOT_BITS, bool)
    for order in ORDERS:
        for at in range(0, len(data), STRETCH):
            part = data[at : at + STRETCH + order - 1]
            slots = gram_slots(part, np.array([0, len(part)]), order)
            held[slots[slots >= 0]] = True
    return np.flatnonzero(held if wanted is None else held & wanted)


def row_slots(data: np.ndarray, starts: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of each distinct n-gram of a block's rows; of `wanted` slots only if given.

    Memory follows `STRETCH`: a block is no longer, or is one row.
    """
    if len(data) > STRETCH and len(starts) == 2:
        slots = _long_row_slots(data, wanted)
        return np.zeros(len(slots), np.int64), slots
    pairs = []
    for order in ORDERS:
        slots = gram_slots(data, starts, order)
        at = np.flatnonzero(wanted[slots] & (slots >= 0) if wanted is not None else slots >= 0)
        row = np.searchsorted(starts, at, "right") - 1
        pairs.append(row.astype(np.int64) << SLOT_BITS | slots[at])
    found = np.unique(np.concatenate(pairs))
    return found >> SLOT_BITS, found & ((1 << SLOT_BITS) - 1)


@dataclass
class ToxicityModel:
    """A weight for each slot, nearly all zero, and a constant."""

    slots: np.ndarray
    weights: np.ndarray
    constant: float

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        weights = np.zeros(1 << SLOT_BITS)
        weights[self.slots] = self.weights
        wanted = np.zeros(1 << SLOT_BITS, bool)
        wanted[self.slots] = True
        return weights, wanted


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slot, toxic, texts: how many of the task's texts of each label hold the n-gram."""
    counts = np.zeros((2, 1 << SLOT_BITS), np.int32)
    for batch in batches:
        for first, end, data, starts in blocks(batch.column(1), STRETCH):
            label = np.array(batch.column(0).slice(first, end - first))
            row, slot = row_slots(data, starts)
            for side in (0, 1):
                np.add.at(counts[side], slot[label[row] == side], 1)
    for side in (0, 1):
        held = np.flatnonzero(counts[side])
        for i in range(0, len(held), 1 << 16):
            part = held[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(np.full(len(part), side, np.int32)), pa.array(counts[side][part].astype(np.int64))],
                ["slot", "toxic", "texts"],
            )


def _features(wanted: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, starts in blocks(batch.column(1), STRETCH):
                row, slot = row_slots(data, starts, wanted)
                edges = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                slots = pa.ListArray.from_arrays(pa.array(edges), pa.array(slot.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), slots], ["toxic", "slots"])

    return rows


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and constant on features 0 or scale[j], by batch gradient steps with momentum."""
    columns = np.concatenate(rows) if rows else np.zeros(0, int)
    of_row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = scale[columns]
    weights, base = np.zeros(len(scale)), np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    speed, base_speed, n = np.zeros(len(scale)), 0.0, len(labels)
    reach = np.bincount(of_row, value * value, minlength=n).max(initial=1.0) + 1
    rate = 4 * n / (reach * n / 4 + PENALTY) / 4
    for _ in range(300):
        z = np.bincount(of_row, value * weights[columns], minlength=n) + base
        error = labels - 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = (np.bincount(columns, value * error[of_row], minlength=len(scale)) - PENALTY * weights) / n
        speed, base_speed = 0.95 * speed + slope, 0.95 * base_speed + error.mean()
        weights, base = weights + rate * speed, base + rate * base_speed
    return weights, float(base)


def train(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    toxic: str = "toxic",
    most: int = LABELLED_TEXTS,
) -> ToxicityModel | None:
    """A model of labelled documents, about `most` of them drawn by a hash; None without labels.

    Null labels and ids are left out; a document with several labels counts as toxic if one of them says so.
    """
    marked = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
    marked = marked.groupBy(F.col(doc_id).alias("label_of")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    total = marked.count()
    share = min(1.0, most / max(1, total))
    draw = F.pmod(F.xxhash64(F.col("label_of")), F.lit(1_000_000)) / 1e6
    # At most about LABELLED_TEXTS rows of two numbers.
    sample = F.broadcast(marked.where(draw < share))
    texts = docs.select(F.col(doc_id).alias("label_of"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(sample, "label_of").select("toxic", "text")
    counted = (
        rows.mapInArrow(_slot_counts, "slot int, toxic int, texts long")
        .groupBy("slot")
        .agg(
            F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0)).alias("toxic"),
            F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0)).alias("other"),
        )
        .where(F.col("toxic") + F.col("other") >= LEAST_TEXTS)
        .orderBy("slot")
        .toArrow()
    )
    sides = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sides:
        return None
    slot = counted["slot"].to_numpy()
    with_toxic = counted["toxic"].to_numpy() + SMOOTHING
    with_other = counted["other"].to_numpy() + SMOOTHING
    ratio = np.log(with_toxic / (sides.get(1, 0) + 2 * SMOOTHING)) - np.log(with_other / (sides.get(0, 0) + 2 * SMOOTHING))
    doubt = np.sqrt(1 / with_toxic + 1 / with_other)
    beyond = np.abs(ratio) - CLEAR * doubt
    clear = np.argsort(-beyond, kind="stable")[: FEATURES if len(sides) > 1 else 0]
    clear = np.sort(clear[beyond[clear] > 0])
    slot, ratio = slot[clear], ratio[clear]
    wanted = np.zeros(1 << SLOT_BITS, bool)
    wanted[slot] = True
    place = np.zeros(1 << SLOT_BITS, np.int32)
    place[slot] = np.arange(len(slot))
    held = rows.mapInArrow(_features(wanted), "toxic int, slots array<int>").collect()
    held = sorted((r.toxic, tuple(r.slots)) for r in held)
    weights, constant = fit_logistic(
        [place[list(s)].astype(int) for _, s in held], np.array([t for t, _ in held], float), ratio
    )
    return ToxicityModel(slot, weights * ratio, constant)


def score_toxicity(
    docs: DataFrame, model: ToxicityModel | None, doc_id: str = "doc_id", text: str = "text", toxic_from: float = TOXIC_FROM
) -> DataFrame:
    """doc_id, score, predicted; one row per row of `docs`.

    A null text counts as empty; an empty text has the share of toxic texts that the model
    learned, and every text has score 0 when nothing was learned. Texts are read whole; equal
    texts have equal scores. Only the text is read. An empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        weights, wanted = held.dense() if held is not None else (None, None)
        for batch in batches:
            for first, end, data, starts in blocks(batch.column(1), STRETCH):
                scores = np.zeros(end - first)
                if held is not None:
                    row, slot = row_slots(data, starts, wanted)
                    z = np.bincount(row, weights[slot], minlength=end - first) + held.constant
                    scores = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(scores)], ["doc_id", "score"])

    scored = own.mapInArrow(rows, f"doc_id {kind}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= toxic_from, 1).otherwise(0))

"""Packing documents into sequences along a space-filling curve.

A document's words are hashed to signs, which project its word vector to a few dimensions. The
position of that point on a Hilbert curve orders documents so that similar ones are neighbours.
The order is cut into buckets of about as many documents by quantiles of the key; inside a
bucket token streams follow each other along the curve and are cut at the sequence length.
Only the last sequence of a bucket is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitrina.llm.common import LOWER, blocks, row_sums, shuffle_width, whole_text, word_hashes, word_spans
from vitrina.llm.tokens import PRE_TOKENS, Vocabulary, runs

SEQUENCE_TOKENS = 2048
END_ID = 1
DIMENSIONS = 3
CURVE_BITS = 10
SPREAD = 4
TIE_BITS = 62 - DIMENSIONS * CURVE_BITS
#: A bucket has at least so many bytes of text on average, so that its last sequence weighs little.
BUCKET_BYTES = 1 << 20
REMEMBERED = 1 << 18


def hilbert(points: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates of `bits` bits, one point per row.

    Gray-code form: rotations are undone from the highest bit down, then bits are interleaved.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit = 1 << level
        low = bit - 1
        for axis in range(n):
            high = (x[axis] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(high, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = key << 1 | (x[axis] >> level & 1)
    return key


def curve_keys(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hilbert key of every row of a block; rows without words have the key of the origin."""
    first, end, row = word_spans(LOWER[data], starts)
    word = word_hashes(LOWER[data], first, end)
    edges = np.searchsorted(row, np.arange(len(starts)))
    words = np.maximum(np.diff(edges), 1)
    top = (1 << CURVE_BITS) - 1
    points = np.empty((len(starts) - 1, DIMENSIONS), np.int64)
    for axis in range(DIMENSIONS):
        signs = (word >> np.uint64(7 + axis) & np.uint64(1)).astype(np.int8) * 2 - 1
        # Frequent words pull all documents of a language to one side.
        points[:, axis] = np.round((np.tanh(SPREAD * row_sums(signs, edges) / words) + 1) / 2 * top)
    return hilbert(points)


class IdWriter:
    """Token ids of texts as little-endian bytes, with the runs of the last texts remembered."""

    def __init__(self, path: str):
        vocabulary = Vocabulary(path)
        self.special = vocabulary.special
        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if max([*vocabulary.ids.values(), *self.special.values()]) < 1 << 16 else "<u4")
        self.fast = None
        if vocabulary.in_rank_order:
            self.fast = tiktoken.Encoding(
                "own", pat_str=PRE_TOKENS, mergeable_ranks=vocabulary.ids, special_tokens={}
            )
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        """The tokenizer's own ids of a whole text."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.width).tobytes()

    def texts(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        cut, missing = [], set()
        for number, text in enumerate(texts):
            if self.fast is None or any(s in text for s in self.special):
                out[number] = self._plain(text)
                continue
            own = runs(text)
            own[0] = "\n" + own[0]  # tells a text's first run from one behind a space
            cut.append((number, own))
            missing.update(own)
        self._learn(missing)
        known = self.known
        for number, own in cut:
            out[number] = b"".join(map(known.__getitem__, own))
        return out

    def _learn(self, wanted: set[str]) -> None:
        newer, older = self.newer, self.older
        if len(newer) + len(wanted) > REMEMBERED:
            self.older, self.newer = newer, {}
            newer, older = self.newer, self.older
        known, missing = {}, []
        for run in wanted:
            found = newer.get(run)
            if found is None:
                found = older.get(run)
                if found is None:
                    missing.append(run)
                    continue
                newer[run] = found
            known[run] = found
        for run, ids in zip(missing, self._runs(missing), strict=True):
            known[run] = newer[run] = ids
        self.known = known

    def _runs(self, missing: list[str]) -> list[bytes]:
        """Ids of new runs. Those without odd characters are encoded together, one to a line."""
        out, joined, at = [b""] * len(missing), [], []
        for number, run in enumerate(missing):
            if run[:1] == "\n" or not run or "\n" in run or "\r" in run or run[-1].isspace() or run[0].isspace():
                text = run[1:] if run[:1] == "\n" else " " + run
                out[number] = np.array(self.fast.encode_ordinary(text), self.width).tobytes()
            else:
                joined.append(run)
                at.append(number)
        if joined:
            line = self.fast.encode_ordinary("\n")[0]
            ids = np.array(self.fast.encode_ordinary("\n " + "\n ".join(joined)), self.width)
            breaks = np.flatnonzero(ids == line)
            if len(breaks) == len(joined):
                whole, size = ids.tobytes(), self.width.itemsize
                ends = [*breaks[1:].tolist(), len(ids)]
                for number, a, b in zip(at, breaks.tolist(), ends, strict=True):
                    out[number] = whole[(a + 1) * size : b * size]
            else:
                for number, run in zip(at, joined, strict=True):
                    out[number] = np.array(self.fast.encode_ordinary(" " + run), self.width).tobytes()
        return out


_writers: dict[str, IdWriter] = {}


def writer(path: str) -> IdWriter:
    """The id writer of this process for a vocabulary file."""
    if path not in _writers:
        _writers[path] = IdWriter(path)
    return _writers[path]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, starts in blocks(batch.column(1)):
            tie = batch.column(0).slice(first, end - first).to_numpy(zero_copy_only=False)
            key = curve_keys(data, starts) << TIE_BITS | tie
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.diff(starts))], ["key", "n_bytes"])


def _tokenized(path: str, end_id: int, cuts: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = writer(path)
        last = np.array([end_id], encode.width).tobytes()
        for batch in batches:
            for first, end, data, starts in blocks(batch.column(1)):
                tie = batch.column(0).slice(first, end - first).to_numpy(zero_copy_only=False)
                key = curve_keys(data, starts) << TIE_BITS | tie
                bucket = np.searchsorted(cuts, key.astype(np.float64), "right").astype(np.int32)
                texts = batch.column(1).slice(first, end - first).to_pylist()
                ids = [found + last for found in encode.texts(texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(first, end - first), pa.array(bucket), pa.array(key), pa.array(ids, pa.binary())],
                    ["doc_id", "bucket", "key", "ids"],
                )

    return rows


def _packed(path: str, length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = writer(path).width
        bucket, sequence, offset = None, 0, 0
        for batch in batches:
            out, source = [], []
            buckets = batch.column(1).to_pylist()
            for number, held in enumerate(batch.column(3)):
                if buckets[number] != bucket:
                    bucket, sequence, offset = buckets[number], buckets[number] << 40, 0
                ids = np.frombuffer(held.as_buffer(), width).astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    if offset == length:
                        sequence, offset = sequence + 1, 0
                    size = min(total - start, length - offset)
                    check = zlib.crc32(ids[start : start + size].tobytes())
                    out.append((start, size, check, total, sequence, offset))
                    source.append(number)
                    start, offset = start + size, offset + size
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            ids_of = batch.column(0).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_of, *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    return rows


def pack(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; one row per piece.

    A document is its token ids and then `end_id`; every id lies in one piece. Ids are the
    tokenizer's without added special tokens. A null text is empty and is packed as its end
    id alone. Repeated rows are packed again each. Copies lie in any order, by a hash of
    doc_id. An empty table gives no rows. Other columns are not read.
    """
    tie = F.xxhash64(F.col(doc_id)).bitwiseAND((1 << TIE_BITS) - 1).alias("tie")
    own = docs.select(tie, whole_text(text).alias("text"), F.col(doc_id).alias("doc_id"))
    kind = own.schema["doc_id"].dataType.simpleString()
    keys = own.select("tie", "text").mapInArrow(_keyed, "key long, n_bytes long")
    buckets = shuffle_width(docs.sparkSession)
    steps = [i / buckets for i in range(1, buckets)] or [0.5]
    found = keys.agg(F.percentile_approx("key", steps, 20 * buckets).alias("cuts"), F.sum("n_bytes").alias("n")).first()
    buckets = max(1, min(buckets, (found.n or 0) // BUCKET_BYTES))
    steps = np.array(found.cuts or [], np.float64)
    cuts = steps[[len(steps) * i // buckets for i in range(1, buckets)]] if buckets > 1 else steps[:0]
    placed = own.mapInArrow(
        _tokenized(vocabulary, end_id, cuts), f"doc_id {kind}, bucket int, key long, ids binary"
    )
    along = placed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "key", "doc_id")
    return along.mapInArrow(
        _packed(vocabulary, length),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )

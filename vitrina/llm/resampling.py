"""Drawing documents that resemble a target text collection, by importance resampling.

An untrained Regex Split of the tokenizers library takes the words of ASCII-lowered text with
their offsets. A feature is the text between the first offset of one word and the last offset of
another a few words on, its words joined by one space; its CRC picks one of a fixed number of
buckets. Both collections are counted by bucket, the smoothed log ratio of a bucket's shares is
its gain, and a document's weight is the mean gain of its features. Weights plus Gumbel noise
of the ids rank the documents, which draws without replacement.

A text is split once. Its buckets are written as one binary value per document, and both the
histogram and the weights are taken from these.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from vitrina.llm.common import whole_text
from vitrina.operators.ordering import rank_within
from vitrina.session import written_table

#: A word in text whose A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
MOST_WORDS = 1
LEAST_WORDS = 20
DRAWN = (10, 100)
SEED = "2024"
#: A text is split in stretches of about so many characters; none cuts a word.
STRETCH = 1 << 14
#: Buckets of so many features are remembered, in two generations.
REMEMBERED = 1 << 18
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Features:
    """Buckets of the word windows of texts."""

    def __init__(self, buckets: int = BUCKETS, most_words: int = MOST_WORDS):
        self.buckets, self.most_words = buckets, most_words
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.newer: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def stretches(self, text: str) -> Iterator[str]:
        """The text in pieces that end before a character of no word."""
        at = 0
        while len(text) - at > STRETCH:
            gap = _GAP.search(text, at + STRETCH)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:]

    def found(self, features: list[str]) -> np.ndarray:
        """Bucket of every feature."""
        known = list(map(self.newer.get, features))
        if None in known:
            for at, bucket in enumerate(known):
                if bucket is None:
                    known[at] = self._looked_up(features[at])
        return np.array(known, np.uint32)

    def _looked_up(self, feature: str) -> int:
        known = self.older.get(feature)
        if known is None:
            known = zlib.crc32(feature.encode("utf-8")) % self.buckets
        if len(self.newer) >= REMEMBERED:
            self.older, self.newer = self.newer, {}
        self.newer[feature] = known
        return known

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every run of 1 to `most_words` words."""
        words, found, before = 0, [], []
        for stretch in self.stretches(text.translate(_LOWER)):
            spans = [span for _, span in self.split.pre_tokenize_str(stretch)]
            words += len(spans)
            if self.most_words == 1:
                found.append(self.found([stretch[a:b] for a, b in spans]))
                continue
            # windows over the joint: the last words of the stretch before stand in front
            run = before + [stretch[a:b] for a, b in spans]
            line = " ".join(run)
            ends = np.cumsum([len(w) + 1 for w in run]) - 1
            starts = [e - len(w) for e, w in zip(ends, run, strict=True)]
            windows = [
                line[starts[i] : ends[i + n]]
                for n in range(self.most_words)
                for i in range(max(0, len(before) - n), len(run) - n)
            ]
            found.append(self.found(windows))
            before = run[-(self.most_words - 1) :]
        return words, np.concatenate(found) if found else np.zeros(0, np.uint32)


FEATURE_ROWS = "key long, doc_id long, n_words long, n_features long, buckets binary"


def _cut(buckets: int, most_words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(buckets, most_words)
        for batch in batches:
            cut = [features.of(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["key"],
                    batch["doc_id"],
                    pa.array([words for words, _ in cut], pa.int64()),
                    pa.array([len(found) for _, found in cut], pa.int64()),
                    pa.array([found.astype("<u4").tobytes() for _, found in cut], pa.binary()),
                ],
                ["key", "doc_id", "n_words", "n_features", "buckets"],
            )

    return rows


def feature_rows(
    rows: DataFrame, row_id: str, text: str = "text", buckets: int = BUCKETS, most_words: int = MOST_WORDS
) -> DataFrame:
    """key, doc_id, n_words, n_features and the features' buckets of every row, as four bytes each."""
    named = rows.select(
        F.monotonically_increasing_id().alias("key"),
        F.col(row_id).cast("long").alias("doc_id"),
        whole_text(text).alias("text"),
    )
    return named.mapInArrow(_cut(buckets, most_words), FEATURE_ROWS)


def _counts(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch["buckets"]:
                total += np.bincount(np.frombuffer(value.as_buffer(), "<u4"), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "features"])

    return rows


def histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, features: at most one row per bucket. Each task sends its sums only."""
    parts = features.select("buckets").mapInArrow(_counts(buckets), "bucket long, features long")
    return parts.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln) of every bucket's smoothed share in the target over that in the source."""
    s, t = (np.array([held.get(b, 0) for b in range(buckets)], np.float64) for held in (source, target))
    return np.floor(1000.0 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(table: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = []
            for value in batch["buckets"]:
                held = np.frombuffer(value.as_buffer(), "<u4")
                weight.append(int(table[held].sum()) // len(held) if len(held) else 0)
            names = ["key", "doc_id", "n_words", "n_features"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[name] for name in names), pa.array(weight, pa.int64())], [*names, "weight"]
            )

    return rows


def noise(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """Gumbel noise of a row's id, in thousandths."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _cut_score(scored: DataFrame, quota: int) -> int | None:
    """The score of the last drawn row. A score is an integer within about 60,000 of 0, so the
    list of scores, counted once more in one task, is bounded."""
    counted = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy().orderBy(F.col("score").desc())
    reached = counted.withColumn("_above", F.sum("n").over(above)).where(F.col("_above") >= quota)
    return reached.agg(F.max("score").alias("score")).first().score


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_id: str = "item_id",
    target_text: str = "text",
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
    least_words: int = LEAST_WORDS,
    drawn: tuple[int, int] = DRAWN,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank; one row per row of `docs`.

    `rank` numbers the drawn rows 1, 2, 3 by falling score, ties by smaller id; it is null for
    the rest. floor(drawn[0] * N / drawn[1]) rows are drawn of the N with `least_words` words.

    Texts are read whole; a null or empty text has no words and weight 0. A null id comes after
    all others among equal scores. Rows that repeat an id are drawn one by one, in no stated
    order among themselves where their scores are equal. An empty target makes all its shares
    equal; an empty `docs` gives no rows. Other columns are not read.
    """
    features = written_table(feature_rows(docs, doc_id, text, buckets, most_words), "features")
    wanted = feature_rows(target, target_id, target_text, buckets, most_words)
    # two lists of at most one row per bucket
    counted = [{r.bucket: r.features for r in histogram(rows, buckets).collect()} for rows in (features, wanted)]
    table = gains(*counted, buckets)
    weighed = features.mapInArrow(
        _weights(table), "key long, doc_id long, n_words long, n_features long, weight long"
    )
    scored = written_table(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)), "scores")
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    eligible = F.col("n_words") >= least_words
    quota = drawn[0] * scored.where(eligible).count() // drawn[1]
    cut = _cut_score(scored.where(eligible), quota) if quota else None
    unranked = [*columns, F.lit(None).cast("long").alias("rank")]
    if cut is None:
        return scored.select(*unranked)
    near = eligible & (F.col("score") >= cut)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("key")]
    ranked = rank_within(scored.where(near), [], order, "_rank")
    rank = F.when(F.col("_rank") <= quota, F.col("_rank")).cast("long")
    return ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~near).select(*unranked))


SQL = r"""
WITH remainders AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda x, i:
           CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS r
), texts AS (
  SELECT 's' AS side, doc_id AS id, text FROM documents
  UNION ALL SELECT 't', item_id, text FROM benchmark
), cut AS (
  SELECT side, id, row_number() OVER () AS key, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts
), features AS (
  SELECT side, id, key, unnest(words) AS word FROM cut
), spelled AS (
  SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM features)
), hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(code), 2),
           lambda i: CAST('0x' || substr(code, i, 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, r[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM spelled, remainders
), held AS (
  SELECT f.side, f.id, f.key, h.bucket FROM features f JOIN hashed h ON f.word = h.word
), totals AS (
  SELECT CAST(count(*) FILTER (side = 's') AS DOUBLE) AS s_all, CAST(count(*) FILTER (side = 't') AS DOUBLE) AS t_all
  FROM held
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((count(*) FILTER (side = 't') + 1) * (any_value(s_all) + 10000)
           / ((count(*) FILTER (side = 's') + 1) * (any_value(t_all) + 10000)))) AS BIGINT) AS gain
  FROM held, totals GROUP BY bucket
), weighed AS (
  SELECT key, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM held JOIN gains USING (bucket) WHERE side = 's' GROUP BY key
), scored AS (
  SELECT c.id AS doc_id, CAST(len(c.words) AS BIGINT) AS n_features, coalesce(w.weight, 0) AS weight,
         coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || c.id), 1, 8) AS BIGINT)
           + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM cut c LEFT JOIN weighed w ON c.key = w.key WHERE c.side = 's'
), numbered AS (
  SELECT *, n_features >= 20 AS eligible,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS quota
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= quota THEN place END AS rank
FROM numbered
"""

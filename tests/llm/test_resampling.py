"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from vitrina.llm import resampling

SCHEMA = "doc_id long, text string, key int, buckets string, score string, rank int, _rank int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "Ñandú x-ray 12 日本 " * 9000
TARGET = ["the river and the house", "Über den Fluss", None, ""]


def docs():
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 60))) for i in range(200)]
    rows += [(300, "the river and the house " * 8), (301, LONG), (302, "a" * 40_000), (303, None), (304, "")]
    rows += [(305, "THE River\x00and;the\x7fhouse " * 5), (300, "the river and the house " * 8)]
    return rows + [(306, "\n \t"), (None, "the house " * 15), (307, "the river " * 12)]


def features(text, most_words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [" ".join(words[i : i + n]) for n in range(1, most_words + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(run.encode()) for run in runs]


def brute_force(rows, target, buckets, most_words, least_words, drawn):
    s, t = Counter(), Counter()
    held = [(i, *features(text, most_words)) for i, text in rows]
    for _, _, found in held:
        s.update(f % buckets for f in found)
    for text in target:
        t.update(f % buckets for f in features(text, most_words)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, words, found in held:
        gains = [
            math.floor(1000 * math.log((t[f % buckets] + 1) * (S + buckets) / ((s[f % buckets] + 1) * (T + buckets))))
            for f in found
        ]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, words, len(found), weight, score, None])
    ranked = [r for r in out if r[1] >= least_words]
    ranked.sort(key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for rank, row in enumerate(ranked[: drawn[0] * len(ranked) // drawn[1]], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=repr)


def run(spark, rows, target=TARGET, **more):
    table = spark.createDataFrame([(*r, 1, "b", "s", 1, 1) for r in rows], SCHEMA)
    wanted = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    return sorted(map(tuple, resampling.resample(table, wanted, **more).collect()), key=repr)


def test_matches_a_plain_version(spark):
    for buckets, most, least, drawn in ((10_000, 1, 20, (10, 100)), (101, 3, 1, (1, 2)), (7, 2, 0, (1, 1))):
        got = run(spark, docs(), buckets=buckets, most_words=most, least_words=least, drawn=drawn)
        assert got == brute_force(docs(), TARGET, buckets, most, least, drawn)


def test_stretches_change_nothing(monkeypatch):
    for most in (1, 2, 4):
        whole = [resampling.Features(97, most).of(text or "") for _, text in docs()]
        with monkeypatch.context() as m:
            m.setattr(resampling, "STRETCH", 13)
            m.setattr(resampling, "REMEMBERED", 5)
            cut = [resampling.Features(97, most).of(text or "") for _, text in docs()]
        for (words, found), (words_cut, found_cut) in zip(whole, cut, strict=True):
            assert words == words_cut and sorted(found) == sorted(found_cut)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, docs(), target=[]) == brute_force(docs(), [], 10_000, 1, 20, (10, 100))


def test_documents_like_the_target_are_drawn(spark):
    plain = [(i, " ".join(f"w{(i * 31 + j * 7) % 500}" for j in range(40))) for i in range(1000)]
    like = [(5000 + i, "the river and the house by the old mill " * 4) for i in range(50)]
    got = run(spark, plain + like, target=["the river and the house by the old mill"] * 50)
    drawn = [r for r in got if r[5] is not None]
    alike = sum(r[0] >= 5000 for r in drawn)
    # the draw is random by design: what counts is how much likelier these are than the rest
    assert len(drawn) == 105 and alike / 50 > 5 * (105 - alike) / 1000


def test_ranks_are_numbered_in_order(spark):
    rows = [(i % 50, "one two three " * 10) for i in range(400)]  # repeated ids, equal scores
    got = [r for r in run(spark, rows, drawn=(50, 100))]
    ranked = sorted((r for r in got if r[5] is not None), key=lambda r: r[5])
    assert [r[5] for r in ranked] == list(range(1, 201))
    assert [(-r[4], r[0]) for r in ranked] == sorted((-r[4], r[0]) for r in ranked)


def test_the_histogram_holds_one_row_a_bucket(spark):
    table = spark.createDataFrame(docs(), "doc_id long, text string")
    found = resampling.histogram(resampling.feature_rows(table, "doc_id", buckets=11), 11)
    assert found.groupBy("bucket").count().where(F.col("count") > 1).count() == 0 and found.count() <= 11

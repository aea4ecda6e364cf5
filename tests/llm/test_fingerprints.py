"""SimHash against a plain version, hot ids, and the recall of the radius."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vitrina.llm import common, fingerprints

SCHEMA = "doc_id long, text string, fp string, bucket int, row int"


def term_hash(word, following):
    """Spark's xxhash64 of two strings: each is hashed with the hash so far as seed, nulls change nothing."""
    h = xxhash.xxh64(word.encode(), seed=42).intdigest()
    return h if following is None else xxhash.xxh64(following.encode(), seed=h).intdigest()


def simhash(text):
    words = re.split(r"[\x20\x09-\x0D]+", ("\x02 " + (text or "").strip(" \t\n\x0b\f\r")))
    votes = [0] * 64
    for at, word in enumerate(words):
        h = term_hash(word, words[at + 1] if at + 1 < len(words) else None)
        for bit in range(64):
            votes[bit] += len(word) if h >> bit & 1 else -len(word)
    return sum(1 << bit for bit in range(64) if votes[bit] > 0)


def texts():
    rng = np.random.default_rng(4)
    words = [f"w{i}" * (i % 3 + 1) for i in range(80)] + ["ñandú", "日本"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "a  b\tc"), (505, "x " * 5000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, 2) for r in rows], SCHEMA)


def expected(rows, order):
    out = []
    for at, n in enumerate(order):
        doc_id, own = rows[n][0], rows[n][1] or ""
        after = rows[order[(at + 1) % len(order)]][1] or ""
        quarter = len(own) // 4
        edited = own[: len(own) - quarter] + after[:quarter]
        fp = (simhash(own), simhash(edited), simhash(after))
        out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), *fp))
    return out


def found(spark, rows):
    unsigned = lambda v: v % (1 << 64)
    got = fingerprints.fingerprint_documents(table(spark, rows)).collect()
    return [(r.doc_id, r.n_chars, r.edited_sha256, *map(unsigned, (r.fp, r.edited_fp, r.next_fp))) for r in got]


def test_matches_a_plain_simhash(spark):
    rows = texts()
    assert sorted(found(spark, rows)) == sorted(expected(rows, sorted(range(len(rows)), key=lambda n: rows[n][0])))


def test_hot_and_missing_ids_are_cut_by_their_tie(spark):
    rows = [(7 if i % 2 else None if i % 3 == 0 else i, f"text number {i} " * (i % 5)) for i in range(900)]
    signed = lambda n: (n + (1 << 63)) % (1 << 64) - (1 << 63)
    tie = [signed(xxhash.xxh64((t or "").encode(), seed=42).intdigest()) for _, t in rows]
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, tie[n]))
    assert sorted(found(spark, rows), key=repr) == sorted(expected(rows, order), key=repr)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        tied = table(spark, rows).select("doc_id", F.xxhash64(common.whole_text()).alias("tie"))
        cut = tied.withColumn("bucket", fingerprints.id_buckets(tied, "doc_id", "tie")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert max(np.unique([r.bucket for r in cut], return_counts=True)[1]) < 0.25 * len(rows)
    along = sorted(cut, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.bucket for r in along] == sorted(r.bucket for r in along)


def test_ids_that_are_no_numbers_are_refused(spark):
    named = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    with pytest.raises(TypeError):
        fingerprints.fingerprint_documents(named)


def test_small_edits_of_long_texts_are_within_the_radius(spark):
    """Recall of three bits: one word of 400 to 600 changed."""
    rng = np.random.default_rng(9)
    words = np.array([f"word{i}" for i in range(3000)])
    near = 0
    for _ in range(60):
        own = rng.choice(words, rng.integers(400, 600))
        other = own.copy()
        other[rng.integers(len(own))] = "changed"
        near += (simhash(" ".join(own)) ^ simhash(" ".join(other))).bit_count() <= fingerprints.RADIUS
    assert near >= 45


def test_near_ids_name_one_document_of_each_near_fingerprint(spark):
    rng = np.random.default_rng(2)
    base = [int(b) for b in rng.integers(-(2**62), 2**62, 30)]
    flips = [b ^ sum(1 << int(i) for i in rng.choice(60, k, replace=False)) for b in base for k in range(5)]
    rows = [(i, fp, i % 7 == 0) for i, fp in enumerate([*base, *flips, *base[:5]])]
    got = fingerprints.near_classes(spark.createDataFrame(rows, "doc_id long, fp long, is_query boolean")).collect()
    apart = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {}
    for fp in {fp for _, fp, asked in rows if asked}:
        near = [(i, other) for i, other, _ in rows if apart(fp, other) <= 3]
        least = {}
        for i, other in near:
            least.setdefault(other, i)
        want[fp] = (len(near), sorted(least.values()))
    assert {r.query_fp: (r.near_docs, list(r.near_ids)) for r in got} == want

"""Hard negatives against brute force, and the bounds against the scores they bound."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label string, key int, kind string, task long"
ANCHOR = "vec_id % 4 = 0"


def brute_force(rows, positives=5, wanted=10, window=(30, 90, 100)):
    """One row at a time, with Python's integers."""
    low, high, per = window
    taking = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(256 * x) for x in vector]
        if sum(x * x for x in whole) < 2**59:
            taking.append((vec_id, whole, label))
    last = float("inf")
    out = []
    for at, (anchor, own, label) in enumerate(taking):
        if anchor is None or anchor % 4:
            continue
        scored = [
            (-sum(a * b for a, b in zip(own, other, strict=False)), last if i is None else i, name == label)
            for n, (i, other, name) in enumerate(taking)
            if n != at
        ]
        scored.sort(key=lambda r: r[:2])
        same = [r for r in scored if r[2]][:positives]
        for p, positive, _ in same:
            held = [r for r in scored if not r[2] and low * -p <= per * -r[0] <= high * -p][:wanted]
            out += [
                (anchor, None if positive == last else positive, rank, None if n == last else n, -p, -s)
                for rank, (s, n, _) in enumerate(held, 1)
            ]
    return out


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    found = negatives.mine_negatives(table, is_anchor=F.expr(ANCHOR), **more).collect()
    return sorted(map(tuple, found), key=repr)


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0.2, 0.3, 6)], "abc"[i % 3] if i % 7 else "a") for i in range(90)]
    rows += [(100 + i, rows[0][1], "ab"[i % 2]) for i in range(40)]  # one common vector, ties by id
    rows += [(8, rows[8][1], "b"), (8, rows[8][1], "b"), (12, rows[3][1], "a"), (None, rows[4][1], "a")]
    rows += [(200, [], "a"), (204, [0.0] * 6, "b"), (208, [1.0, 2.0], "c"), (212, [0.5] * 9, "a")]
    rows += [(300, None, "a"), (304, [float("nan")] * 6, "a"), (308, [float("inf")] * 6, "a"), (312, [None, 1.0], "a")]
    rows += [(316, [1.0] * 6, None), (320, [1e9, -1e300], "a"), (324, [2.0**20, -(2.0**20)], "a"), (328, [2.0**20] * 2, "b")]
    return rows


def test_matches_brute_force(spark):
    rows = odd_rows()
    assert mined(spark, rows) == sorted(brute_force(rows), key=repr)
    assert mined(spark, rows, positives=2, negatives=3, window=(-50, 150, 100)) == sorted(
        brute_force(rows, 2, 3, (-50, 150, 100)), key=repr
    )


def test_blocks_and_slices_change_nothing(spark, monkeypatch):
    rows = odd_rows()
    whole = mined(spark, rows)
    monkeypatch.setattr(negatives, "LEAST_BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 9)
    monkeypatch.setattr(negatives, "SLICE_ANCHORS", 5)
    assert mined(spark, rows) == whole


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], "a")]) == []
    assert mined(spark, [(4, [1.0], "a"), (8, [1.0], "a")]) == []


vectors = st.integers(1, 9).flatmap(
    lambda n: st.lists(st.lists(st.integers(-3000, 3000), min_size=n, max_size=n), min_size=2, max_size=6)
)


@settings(max_examples=200, deadline=None)
@given(vectors, st.data())
def test_bounds_hold(drawn, data):
    table = np.array(drawn, np.float64)
    n = table.shape[1]
    directions = np.array(data.draw(st.lists(st.lists(st.integers(-9, 9), min_size=n, max_size=n), max_size=4)), float)
    directions = directions.reshape(-1, n)
    directions = directions[(directions != 0).any(axis=1)]
    directions /= np.sqrt((directions**2).sum(axis=1))[:, None]
    norms = np.sqrt((table**2).sum(axis=1))
    angles = negatives.angles_to(table, norms, directions)
    parts = np.cos(angles).astype(np.float32), np.sin(angles).astype(np.float32), norms
    low, high = negatives.score_bounds(*parts, *parts)
    scores = table @ table.T
    assert (low <= scores).all() and (scores <= high).all()


def test_rows_outside_the_window_are_not_scored():
    """Two far clusters with a direction in each: only the near one is scored."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    near = np.array([900, 0, 0]) + rng.integers(-9, 9, (300, 3))
    far = np.array([0, 0, 900]) + rng.integers(-9, 9, (300, 3))
    table = np.concatenate([near, far]).astype(np.float64)
    norms = np.sqrt((table**2).sum(axis=1))
    angles = negatives.angles_to(table, norms, np.array([[1.0, 0, 0], [0, 0, 1.0]]))
    held = pa.table(
        {
            "key": np.arange(600),
            "id": np.arange(600),
            "label": ["a"] * 600,
            "vector": pa.array(table.astype(np.int32).tolist(), pa.list_(pa.int32())),
            "norm": norms,
            "angles": pa.array(angles.tolist(), pa.list_(pa.float64())),
        }
    )
    block, anchors = negatives.Rows(held).ordered(), negatives.Rows(held.slice(0, 4))
    asked = [negatives.Asked([(700_000, 1 << 40)], 10) for _ in range(4)]
    bounded, scored = negatives.scan(block, anchors, asked, [[block.stretch("a")]] * 4)
    assert (bounded, scored) == (2400, 1200)
    assert all(len(a.found[0][0]) == 10 for a in asked)


@pytest.mark.parametrize("longest,kind", [(2**23, np.float32), (2**52, np.float64), (2**58, np.int64)])
def test_scores_are_summed_in_an_exact_type(longest, kind):
    assert negatives.exact_type(float(longest)) is kind

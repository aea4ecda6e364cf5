"""Inputs whose reading is known from how they are made."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.functions import money, text
from vitrina.operators.adapters.embedded import bracketed


def spelled(units: int, cents: int | None, grouping: str, point: str, places: int) -> str:
    """A price the way a shop would write it."""
    whole = f"{units:,}".replace(",", grouping)
    return whole if cents is None else f"{whole}{point}{cents:02d}"[: None if places == 2 else -1]


def test_prices_read_back_as_the_number_they_were_written_from(spark):
    rng = random.Random(11)
    written, wanted = [], []
    for _ in range(3000):
        units = rng.randrange(10 ** rng.randrange(1, 16))
        places = rng.choice([1, 2])
        cents = rng.choice([None, rng.randrange(10) * 10 if places == 1 else rng.randrange(100)])
        grouping, point = rng.choice([(".", ","), (",", "."), ("", ","), ("", ".")])
        before, after = rng.choice(["", "$", "ARS ", "Now: € "]), rng.choice(["", " c/u", " €"])
        written.append(before + spelled(units, cents, grouping, point, places) + after)
        wanted.append(units * 100 + (cents or 0))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(written)], "i int, v string")
    got = rows.select("i", money.parse_price(F.col("v")).alias("p")).orderBy("i").collect()
    for row, value, want in zip(got, written, wanted, strict=True):
        assert row.p is not None and int(row.p * 100) == want, value


def test_white_space_is_what_browsers_trim(spark):
    points = [c for c in range(1, 0x3100) if not 0xD800 <= c <= 0xDFFF] + [0xFEFF, 0x1F600]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, v string")
    spaces = rows.where(F.col("v").rlike(f"^a{text.WS}b$")).select("c").collect()
    assert sorted(r.c for r in spaces) == sorted(text.SPACES)


quoted = st.builds(
    lambda mark, inside: mark + "".join("\\" + c if c in (mark, "\\") else c for c in inside) + mark,
    st.sampled_from("\"'"),
    st.text(alphabet="{}[]\"'\\ab\n", max_size=6),
)
plain = st.text(alphabet="abc:, \n", max_size=4)


def wrapped(inner):
    pair = st.sampled_from(["{}", "[]"])
    return st.builds(lambda p, parts: p[0] + "".join(parts) + p[1], pair, st.lists(inner | plain | quoted, max_size=4))


blocks = wrapped(st.recursive(plain | quoted, wrapped, max_leaves=12))


@settings(max_examples=500, deadline=None)
@given(plain, blocks, st.text(alphabet="{}[]\"'\\a", max_size=8))
def test_a_block_ends_where_it_was_closed(before, block, after):
    source = before + block + after
    assert bracketed(source, len(before)) == block


@settings(max_examples=200, deadline=None)
@given(blocks)
def test_a_block_that_was_not_closed_has_no_end(block):
    assert bracketed(block[:-1], 0) is None

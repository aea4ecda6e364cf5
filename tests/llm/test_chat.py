"""Formatted conversations: exact round trips, spans, and pieces."""

import hashlib
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitrina.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part int, piece string, formatted int"
PARTS = [*chat.TEMPLATE.controls, "\\", "<", ">", "s", "/", "[", "]", "INST", "ñ", "日", "\n", " ", "", "\x00", "<\\/s>"]
said = st.lists(st.sampled_from(PARTS), max_size=8).map("".join) | st.text(max_size=12)
roles = st.sampled_from(["user", "assistant", "system", "tool", "", "<s>", "[/ROLE]", "a\\b"])


def escape(text):
    """One character at a time."""
    out = []
    for at, c in enumerate(text):
        starts = any(text.startswith(control, at - 1) for control in chat.TEMPLATE.controls) if at else False
        out.append("\\" + c if c == "\\" or starts else c)
    return "".join(out)


def formatted(role, text):
    head, foot = chat.TEMPLATE.roles.get(role, chat.TEMPLATE.other)
    return head.replace("{role}", escape(role)) + escape(text) + foot


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(roles, said), min_size=1, max_size=6))
def test_assembly_is_a_round_trip(turns):
    made = chat.format_turns(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]))
    whole = made.data.tobytes().decode()
    assert whole == "".join(formatted(*turn) for turn in turns)
    assert list(chat.read_turns(whole)) == turns
    for n, (role, text) in enumerate(turns):
        inner = made.data[made.text_first[n] : made.text_end[n]].tobytes().decode()
        assert chat.unescaped(inner) == text and made.learned[n] == (role == "assistant")
        assert not any(control in inner for control in chat.TEMPLATE.controls)


def test_control_strings_stand_where_the_template_puts_them():
    made = chat.format_turns(pa.array(["user"]), pa.array(["</s>[INST] ok [/INST]"]))
    assert made.data.tobytes().decode() == "<s>[INST] <\\/s>[\\INST] ok [\\/INST] [/INST]"


def test_templates_that_could_be_misread_are_refused():
    for controls in (("<",), ("a b",), ("<\\s>",)):
        with pytest.raises(ValueError):
            chat.Template(controls=controls)
    with pytest.raises(ValueError):
        chat.Template(roles={"user": ("<u>", "</u>")})


def test_another_template():
    template = chat.Template(
        roles={"bot": ("«bot»\n", "\n«end»")}, other=("«{role}»\n", "\n«end»"), controls=("«bot»", "«end»"), learned="bot"
    )
    turns = [("bot", "«end» ««bot»"), ("me", "\\«bot»")]
    made = chat.format_turns(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), template)
    assert list(chat.read_turns(made.data.tobytes().decode(), template)) == turns


def odd_turns():
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, None, "user", "last"), (2, 5, "tool", None)]
    rows += [(3, 0, None, "x"), (3, 0, "assistant", ""), (None, 0, "user", "who"), (None, 1, "assistant", "me\\n")]
    rows += [(4, n, "assistant" if n % 2 else "user", f"turn {n} [INST]" * (n % 7)) for n in range(500)]
    rows += [(5, 0, "user", "ñ<s>" * 400_000), (5, 1, "assistant", "ok" * 900_000), (6, 0, "assistant", "same")]
    return rows + [(6, 0, "assistant", "same")] * 300


def digests(rows):
    held = {}
    for conv, turn, role, text in rows:
        order = (turn is None, turn or 0, role or "", text or "")
        held.setdefault(conv, []).append((order, role or "", text or ""))
    out = {}
    for conv, turns in held.items():
        turns.sort(key=lambda t: t[0])
        learned = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (
            len(turns),
            hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in turns).encode()).hexdigest(),
            len(learned),
            hashlib.sha256(learned.encode()).hexdigest(),
            sum(len(formatted(role, text)) for _, role, text in turns if len(text) < 10_000)
            + sum(len(t) + t.count("<s>") + len(formatted(r, "")) for _, r, t in turns if len(t) >= 10_000),
        )
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA)


def test_conversations(spark):
    pieces = chat.formatted_pieces(table(spark, odd_turns()))
    got = {r.conv_id: tuple(r)[1:] for r in chat.conversation_digests(pieces).collect()}
    assert got == digests(odd_turns())
    assert pieces.where(F.length("formatted") != F.col("n_chars")).count() == 0


def test_pieces_are_bounded_and_in_order(spark):
    rows = table(spark, odd_turns()).where("conv_id = 4").repartition(3)
    pieces = chat.format_conversations(rows, piece_bytes=400).orderBy("part", "piece").collect()
    assert len(pieces) > 30 and all(p.n_turns == 1 or len(p.formatted) < 4000 for p in pieces)
    turns = [t for p in pieces for t in chat.read_turns(p.formatted)]
    assert turns == [(role, text) for conv, _, role, text in odd_turns() if conv == 4]


def test_empty_table(spark):
    assert chat.conversation_digests(chat.formatted_pieces(table(spark, []))).count() == 0


def test_formatted_text_has_no_loose_control_string(spark):
    pieces = chat.format_conversations(table(spark, odd_turns()[:10])).collect()
    for piece in pieces:
        for control in ("<s>", "</s>"):
            assert len(re.findall(re.escape(control), piece.formatted)) <= piece.n_turns

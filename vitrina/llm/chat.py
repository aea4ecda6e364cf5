"""Formatting conversations for training, by columnar byte assembly.

A template puts a header before and a footer after each turn. Control strings inside texts and
role names are broken by a backslash after their first character, and backslashes are doubled,
so the formatted text holds a control string only where the template puts one, and the original
comes back exactly.

A batch of turns is one run of bytes. The bytes that need a backslash are found in it, segment
lengths give cumulative offsets, and these give for every byte its place in one preallocated
buffer, into which headers, contents, backslashes and footers are copied by index. The buffer
is the Arrow column.

Turns are dealt by ranges of (conversation, turn), so a conversation may span tasks, and leave
in pieces of whole turns. A conversation's text is its pieces in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import utf8
from vitrina.session import written_table

BREAK = ord("\\")


@dataclass(frozen=True)
class Template:
    """Header and footer of the turns of each role.

    Those of other roles hold `{role}` once in the header. Headers end and footers start with
    white space, which no control string holds, so none can arise where texts meet them.
    """

    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<s><<SYS>>\n", "\n<</SYS>></s>\n"),
            "user": ("<s>[INST] ", " [/INST]"),
            "assistant": ("[ANSWER] ", " </s>\n"),
        }
    )
    other: tuple[str, str] = ("<s>[ROLE] {role} [/ROLE]\n", "\n</s>\n")
    controls: tuple[str, ...] = (
        "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[ANSWER]",
    )
    #: Texts of this role are what a model learns to write.
    learned: str = "assistant"

    def __post_init__(self):
        for text in self.controls:
            if len(text) < 2 or re.search(r"\s|\\", text):
                raise ValueError(f"a control string has two characters or more and no white space: {text!r}")
        for header, footer in [*self.roles.values(), self.other]:
            if not (header[-1:].isspace() and footer[:1].isspace()):
                raise ValueError("headers end and footers start with white space")


TEMPLATE = Template()


# --- escaping ------------------------------------------------------------------------------


def _break_places(data: np.ndarray, starts: np.ndarray, template: Template) -> np.ndarray:
    """Sorted places before which a backslash goes: backslashes, and second characters of control strings."""
    found = [np.flatnonzero(data == BREAK)]
    spelled = [(text.encode(), len(text[0].encode())) for text in template.controls]
    for first in {own[0] for own, _ in spelled}:
        at = np.flatnonzero(data == first)
        end = starts[np.searchsorted(starts, at, "right")] if len(at) else at
        for own, lead in spelled:
            if own[0] != first:
                continue
            here = at[at + len(own) <= end]
            for offset, byte in enumerate(own[1:], 1):
                here = here[data[here + offset] == byte]
            found.append(here + lead)
    return np.unique(np.concatenate(found))


def unescaped(text: str) -> str:
    """The original of an escaped text."""
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def _spread(out: np.ndarray, data: np.ndarray, starts: np.ndarray, breaks: np.ndarray, begins: np.ndarray) -> None:
    """Copies the rows of `data` to `begins` in `out`, with a backslash before each of `breaks`."""
    moved = np.repeat(begins - starts[:-1], np.diff(starts))
    shift = np.zeros(len(data) + 1, np.int64)
    shift[breaks] = 1
    before = np.cumsum(shift[:-1])
    # backslashes of earlier rows are already in `begins`
    rows = np.repeat(np.concatenate(([0], before))[starts[:-1]], np.diff(starts))
    place = np.arange(len(data)) + moved + before - rows
    out[place] = data
    out[place[breaks] - 1] = BREAK


def _characters(data: np.ndarray) -> np.ndarray:
    """Code points before every byte place of UTF-8 text, and in all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


@dataclass
class Turns:
    """Formatted turns: bytes, first byte of each turn, span of its text, and whether it is learned."""

    data: np.ndarray
    starts: np.ndarray
    text_first: np.ndarray
    text_end: np.ndarray
    learned: np.ndarray


def format_turns(roles: pa.Array, texts: pa.Array, template: Template = TEMPLATE) -> Turns:
    """All turns of a batch, assembled in one buffer. Null roles and texts count as empty."""
    data, offsets = utf8(texts)
    data, starts = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    codes = roles.fill_null("").dictionary_encode()
    names = codes.dictionary.to_pylist()
    heads, feet = [], []
    for name in names:
        head, foot = template.roles.get(name, template.other)
        if name not in template.roles:
            plain = np.frombuffer(name.encode(), np.uint8)
            breaks = _break_places(plain, np.array([0, len(plain)]), template)
            safe = np.zeros(len(plain) + len(breaks), np.uint8)
            _spread(safe, plain, np.array([0, len(plain)]), breaks, np.zeros(1, np.int64))
            head = head.replace("{role}", safe.tobytes().decode())
        heads.append(np.frombuffer(head.encode(), np.uint8))
        feet.append(np.frombuffer(foot.encode(), np.uint8))
    kind = codes.indices.to_numpy(zero_copy_only=False)
    breaks = _break_places(data, starts, template)
    extra = np.diff(np.searchsorted(breaks, starts))
    head_length = np.array([len(h) for h in heads], np.int64)[kind]
    foot_length = np.array([len(f) for f in feet], np.int64)[kind]
    inner = np.diff(starts) + extra
    ends = np.cumsum(head_length + inner + foot_length)
    begins = np.concatenate(([0], ends))
    first = begins[:-1] + head_length
    out = np.empty(int(begins[-1]), np.uint8)
    _spread(out, data, starts, breaks, first)
    for code in range(len(names)):
        rows = np.flatnonzero(kind == code)
        for place, part in ((begins[rows], heads[code]), (first[rows] + inner[rows], feet[code])):
            out[place[:, None] + np.arange(len(part))] = part
    learned = np.array([name == template.learned for name in names], bool)[kind]
    return Turns(out, begins, first, first + inner, learned)


# --- pieces --------------------------------------------------------------------------------

PIECE_BYTES = 1 << 20
#: Turns of equal number are ordered by role, so many characters, and a hash of the text. Equal
#: rows, whose order is of no matter, are told apart by one of so many numbers, so that ranges
#: can cut also where one row is repeated without end.
TIE_CHARS = 64
REPEATS = 64
PIECES = (
    "conv_id long, part long, piece long, n_turns long, formatted string, n_chars long, "
    "loss_spans array<struct<first:long,length:long>>"
)


def _pieces(template: Template, piece_bytes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            made_before, made = made, made + batch.num_rows
            yield from _formatted(batch, template, piece_bytes, made_before)

    return rows


def _formatted(
    batch: pa.RecordBatch, template: Template, piece_bytes: int, numbered_from: int
) -> Iterator[pa.RecordBatch]:
    """One piece for each stretch of turns of one conversation, of a bounded number of bytes."""
    names = batch["conv_id"]
    unknown = names.is_null().to_numpy(zero_copy_only=False)
    ids = names.fill_null(0).to_numpy()
    _, offsets = utf8(batch["text"])
    row = 0
    while row < batch.num_rows:
        # rows whose texts make up about one piece are assembled at once
        end = int(np.searchsorted(offsets, offsets[row] + piece_bytes, "right")) - 1
        end = min(max(end, row + 1), batch.num_rows)
        turns = format_turns(batch["role"].slice(row, end - row), batch["text"].slice(row, end - row), template)
        own, lost = ids[row:end], unknown[row:end]
        cuts = np.flatnonzero((own[1:] != own[:-1]) | (lost[1:] != lost[:-1])) + 1
        edges = np.concatenate(([0], cuts, [end - row])).astype(np.int64)
        places = turns.starts[edges]
        chars = _characters(turns.data)
        spans = np.flatnonzero(turns.learned)
        piece = np.searchsorted(edges, spans, "right") - 1
        first = chars[turns.text_first[spans]] - chars[places[piece]]
        length = chars[turns.text_end[spans]] - chars[turns.text_first[spans]]
        span_rows = pa.StructArray.from_arrays([pa.array(first), pa.array(length)], ["first", "length"])
        formatted = pa.LargeStringArray.from_buffers(
            len(edges) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(turns.data)
        )
        n = len(edges) - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own[edges[:-1]], pa.int64(), mask=lost[edges[:-1]]),
                pa.array(batch["part"].to_numpy()[row + edges[:-1]], pa.int64()),
                pa.array(numbered_from + row + edges[:-1], pa.int64()),
                pa.array(np.diff(edges), pa.int64()),
                formatted.cast(pa.string()),
                pa.array(np.diff(chars[places]), pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(piece, np.arange(n + 1)).astype(np.int32)), span_rows
                ),
            ],
            [name.split()[0] for name in PIECES.split(", ")[:6]] + ["loss_spans"],
        )
        row = end


def format_conversations(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Template = TEMPLATE,
    piece_bytes: int = PIECE_BYTES,
) -> DataFrame:
    """conv_id, part, piece, n_turns, formatted, n_chars, loss_spans.

    The pieces of a conversation in order of (part, piece) make its formatted text. `n_chars`
    counts code points; `loss_spans` are the code points of a piece that hold texts of the
    template's learned role, still escaped.

    Turns are ordered by number, nulls last, equal numbers by role, then by the start of the text,
    then by a hash of it. A null text or role
    counts as empty; a null conversation is one of its own. Texts are read whole, and a text may
    be as long as a row can hold. Roles that the template does not know are named in the header.
    Repeated rows are turns of their own. Other columns are not read. An empty table gives no rows.
    """
    named = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.pmod(F.monotonically_increasing_id(), F.lit(REPEATS)).alias("_repeat"),
    )
    order = [
        F.col("conv_id").asc_nulls_first(),
        F.col("turn").asc_nulls_last(),
        F.col("role"),
        F.substring("text", 1, TIE_CHARS),
        F.xxhash64("text"),
        F.col("_repeat"),
    ]
    dealt = named.repartitionByRange(*order).withColumn("part", F.spark_partition_id().cast("long"))
    ordered = dealt.sortWithinPartitions(*order)
    return ordered.select("conv_id", "part", "role", "text").mapInArrow(_pieces(template, piece_bytes), PIECES)


# --- reading back --------------------------------------------------------------------------


def _turn_pattern(template: Template) -> tuple[re.Pattern, list[str | None]]:
    """One alternative for every role: header, anything without a control string, footer."""
    parts, names = [], []
    for name, (head, foot) in template.roles.items():
        parts.append(f"{re.escape(head)}(.*?){re.escape(foot)}")
        names.append(name)
    before, after = template.other[0].split("{role}")
    parts.append(f"{re.escape(before)}(.*?){re.escape(after)}(.*?){re.escape(template.other[1])}")
    return re.compile("|".join(parts), re.DOTALL), names


def read_turns(formatted: str, template: Template = TEMPLATE) -> Iterator[tuple[str, str]]:
    """The roles and texts of a formatted piece."""
    pattern, names = _turn_pattern(template)
    at = 0
    while at < len(formatted):
        match = pattern.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn of the template at {at}: {formatted[at : at + 40]!r}")
        if match.lastindex <= len(names):
            yield names[match.lastindex - 1], unescaped(match.group(match.lastindex))
        else:
            yield unescaped(match.group(len(names) + 1)), unescaped(match.group(len(names) + 2))
        at = match.end()


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digests(template: Template):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        done: list[tuple] = []

        def closed():
            return (name[0], held[0], held[1].hexdigest(), held[2], held[3].hexdigest(), held[4])

        def sent():
            columns = zip(*done, strict=True)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)],
                [part.split()[0] for part in DIGESTS.split(", ")],
            )

        for batch in batches:
            for conv, formatted, spans in zip(
                batch["conv_id"].to_pylist(), batch["formatted"].to_pylist(), batch["loss_spans"].to_pylist(), strict=True
            ):
                if held is None or (conv,) != name:
                    if held is not None:
                        done.append(closed())
                    name, held = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(formatted, template):
                    held[0] += 1
                    held[1].update(f"{role}\n{text}\n".encode())
                for span in spans:
                    learned = unescaped(formatted[span["first"] : span["first"] + span["length"]])
                    held[2] += len(learned)
                    held[3].update(learned.encode())
                held[4] += len(formatted)
            if done:
                yield sent()
                done.clear()
        if held is not None:
            done.append(closed())
            yield sent()

    return rows


def conversation_digests(pieces: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation, read back from its formatted pieces.

    n_turns; turns_sha256 of role, newline, text, newline of every turn; loss_chars and
    loss_sha256 of all text under the loss spans, unescaped; formatted_chars. A digest can only
    be taken in order, so a conversation's pieces stream through one task, which holds one
    piece and the state of two digests.
    """
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return dealt.select("conv_id", "formatted", "loss_spans").mapInArrow(_digests(template), DIGESTS)


def with_conversation(turns: DataFrame, conv_id: int, said: list[tuple[str, str]]) -> DataFrame:
    """`turns` and one more conversation."""
    rows = [(conv_id, number, role, text) for number, (role, text) in enumerate(said)]
    more = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(more)


def formatted_pieces(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """`format_conversations`, written to the shared folder."""
    return written_table(format_conversations(turns, template=template), "formatted")


def oracle(template: Template = TEMPLATE) -> str:
    """DuckDB SQL of the digests, by string functions and ordered aggregates."""

    def escaped(column: str) -> str:
        held = [f"length({column}) + length({column}) - length(replace({column}, '\\', ''))"]
        held += [f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in template.controls]
        return " + ".join(held)

    around = "".join(f" WHEN '{name}' THEN {len(head + foot)}" for name, (head, foot) in template.roles.items())
    rest = len("".join(template.other)) - len("{role}")
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, {escaped("text")} + CASE role{around} ELSE {rest} + {escaped("role")} END AS formatted FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{template.learned}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{template.learned}'), '')) AS loss_sha256,
       CAST(sum(formatted) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

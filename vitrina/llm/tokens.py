"""Token counts by a compiled finite-state tokenizer.

The encoder of a byte-level BPE vocabulary is compiled into a deterministic transducer: its states are
the prefixes of pre-tokens, and a transition on a byte is annotated with the tokens that it
adds to (or takes from) the count. A state knows the last token of its prefix's encoding,
which is the one vocabulary suffix whose pair with the last token before it BPE leaves alone;
so a transition is compiled from earlier states without running the merges. States are made
when a text first needs them and dropped together when there are too many.

A text is cut into chunks. A chunk's state map says what it does from any state of the chunk
before: the bytes up to its first certain boundary finish the open run, the runs between boundaries have a count,
the rest is left open. Maps compose associatively, so the chunks of a text are combined by a
prefix scan in a logarithmic number of rounds.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vitrina.llm.common import utf8

#: Fixed value: the pattern that byte-level tokenizers split by before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pre-token always begins at a space that a non-space follows.
ODD_SPACE = re.compile(r" (?!\S)")
BOUNDARY = re.compile(r" (?=\S)")
CHUNK = 1 << 16
STATES = 1 << 19
REMEMBERED = 1 << 19
KEPT_PREFIX = 64
TOKEN_LIMIT = 1024


def runs(text: str) -> list[str]:
    """The text cut before each space that a non-space follows; those spaces are left out."""
    return BOUNDARY.split(text) if ODD_SPACE.search(text) else text.split(" ")


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens, merge ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, before = held["model"], held.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or held.get("normalizer"):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        letters = byte_letters()
        spelled = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        self.ids = {spelled(t): i for t, i in model["vocab"].items() if t not in self.special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(spelled(a), spelled(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.ids))
        self.in_rank_order = all(
            self.ids.get(a + b) == 256 + i for i, (a, b) in enumerate(self.ranks)
        )
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[bytes]:
        """BPE by its definition: the leftmost pair of least rank is merged until none is left."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.ranks.get(pair), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False))]
            best = min(((r, i) for r, i in ranked if r is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts


class CountTransducer:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PRE_TOKENS)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.remembered: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.step: dict[int, int] = {}
        self.parent, self.total, self.last, self.prefix = [0], [0], [b""], [b""]

    def stays(self, before: bytes, token: bytes) -> bool:
        """BPE encodes before + token as these two tokens."""
        found = self.pairs.get((before, token))
        if found is None:
            whole = before + token
            found = self.vocabulary.merge(whole) == ([before, token] if before else [token])
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            self.pairs[before, token] = found
        return found

    def transition(self, state: int, byte: int) -> int:
        """The state after `byte`, compiled if it is new."""
        key = state << 8 | byte
        made = self.step.get(key)
        if made is None:
            prefix = self.prefix[state] + bytes((byte,))
            ids, ahead = self.vocabulary.ids, state
            for length in range(1, min(len(prefix), self.vocabulary.longest) + 1):
                token = prefix[-length:]
                if token in ids and self.stays(self.last[ahead], token):
                    break
                ahead = self.parent[ahead]
            made = len(self.total)
            self.step[key] = made
            self.parent.append(state)
            self.prefix.append(prefix)
            self.last.append(token)
            self.total.append(self.total[ahead] + 1)
        return made

    def emitted(self, state: int, byte: int) -> int:
        """The annotation of a transition."""
        return self.total[self.transition(state, byte)] - self.total[state]

    def count_bytes(self, word: bytes) -> int:
        if len(word) > KEPT_PREFIX:
            return self._count_long(word)
        if len(self.total) > STATES:
            self.clear()
        state, step = 0, self.step
        for byte in word:
            following = step.get(state << 8 | byte)
            state = self.transition(state, byte) if following is None else following
        return self.total[state]

    def _count_long(self, word: bytes) -> int:
        """The same states along one word, not kept."""
        ids, longest = self.vocabulary.ids, self.vocabulary.longest
        total, last = [0], [b""]
        for end in range(1, len(word) + 1):
            for length in range(1, min(end, longest) + 1):
                token = word[end - length : end]
                if token in ids and self.stays(last[end - length], token):
                    break
            total.append(total[end - length] + 1)
            last.append(token)
        return total[-1]

    def count_run(self, run: str) -> int:
        """Tokens of a run that begins a text or has its space."""
        found = self.remembered.get(run)
        if found is None:
            found = sum(self.count_bytes(p.encode()) for p in self.pattern.findall(run))
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            if len(run) <= KEPT_PREFIX:
                self.remembered[run] = found
        return found

    def count_plain(self, text: str) -> int:
        """Tokens of a text without special strings that begins at a boundary."""
        if not text:
            return 0
        first, *rest = runs(text)
        known, total = self.remembered, self.count_run(first) if first else 0
        for run in rest:
            found = known.get(" " + run)
            total += self.count_run(" " + run) if found is None else found
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """Bytes that finish the run before, count of the runs inside, open rest; no boundary: None."""
        first = BOUNDARY.search(chunk)
        if first is None:
            return chunk, None, ""
        last = first.start()
        for last_match in BOUNDARY.finditer(chunk, max(first.start(), len(chunk) - 4096)):
            last = last_match.start()
        return chunk[: first.start()], self.count_plain(chunk[first.start() : last]), chunk[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.count_plain(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """The composition of all maps, in pairwise rounds."""
        while len(maps) > 1:
            paired = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)]
            maps = paired + maps[len(maps) - len(maps) % 2 :]
        return maps[0]

    def count(self, text: str) -> int:
        """Tokens of a whole text; special strings in it are one token each."""
        found = self.vocabulary.specials
        total, segments = 0, [text]
        if found is not None and found.search(text):
            total, segments = len(found.findall(text)), found.split(text)
        for segment in segments:
            if len(segment) <= CHUNK:
                total += self.count_plain(segment)
                continue
            chunks = [segment[i : i + CHUNK] for i in range(0, len(segment), CHUNK)]
            head, inner, tail = self.scan([self.chunk_map(c) for c in chunks])
            total += self.count_plain(head) + (inner or 0) + self.count_plain(tail)
        return total


_transducers: dict[str, CountTransducer] = {}


def transducer(path: str) -> CountTransducer:
    """The transducer of this process for a vocabulary file."""
    if path not in _transducers:
        _transducers[path] = CountTransducer(Vocabulary(path))
    return _transducers[path]


def token_counts(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row per row of `docs`.

    `vocabulary` is the path of a byte-level BPE .json file on every machine. A null text is
    empty and has no tokens. Texts are read whole. Repeated rows are counted again, ids play
    no part. An empty table gives no rows. Other columns are not read.
    """
    from pyspark.sql import functions as F

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(vocabulary)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            counts = [machine.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = own.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

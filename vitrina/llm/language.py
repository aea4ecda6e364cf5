"""Language identification in two steps: the family, then the languages of that family.

Features are the shares of hashed byte n-grams of a whole text, ASCII letters in lower case. A
linear support vector machine for each family decides against all others (two families share one); within a
family one machine per pair of languages votes. Every decision is linear in the shares, so a text's
margin is the mean weight of its n-grams, and scoring needs no vector per document.

Machines only tell languages apart. Whether a text is in a learned language at all is decided by
the share of its n-grams that hold a letter and that the language's texts commonly have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import LOWER, blocks, row_sums
from vitrina.session import written_table

#: Languages of a family; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
}
UNDETERMINED = "und"
ORDERS = (2, 3, 4)
SLOT_BITS = 16
#: Labelled texts that the machines are fitted on: about so many per language, and in all.
TEXTS_PER_LANGUAGE = 500
TEXTS = 8_000
EPOCHS = 12
PENALTY = 1e-4
HAS_LETTER = r"\p{L}"
#: Texts are read in blocks of about so many bytes; an n-gram takes some 60 bytes while it is counted.
TEXT_BLOCK = 1 << 19
#: Orders of the n-grams whose share decides whether a text is in a language.
KNOWN_ORDERS = (3, 4)
#: A language knows the n-grams that this share of its texts hold, and two texts at least.
COMMON = 0.01
#: Texts are rejected below this part of the median share of the language's own texts.
FLOOR = 0.4
IS_LETTER = np.arange(256) >= 128
IS_LETTER[65:91] = IS_LETTER[97:123] = True


def spaced(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block with spaces behind each, and the place of every byte among them.

    No n-gram looks into the next row, so a text has the same n-grams in any block.
    """
    gap = max(ORDERS) - 1
    place = np.arange(len(data)) + gap * np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    out = np.full(len(data) + gap * (len(starts) - 1), 32, np.uint8)
    out[place] = data
    return out, place


def gram_slots(padded: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Slot of the n-gram that starts at each byte."""
    lowered = LOWER[padded].astype(np.uint64)
    key = np.full(len(place), order, np.uint64)
    for i in range(order):
        key = key << np.uint64(8) | lowered[place + i]
    slots = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)
    return slots.astype(np.int64)


def all_slots(padded: np.ndarray, place: np.ndarray) -> Iterator[np.ndarray]:
    for number, order in enumerate(ORDERS):
        yield gram_slots(padded, place, order) + (number << SLOT_BITS)


def lettered(padded: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
    """Whether the n-gram that starts at each byte holds a letter."""
    held = IS_LETTER[padded]
    return np.logical_or.reduce([held[place + i] for i in range(order)])


@dataclass
class LanguageModel:
    """Weights by slot and machine, with a slope and shift per machine that make margins odds.

    `known` marks the slots that each of `languages` knows, `floors` the share that its texts need.
    """

    families: list[list[str]]
    machines: list[tuple]  # ("family", number, None) or ("pair", language, language)
    weights: np.ndarray
    slopes: np.ndarray
    shifts: np.ndarray
    languages: list[str]
    known: np.ndarray
    floors: np.ndarray

    def odds(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slopes * margins + self.shifts, -30, 30)))

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins."""
        odds = self.odds(margins)
        count = len(self.families)
        family = np.ones((len(margins), count))
        if count == 2:
            family[:, 0], family[:, 1] = odds[:, 0], 1 - odds[:, 0]
        elif count > 2:
            family = odds[:, :count] / np.maximum(odds[:, :count].sum(1, keepdims=True), 1e-12)
        chosen = family.argmax(1)
        sure = family[np.arange(len(margins)), chosen]
        out = np.empty(len(margins), object)
        for number, languages in enumerate(self.families):
            rows = np.flatnonzero(chosen == number)
            votes = np.full((len(rows), len(languages)), 1.0 if len(languages) == 1 else 0.0)
            for at, (kind, a, b) in enumerate(self.machines):
                if kind == "pair" and a in languages:
                    for_a = odds[rows, at]
                    votes[:, languages.index(a)] += for_a
                    votes[:, languages.index(b)] += 1 - for_a
            share = votes / votes.sum(1, keepdims=True)
            best = share.argmax(1)
            out[rows] = np.array(languages, object)[best]
            top = share.max(1) if len(languages) < 3 else np.minimum(1.0, share.max(1) * len(languages) / 2)
            sure[rows] *= top
        return list(out), sure


def recognised(model: LanguageModel, names: Sequence[str], data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each row is in a learned language.

    Some language must know enough of its n-grams; one without a floor counts for the rows it
    was given by `names`.
    """
    size = np.maximum(np.diff(starts), 1) * len(KNOWN_ORDERS)
    share = np.zeros((len(model.languages), len(starts) - 1))
    padded, place = spaced(data, starts)
    for order in KNOWN_ORDERS:
        slots = gram_slots(padded, place, order) + (ORDERS.index(order) << SLOT_BITS)
        held = lettered(padded, place, order)
        for number in range(len(model.languages)):
            share[number] += row_sums(model.known[number][slots] & held, starts) / size
    given = np.array(model.languages, object)[:, None] == np.array(names, object)[None, :]
    return ((share >= model.floors[:, None]) & (given | (model.floors > 0)[:, None])).any(0)


def margins(model: LanguageModel, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    size = np.maximum(np.diff(starts), 1)
    out = np.zeros((len(starts) - 1, len(model.machines)))
    for slots in all_slots(*spaced(data, starts)):
        for machine in range(len(model.machines)):
            out[:, machine] += row_sums(model.weights[machine][slots], starts) / size
    return out / len(ORDERS)


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, slots, shares, own, own_shares: the n-gram shares of each text; a text has at most the
    table's slots. The last two are those of KNOWN_ORDERS with a letter, among all of these orders."""
    for batch in batches:
        for first, end, data, starts in blocks(batch.column(1), TEXT_BLOCK):
            padded, place = spaced(data, starts)
            slots = list(all_slots(padded, place))
            orders = [ORDERS.index(order) for order in KNOWN_ORDERS]
            held = [lettered(padded, place, order) for order in KNOWN_ORDERS]
            out_slots, out_shares, out_own, out_own_shares = [], [], [], []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                found, count = np.unique(np.concatenate([s[a:b] for s in slots]), return_counts=True)
                out_slots.append(found.astype(np.int32).tobytes())
                out_shares.append((count / max(1, count.sum())).astype(np.float32).tobytes())
                own = [slots[at][a:b][h[a:b]] for at, h in zip(orders, held, strict=True)]
                found, count = np.unique(np.concatenate(own), return_counts=True)
                out_own.append(found.astype(np.int32).tobytes())
                out_own_shares.append((count / max(1, (b - a) * len(orders))).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, end - first),
                    *(pa.array(c, pa.binary()) for c in (out_slots, out_shares, out_own, out_own_shares)),
                ],
                ["lang", "slots", "shares", "own", "own_shares"],
            )


def fit_machine(rows: Sequence[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """Averaged Pegasos on unit vectors with equal weight to both sides, then a slope and shift for odds."""
    rng = np.random.default_rng(11)
    weights, total, steps, scale = np.zeros(size), np.zeros(size), 0, 1.0
    sides = [np.flatnonzero(signs > 0), np.flatnonzero(signs < 0)]
    unit = [v / np.linalg.norm(v) for _, v in rows]
    for epoch in range(EPOCHS):
        draws = np.concatenate([rng.choice(side, max(map(len, sides))) for side in sides])
        for i in rng.permutation(draws):
            steps += 1
            rate = 1 / (PENALTY * (steps + 1 / PENALTY))
            scale *= 1 - rate * PENALTY
            slots = rows[i][0]
            if signs[i] * scale * (weights[slots] @ unit[i]) < 1:
                weights[slots] += rate * signs[i] * unit[i] / scale
        total += weights * scale
    weights = total / EPOCHS
    found = np.array([weights[s] @ v for s, v in rows])
    return (weights, *_odds_line(found, signs))


def _odds_line(found: np.ndarray, signs: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, with softened labels."""
    positive, negative = max(1, (signs > 0).sum()), max(1, (signs < 0).sum())
    want = np.where(signs > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    weight = np.where(signs > 0, 1 / positive, 1 / negative)
    spread = found.std() or 1.0
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * found / spread + b, -30, 30)))
        error, curve = weight * (want - p), weight * p * (1 - p)
        x = found / spread
        h = np.array([[(curve * x * x).sum() + 1e-3, (curve * x).sum()], [(curve * x).sum(), curve.sum() + 1e-3]])
        step = np.linalg.solve(h, np.array([(error * x).sum(), error.sum()]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3) / spread, b


def fit_known(texts: Sequence[tuple[np.ndarray, np.ndarray]], size: int) -> tuple[np.ndarray, float]:
    """Slots that a language knows, and the floor of the shares; each text is measured by the others.

    The fewer the texts, the less their median tells, so the floor is lowered by one over the root
    of their number, to 0 at the least.
    """
    held = np.zeros(size, np.int64)
    for slots, _ in texts:
        held[slots] += 1
    least = max(2, math.ceil(COMMON * len(texts)))
    median = float(np.median([shares[held[slots] > least].sum() for slots, shares in texts]))
    return held >= least, max(0.0, FLOOR * median - len(texts) ** -0.5)


def members_of_families(languages: Sequence[str], families=FAMILIES) -> list[list[str]]:
    """The learned languages by family; a language that is in none is a family of its own."""
    family_of = {lang: name for name, members in families.items() for lang in members}
    grouped: dict[str, list[str]] = {}
    for lang in sorted(languages):
        grouped.setdefault(family_of.get(lang, f"own {lang}"), []).append(lang)
    return [grouped[name] for name in sorted(grouped)]


def machines_of(members: list[list[str]]) -> list[tuple]:
    """One machine per family (one for two families), then one per pair of languages of a family."""
    count = len(members) if len(members) > 2 else len(members) - 1
    pairs = [("pair", a, b) for group in members for a, b in combinations(group, 2)]
    return [("family", number, None) for number in range(count)] + pairs


def _sides(machines: list[tuple], members: list[list[str]], lang: str) -> list[tuple[int, int]]:
    """The machines that learn from a text of `lang`, and the side it is on."""
    own = next(number for number, group in enumerate(members) if lang in group)
    out = []
    for place, (kind, a, b) in enumerate(machines):
        if kind == "family":
            out.append((place, 1 if own == a else -1))
        elif lang in (a, b):
            out.append((place, 1 if lang == a else -1))
    return out


#: Number of a task that fits: a machine's place, or what a language knows after all machines.
FITTED = "job int, weights binary, slope double, shift double"


def _fit_job(machines: int):
    """Fits the machine or the known slots of one group of sample rows, which is bounded by the draw."""
    size = len(ORDERS) << SLOT_BITS

    def fitted(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("lang", "slots", "shares", "side")), strict=True))
        job = table["job"][0].as_py()
        held = [(np.frombuffer(slots, np.int32), np.frombuffer(shares, np.float32)) for _, slots, shares, _ in rows]
        if job < machines:
            weights, slope, shift = fit_machine(held, np.array([side for *_, side in rows]), size)
            found = weights.astype(np.float32).tobytes()
        else:
            known, slope = fit_known(held, size)
            found, shift = np.packbits(known).tobytes(), 0.0
        columns = [pa.array([job], pa.int32()), pa.array([found], pa.binary()), pa.array([slope], pa.float64())]
        # the worker lives on for other tasks
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([*columns, pa.array([shift], pa.float64())], ["job", "weights", "slope", "shift"])

    return fitted


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
    per_language: int = TEXTS_PER_LANGUAGE, most_texts: int = TEXTS, families=FAMILIES,
) -> LanguageModel | None:
    """A model of the labelled rows of `docs`: about `per_language` of each language and about
    `most_texts` in all, drawn by a hash; None without labelled rows that have a letter.

    Null languages and texts without a letter are left out. Each drawn text is read whole. The
    drawn texts' shares are written, and every machine is fitted in a task of its own; the driver
    is sent the counts by language and the fitted weights only.
    """
    own = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).cast("string").alias("key"))
    labelled = own.where(F.col("lang").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = min(per_language, most_texts / max(1, len(counts)))
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, wanted / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("key"), F.lit(1_000_000)) / 1e6
    drawn = labelled.where((draw < share) & F.col("text").rlike(HAS_LETTER)).select("lang", "text")
    schema = "lang string, slots binary, shares binary, own binary, own_shares binary"
    sample = written_table(drawn.mapInArrow(_shares, schema), "language_sample")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    members = members_of_families(languages, families)
    machines = machines_of(members)
    def part(job: int, side: int, slots: str, shares: str) -> Column:
        return F.struct(
            F.lit(job).alias("job"), F.lit(side).alias("side"), F.col(slots).alias("slots"), F.col(shares).alias("shares")
        )

    jobs = F.array().cast("array<struct<job:int,side:int,slots:binary,shares:binary>>")
    for number, name in enumerate(languages):
        held = [part(place, side, "slots", "shares") for place, side in _sides(machines, members, name)]
        held.append(part(len(machines) + number, 1, "own", "own_shares"))
        jobs = F.when(F.col("lang") == name, F.array(*held)).otherwise(jobs)
    dealt = sample.select("lang", F.inline(jobs))
    fitted = dealt.groupBy("job").applyInArrow(_fit_job(len(machines)), FITTED).collect()
    by_job = {r.job: r for r in fitted}
    size = len(ORDERS) << SLOT_BITS
    first = [by_job[j] for j in range(len(machines))]
    last = [by_job[len(machines) + number] for number in range(len(languages))]
    return LanguageModel(
        members,
        machines,
        np.array([np.frombuffer(r.weights, np.float32) for r in first], np.float32).reshape(len(machines), size),
        np.array([r.slope for r in first]),
        np.array([r.shift for r in first]),
        languages,
        np.array([np.unpackbits(np.frombuffer(r.weights, np.uint8)).astype(bool) for r in last]),
        np.array([r.slope for r in last]),
    )


def identify(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score; one row per row of `docs`.

    A null text, a text without a letter, and every text when nothing was learned have the
    language `und` and score 0. Texts are read whole and equal texts have equal results. Only
    the text is read. An empty table gives no rows.
    """
    own = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.col(text).rlike(HAS_LETTER), F.lit(False)).alias("lettered"),
    )
    kind = own.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for first, end, data, starts in blocks(batch.column(1), TEXT_BLOCK):
                names, scores = [UNDETERMINED] * (end - first), np.zeros(end - first)
                if held is not None:
                    names, scores = held.decide(margins(held, data, starts))
                lettered = batch.column(2).slice(first, end - first).to_pylist()
                names = [n if ok else UNDETERMINED for n, ok in zip(names, lettered, strict=True)]
                scores = np.where(lettered, scores, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(names, pa.string()), pa.array(scores)],
                    ["doc_id", "lang_pred", "score"],
                )

    return own.mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, model: LanguageModel | None, text: str = "text", least_score: float = 0.0
) -> DataFrame:
    """The rows of `docs` whose text is in a learned language, with a score of at least `least_score`.

    Null texts, texts without a letter and texts that the model does not recognise are rejected.
    When nothing was learned (no row has a language) nothing can be told of texts with a letter,
    and they stay. Rows keep all their columns, whatever their names.
    """
    place = docs.columns.index(text)
    spoken = docs.where(F.coalesce(F.col(text).rlike(HAS_LETTER), F.lit(False)))
    if model is None:
        return spoken
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for first, end, data, starts in blocks(batch.column(place), TEXT_BLOCK):
                names, scores = held.decide(margins(held, data, starts))
                stays = recognised(held, names, data, starts) & (scores >= least_score)
                yield batch.slice(first, end - first).filter(pa.array(stays))

    return spoken.mapInArrow(rows, docs.schema)

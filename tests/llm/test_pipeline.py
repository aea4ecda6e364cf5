"""Every stage of the pipeline against a plain version, row by row."""

import hashlib
import itertools
import re
import subprocess
import sys
import textwrap
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vitrina.llm import common, language, packing, queries

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (9001, None, None, None, None),
    (9002, "", "en", "a", 0),
    (9003, " \n\t", "en", "a", 3),
    (9004, "la casa de la piedra " * 3000, "es", "b", 1),
    (9005, "la  casa\tde la piedra " * 3000, "es", "b", 1),
    (9006, "12 34 !! 56", None, "b", 1),
    (9007, "the same words of a short text here", "en", "a", 1),
    (9008, "the same words of a short text here", "en", "c", 1),
    (9008, "the same words of a short text here", "en", "c", 1),
    (9009, "Ñandú 日本語 <|endoftext|> x", None, None, 1),
    (None, "a text that has no id at all", None, "d", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    return common.read_documents(spark, SMALL).select(*odd.columns).unionByName(odd).cache()


@pytest.fixture(scope="module")
def stages():
    return dict(corpus_pipeline.STAGES)


def rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


def known_share(model, text):
    """Share of a text's n-grams with a letter that each language knows, one n-gram at a time."""
    raw = bytes(language.LOWER[np.frombuffer(text.encode(), np.uint8)])
    found = np.zeros(len(model.languages))
    for order in language.KNOWN_ORDERS:
        for at in range(len(raw)):
            gram = raw[at : at + order].ljust(order)
            key = order
            for byte in gram:
                key = (key << 8 | byte) % (1 << 64)
            slot = (key * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - language.SLOT_BITS)
            if any(language.IS_LETTER[b] for b in gram):
                found += model.known[:, slot + (language.ORDERS.index(order) << language.SLOT_BITS)]
    return found / (len(raw) * len(language.KNOWN_ORDERS))


def test_language_id(spark, docs, stages):
    model = language.train(docs)
    few = docs.where("length(text) < 4000 OR text IS NULL")
    given = {r.text: r for r in few.collect()}
    names = {}
    spoken = [t for t in given if t and re.search(r"[^\W\d_]", t)]
    texts = [np.frombuffer(t.encode(), np.uint8) for t in spoken]
    for text, data in zip(spoken, texts, strict=True):
        names[text] = model.decide(language.margins(model, data, np.array([0, len(data)])))[0][0]
    want = set()
    for text in spoken:
        share = known_share(model, text)
        own = np.array([name == names[text] for name in model.languages])
        if ((share >= model.floors) & (own | (model.floors > 0))).any():
            want.add(text)
    kept = language.keep_identified(few, model)
    assert {r.text for r in kept.collect()} == want
    assert rows(kept) == Counter({k: n for k, n in rows(few).items() if k[1] in want})
    assert rows(stages["language_id"](spark, docs, SMALL)) == rows(language.keep_identified(docs, model))


def test_a_text_is_identified_alike_in_any_block():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 105, n).astype(np.uint8) for n in (1, 2, 3, 7, 50, 0, 4)]
    data, starts = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = [np.split(s, starts[1:-1]) for s in language.all_slots(*language.spaced(data, starts))]
    for number, text in enumerate(texts):
        alone = list(language.all_slots(*language.spaced(text, np.array([0, len(text)]))))
        assert all((a == w[number]).all() for a, w in zip(alone, whole, strict=True))


def test_exact_dedup(spark, docs, stages):
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least: dict = {}
    for r in docs.collect():
        held = least.setdefault(plain(r.text), r.doc_id)
        if r.doc_id is not None and (held is None or r.doc_id < held):
            least[plain(r.text)] = r.doc_id
    want = Counter((least[text], text) for text in least)
    kept = stages["exact_dedup"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, plain(r.text)) for r in kept.collect()) == want
    assert not rows(kept) - rows(docs)


def test_near_dedup(spark, docs, stages):
    held: dict = {}
    for r in docs.collect():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        count = max(1, len(words) - 4) if words else 0
        held.setdefault(r.doc_id, set()).update(tuple(words[i : i + 5]) for i in range(count))
    root = {d: d for d in held}
    known = [d for d in held if held[d] and d is not None]
    for a, b in itertools.combinations(known, 2):
        small, large = sorted((len(held[a]), len(held[b])))
        if 5 * small >= 4 * large and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
            low, high = sorted((root[a], root[b]))
            root = {d: low if r == high else r for d, r in root.items()}
    kept = {d for d in held if root[d] == d}
    found = stages["minhash_dedup"](spark, docs, SMALL)
    assert rows(found) == Counter({k: n for k, n in rows(docs).items() if k[0] in kept})


def test_mixing(spark, docs, stages):
    sizes: dict = {}
    table = [(r.source, r.doc_id, r.text, r.lang, r.n_chars, len(WORD.findall(r.text or ""))) for r in docs.collect()]
    for source, *_, size in table:
        sizes[source] = sizes.get(source, 0) + size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    total, target, open_sources = sum(sizes.values()), {}, set(order)
    while open_sources:
        left = total - sum(target.values())
        share = left / sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if weight[s] * share > 3 * sizes[s]}
        if not full:
            target |= {s: weight[s] * share for s in open_sources}
            break
        target |= {s: 3 * sizes[s] for s in full}
        open_sources -= full
    want: Counter = Counter()
    for source in order:
        own = [r for r in table if r[0] == source]
        place = lambda r: hashlib.md5(str("" if r[1] is None else r[1]).encode()).hexdigest()
        own.sort(key=lambda r: (place(r), r[1] or 0, r[5]))
        quota = round(target[source])
        while quota > 0 and sizes[source]:
            for _, doc_id, text, lang, n_chars, size in own:
                if not size or quota <= 0:
                    continue
                cut = text if size <= quota else " ".join(WORD.findall(text)[:quota])
                want[doc_id, cut, lang, source, n_chars] += 1
                quota -= min(size, quota)
    assert rows(stages["mixing"](spark, docs, SMALL)) == want


def test_packing(spark, docs, stages):
    tokenizer = Tokenizer.from_file(queries.VOCABULARY)
    ids: dict = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    crc = lambda part: __import__("zlib").crc32(np.array(part, "<u4").tobytes())
    pieces = stages["packing"](spark, docs, SMALL).collect()
    for r in pieces:
        assert any(
            len(own) == r.doc_tokens and crc(own[r.start : r.start + r.length]) == r.ids_crc32 for own in ids[r.doc_id]
        )
    covered: dict = {}
    for r in pieces:
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
    assert covered == {d: sum(map(len, own)) for d, own in ids.items()}
    at: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= packing.SEQUENCE_TOKENS
    assert sum(at.values()) > 0.95 * packing.SEQUENCE_TOKENS * len(at)


def test_the_whole_run_is_its_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "exact_dedup", "minhash_dedup", "mixing", "packing",
    ]
    kept = common.read_documents(spark, SMALL)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, SMALL)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SMALL)
    assert Counter(map(tuple, whole.select(*columns).collect())) == Counter(map(tuple, kept.select(*columns).collect()))


def test_stages_on_an_empty_table(spark, docs, stages):
    none = docs.limit(0)
    for name, stage in stages.items():
        got = stage(spark, none, SMALL)
        assert got.count() == 0, name
        assert name == "packing" or got.columns == docs.columns


def test_workers_get_the_package(tmp_path):
    """Started elsewhere, with the repository on the driver's path only."""
    code = f"""
        import sys
        sys.path.insert(0, {str(common.__file__.split("/vitrina/")[0])!r})
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
        import __spark_entry__ as entry
        print("rows", entry.queries()["op9_token_counts"](spark, {SMALL!r}).count())
    """
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "rows 200" in done.stdout, done.stderr[-2000:]


def test_the_other_queries_stay_without_the_libraries_of_these(tmp_path):
    code = f"""
        import sys
        sys.path.insert(0, {str(common.__file__.split("/vitrina/")[0])!r})
        sys.modules["tiktoken"] = None
        import __spark_entry__ as entry
        names = set(entry.queries())
        print("held", len(names) > 80, any(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
    """
    done = subprocess.run(
        [sys.executable, "-W", "ignore", "-c", textwrap.dedent(code)], cwd=tmp_path, capture_output=True, text=True, timeout=100
    )
    assert "held True False False" in done.stdout, done.stderr[-2000:]

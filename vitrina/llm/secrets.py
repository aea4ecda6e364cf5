"""Secret findings, with a random forest that removes false positives.

A finding is a run of at least 16 characters of the key alphabet, or a shorter value that is given
to a credential word or stands as the password of an address. Its features are its length,
the transitions between kinds of characters, the share of it that a dictionary of the corpus
covers, the path it lies in, and the words around it. The forest is trained on labelled
findings and scores every finding. Where nobody has labelled findings, secrets and things that
look like them are planted between words of the corpus: what was planted is the label, and
features are taken of the planted text as of any other.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import fold, whole_text, words
from vitrina.session import written_table

LEAST_LENGTH = 16
#: Equal signs belong to a candidate at its end only, so `key=value` is two.
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}+(?:={{1,2}}(?![A-Za-z0-9+/_\"'=-]))?"
SHORT = r"""[^\s"'`,;(){}\[\]<>]{4,}"""
#: The dictionary holds the words that make up this share of the corpus' words or more, so it
#: has at most one word for each such share.
DICTIONARY_SHARE = 1e-5
GRAM = 4
#: The forest is fitted on at most about so many labelled findings.
TRAINING_FINDINGS = 20_000
#: Labels are planted into about so many documents; each gets one of every form.
PLANTED_DOCUMENTS = 1_000
KEPT_FROM = 0.5
SEED = 7

CREDENTIAL_WORDS = r"(?i)(token|secret|passw|pwd|api_?key|apikey|auth|bearer|credential|private)"
#: A key goes on for a bounded number of characters: it is tried at every place of a long word.
KEY_WORD = r"(?i)(?:token|secret|passw|pwd|api_?key|apikey|auth|bearer|credential|private)[A-Za-z0-9_.-]{0,64}"
GIVEN = r"""(?:[=:]>?|=>|\b(?i:bearer|basic))"""
#: The words before a value, a value inside its word, and the password of an address.
GIVEN_AHEAD = rf"""{KEY_WORD}["']?\s?[=:]+>?$|\b(?i:bearer|basic)$"""
GIVEN_INSIDE = rf"""{KEY_WORD}["']?[=:]["']?({SHORT})"""
ADDRESS_PASSWORD = r"://[^\s/:@]*:([^\s@/]+)@"
DUMMY_WORDS = r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|your[_-])"
TEST_PATH = r"(?i)(test|spec|example|sample|fixture|doc)"

FEATURES = [
    "length", "digits", "uppers", "hex", "runs", "distinct", "vowels", "repeats",
    "dictionary", "path_test", "path_slashes",
    "credential_before", "assigned", "quoted", "dummy_near", "plain_after",
]


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, path, word_number, part_number, candidate, inside, before, before2, after.

    `inside` is the word that holds the candidate. Whole texts are read; null texts have none.
    """
    split = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(path).alias("path"), words(whole_text(text)).alias("_words")
    )
    near = lambda i: F.coalesce(F.get("_words", i), F.lit(""))
    around = F.transform(
        "_words",
        lambda w, i: F.when(
            w.rlike(CANDIDATE)
            | w.rlike(GIVEN_INSIDE)
            | w.rlike(ADDRESS_PASSWORD)
            | F.concat_ws(" ", near(i - 2), near(i - 1)).rlike(GIVEN_AHEAD),
            F.struct(
                i.cast("long").alias("word_number"),
                w.alias("inside"),
                near(i - 1).alias("before"),
                near(i - 2).alias("before2"),
                near(i + 1).alias("after"),
            ),
        ),
    )
    hits = split.select("doc_id", "path", F.inline(F.filter(around, lambda x: x.isNotNull())))
    every = lambda pattern, group: F.regexp_extract_all("inside", F.lit(pattern), group)
    ahead = F.concat_ws(" ", "before2", "before").rlike(GIVEN_AHEAD)
    given = F.array_distinct(
        F.concat(
            every(ADDRESS_PASSWORD, 1),
            F.when(F.col("inside").rlike(ADDRESS_PASSWORD), F.array().cast("array<string>")).otherwise(
                F.concat(
                    every(GIVEN_INSIDE, 1),
                    F.when(ahead & ~F.col("inside").rlike(GIVEN_INSIDE), every(SHORT, 0)).otherwise(F.array().cast("array<string>")),
                )
            ),
        )
    )
    short = F.filter(given, lambda v: v.rlike("[A-Za-z0-9]") & ~v.rlike(CANDIDATE) & ~v.rlike("(?i)^(bearer|basic)$"))
    parts = F.posexplode(F.concat(every(CANDIDATE, 0), short)).alias("part_number", "candidate")
    return hits.select("*", parts)


def dictionary(docs: DataFrame, text: str = "text") -> DataFrame:
    """gram: the four-letter pieces of the corpus' frequent words, by their share of all words."""
    plain = docs.select(F.explode(words(F.lower(whole_text(text)))).alias("word"))
    short = plain.where(F.length("word").between(GRAM, LEAST_LENGTH) & F.col("word").rlike(r"^\p{L}+$"))
    counted = written_table(short.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    everything = counted.agg(F.sum("n").alias("n")).first().n or 0
    frequent = counted.where(F.col("n") >= DICTIONARY_SHARE * everything)
    return frequent.select(F.explode(_grams(F.col("word"))).alias("gram")).distinct()


def _grams(word: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(word) - (GRAM - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(GRAM))
    )


def _share(part: Column, whole: Column) -> Column:
    return F.length(part) / F.length(whole).cast("double")


def features(found: DataFrame, grams: DataFrame) -> DataFrame:
    """`found` with the columns FEATURES, all double."""
    c, around = F.col("candidate"), F.concat_ws(" ", "before2", "before", "inside", "after")
    ahead = F.concat_ws(" ", "before2", "before", F.split_part("inside", F.col("candidate"), F.lit(1)))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A")
    strip = lambda pattern: F.regexp_replace(c, pattern, "")
    plain = found.select(
        "*",
        F.length(c).cast("double").alias("length"),
        _share(strip("[^0-9]"), c).alias("digits"),
        _share(strip("[^A-Z]"), c).alias("uppers"),
        c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        _share(kinds, c).alias("runs"),
        (F.size(F.array_distinct(F.split(c, ""))) / F.least(F.length(c), F.lit(64))).alias("distinct"),
        _share(strip("(?i)[^aeiou]"), c).alias("vowels"),
        (1 - _share(F.regexp_replace(c, r"(.)\1+", "$1"), c)).alias("repeats"),
        F.coalesce(F.col("path").rlike(TEST_PATH), F.lit(False)).cast("double").alias("path_test"),
        (F.length(c) - F.length(F.translate(c, "/", ""))).cast("double").alias("path_slashes"),
        (ahead.rlike(CREDENTIAL_WORDS) | (ahead.rlike(r"://[^\s/:@]*:$") & F.col("inside").rlike(ADDRESS_PASSWORD)))
        .cast("double")
        .alias("credential_before"),
        ahead.rlike(rf"{GIVEN}\s*[\"']?$").cast("double").alias("assigned"),
        F.col("inside").rlike(r"[\"']").cast("double").alias("quoted"),
        around.rlike(DUMMY_WORDS).cast("double").alias("dummy_near"),
        F.col("after").rlike(r"^\p{L}*$").cast("double").alias("plain_after"),
        F.monotonically_increasing_id().alias("_finding"),
    )
    held = written_table(plain, "findings")
    pieces = held.select("_finding", F.explode(_grams(F.lower("candidate"))).alias("gram"))
    known = grams.select("gram", F.lit(1.0).alias("_known"))
    covered = (
        pieces.join(known, "gram", "left")
        .groupBy("_finding")
        .agg(F.avg(F.coalesce("_known", F.lit(0.0))).alias("dictionary"))
    )
    return held.join(covered, "_finding").drop("_finding")


def _drawn(*salt: Column | str) -> Column:
    """64 hexadecimal digits of a document and a salt."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *map(_text, salt)), 256)


def _text(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def _mixed(length: int, *salt: str) -> Column:
    """So many letters and digits, both cases."""
    both = F.concat(*(F.base64(F.unhex(_drawn(*salt, str(part)))) for part in range(length // 32 + 1)))
    return F.substring(F.regexp_replace(both, "[^A-Za-z0-9]", ""), 1, length)


def _upper(length: int, salt: str) -> Column:
    return F.upper(F.substring(F.translate(_drawn(salt), "0123", "kwqz"), 1, length))


def planted_forms() -> list[tuple[Column, Column | None]]:
    """(text, the secret in it or None) of everything that is planted, built of `w1` to `w4`,
    words of the document.

    Secrets: service tokens, access keys, signed tokens and key blocks that stand alone; digests
    and passwords where they are given to a credential word or in an address. The others:
    compounds, identifiers, paths, numbers, digests and ids that nothing asks for a secret, and
    dummies in the place of one.
    """
    w1, w2, w3, w4 = (F.lower(f"w{i}") for i in range(1, 5))
    hexes = lambda n, salt: F.substring(_drawn(salt), 1, n)
    word = lambda salt: F.concat(F.substring(w1, 1, 5), hexes(3, salt))
    join = lambda *parts: F.concat(*map(_text, parts))
    block = [_mixed(64, "s6"), _mixed(64, "s7")]
    signed = join("eyJ", _mixed(33, "s3"), ".eyJ", _mixed(60, "s4"), ".", _mixed(43, "s5"))
    alone = [join("ghp_", _mixed(36, "s1")), join("AKIA", _upper(16, "s2")), signed, join("sk_live_", _mixed(24, "s8"))]
    secrets = [(one, one) for one in alone]
    secrets.append((join("-----BEGIN PRIVATE KEY----- ", block[0], " ", block[1]), F.concat_ws(" ", *block)))
    for before, secret, after in [
        ('token = "', hexes(32, "s9"), '"'),
        ("token: ", hexes(24, "s10"), ""),
        ("api_key=", _mixed(20, "s11"), ""),
        ("SECRET_ACCESS_KEY=", _mixed(32, "s12"), ""),
        ("Authorization: Bearer ", hexes(40, "s13"), ""),
        ('pwd = "', word("s14"), '"'),
        ("password: ", word("s15"), ""),
        (join("db://", w2, ":"), word("s16"), join("@host/", w3)),
        ("auth ", _mixed(24, "s17"), ""),
    ]:
        secrets.append((join(before, secret, after), secret))
    others = [
        F.concat(w1, w2, w3, w4),
        F.concat_ws("_", w1, w2, w3, w4),
        F.concat_ws("-", w1, w2, w3, w4),
        F.upper(F.concat_ws("_", w1, w2, w3, F.lit("key"))),
        F.concat(*map(F.initcap, (w1, w2, w3, w4))),
        F.concat_ws("/", w1, w2, w3, w4),
        join("https://", w1, ".org/", w2, "/", w3, "/", w4),
        F.translate(hexes(16, "o1"), "abcdef", "012345"),
        join("commit ", hexes(40, "o2")),
        join("sha256:", hexes(64, "o3")),
        join("id ", hexes(8, "o4"), "-", hexes(4, "o5"), "-", hexes(4, "o6"), "-", hexes(12, "o7")),
        join("api_key=your-api-key-", w1),
        join('password = "changeme', hexes(2, "o8"), '"'),
        join("example token: ", hexes(24, "o9")),
        join("example SECRET_ACCESS_KEY=", _mixed(32, "o10")),
        join("sample api_key=", _mixed(24, "o11")),
        join("token: ", w1, " ", w2),
        join("secret = ", w1, w2, w3, w4),
        join("v", hexes(1, "o12"), ".", w1, "_", w2, "_", w3, "_2024"),
    ]
    return secrets + [(form, None) for form in others]


def planted_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, source, form, secret, text: about PLANTED_DOCUMENTS documents, one row per planted form.

    A text is a few words of the document around what is planted, and holds nothing else.
    """
    letters = F.filter(words(whole_text(text)), lambda w: w.rlike(r"^\p{L}{4,}$"))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(path).alias("source"), letters.alias("_words"))
    share = min(1.0, PLANTED_DOCUMENTS / max(1, docs.count()))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("planted")), F.lit(1_000_000))
    chosen = own.where((draw < F.lit(share * 1_000_000)) & (F.size("_words") >= 8))
    place = lambda i: F.pmod(F.xxhash64("doc_id", F.lit(i)), F.size("_words").cast("long")).cast("int")
    named = chosen.select("doc_id", "source", *(F.get("_words", place(i)).alias(f"w{i}") for i in range(1, 9)))
    nothing = F.lit(None).cast("string")
    forms = F.array(
        *(
            F.struct(
                F.lit(n).alias("form"),
                (nothing if secret is None else secret).alias("secret"),
                F.concat_ws(" ", "w5", "w6", planted, "w7", "w8").alias("text"),
            )
            for n, (planted, secret) in enumerate(planted_forms())
        )
    )
    return named.select("doc_id", "source", F.inline(forms))


def planted_findings(
    docs: DataFrame, grams: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = "source"
) -> DataFrame:
    """Findings in planted texts with their features, `form`, and `label`: 1 in the planted secret, else 0."""
    named = planted_texts(docs, doc_id, text, path).withColumn("_id", F.monotonically_increasing_id())
    table = written_table(named, "planted")
    found = features(findings(table, "_id", "text", "source"), grams).withColumnRenamed("doc_id", "_id")
    inside = F.coalesce(F.contains("secret", "candidate"), F.lit(False)).cast("double")
    return found.join(table.select("_id", "doc_id", "form", "secret"), "_id").withColumn("label", inside).drop("_id", "secret")


def trained_forest(labelled: DataFrame, most: int = TRAINING_FINDINGS, trees: int = 20, depth: int = 6):
    """A forest on the FEATURES of `labelled` and its label; a number if there is one label only."""
    counts = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.0))
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, most / 2 / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "word_number", "part_number"), F.lit(1_000_000)) / 1e6
    sample = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled.where(draw < share))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, maxBins=64)
    return forest.fit(sample.select("features", "label"))


def scan_secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str = "source",
    kept_from: float = KEPT_FROM,
) -> DataFrame:
    """All findings with their features, the forest's `score` (0 to 1) and `is_secret`.

    `labelled` has FEATURES and label; without it findings are planted into the training fold
    (crc32 of the id modulo 4 is not 2). If no label can be had, or one only, its value is the
    score. Texts without a finding and null or empty texts give no rows, nor does an empty
    table. Whole texts and words of any length are read in time proportional to their length. A
    null path is no test path. Repeated rows give their findings again. Other columns are not read.
    """
    grams = written_table(dictionary(docs, text), "grams")
    found = written_table(features(findings(docs, doc_id, text, path), grams), "features")
    if labelled is None:
        labelled = planted_findings(docs.where(fold(doc_id, 4) != 2), grams, doc_id, text, path)
    return scored_findings(found, trained_forest(written_table(labelled, "labelled")), kept_from)


def scored_findings(found: DataFrame, model, kept_from: float = KEPT_FROM) -> DataFrame:
    """`found` with the forest's score and whether it is kept."""
    if isinstance(model, float):
        scored = found.withColumn("score", F.lit(model))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    return scored.withColumn("is_secret", F.col("score") >= kept_from)

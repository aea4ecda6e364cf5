"""SimHash fingerprints, their edited texts, and the search within a Hamming radius.

Terms are pairs of neighbouring words, with marks for the text's begin and end. A term's weight
is the number of its occurrences times the length of its first word. Each term's 64-bit hash
votes with its weight for the set bits and against the others.

Votes are counted two bits to a long, in the codegen of a hash aggregate: `(h >> i) & 0x0000000100000001`
holds the bits i and i + 32. A lane sums to less than the text's length, so it cannot overflow.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vitrina.llm.common import SPACE_CHARS, SPACES, shuffle_width, whole_text
from vitrina.session import written_table

BITS = 64
LANES = 32
LANE_MASK = 0x0000000100000001
BEGIN = "\x02"
#: Pieces of the id range: the cuts between buckets follow the ids' distribution at so many knots.
KNOTS = 64
RADIUS = 3
BLOCKS = 6


def simhash(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """`keys` and the long `fp` of each row; `keys` must tell all rows apart."""
    marked = texts.select(
        *keys,
        F.split(
            F.concat(F.lit(BEGIN + " "), F.rtrim(F.ltrim(F.col(text), F.lit(SPACE_CHARS)), F.lit(SPACE_CHARS))),
            SPACES,
        ).alias("_words"),
    )
    terms = marked.select(
        *keys,
        F.inline(
            F.transform(
                "_words",
                lambda word, i: F.struct(
                    F.xxhash64(word, F.get("_words", i + 1)).alias("_h"),
                    F.length(word).cast("long").alias("_w"),
                ),
            )
        ),
    )
    lanes = [
        F.sum(F.shiftright("_h", i).bitwiseAND(F.lit(LANE_MASK)) * F.col("_w")).alias(f"_v{i}")
        for i in range(LANES)
    ]
    votes = terms.groupBy(*keys).agg(F.sum("_w").alias("_all"), *lanes)
    fp = F.lit(0).cast("long")
    for i in range(LANES):
        low, high = F.col(f"_v{i}").bitwiseAND(0xFFFFFFFF), F.shiftright(f"_v{i}", 32)
        for bit, held in ((i, low), (i + 32, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(2 * held > F.col("_all"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return votes.select(*keys, fp.alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def id_buckets(docs: DataFrame, doc_id: str, tie: str) -> Column:
    """A number that never falls along (doc_id, tie), nulls first, with about as many rows to each.

    `tie` is a 64-bit hash. Only quantiles of the ids are read. An id that is a quantile more
    than once has a share of the rows that would make a large bucket; its rows, and those
    without an id, are cut by their tie.
    """
    if not isinstance(docs.schema[doc_id].dataType, NumericType):
        raise TypeError(f"{doc_id} is no number: documents follow each other by numeric ids")
    pieces = -(-4 * shuffle_width(docs.sparkSession) // KNOTS)
    steps = [i / KNOTS for i in range(KNOTS + 1)]
    found = docs.agg(F.percentile_approx(doc_id, steps, 20 * KNOTS).alias("q")).first()["q"] or []
    knots = sorted(set(found))
    fine = pieces * KNOTS
    by_tie = F.floor((F.col(tie).cast("double") / float(1 << 63) + 1) / 2 * fine)
    by_tie = F.greatest(F.lit(0), F.least(by_tie, F.lit(fine - 1))).cast("long")
    bucket = F.lit(-1).cast("long")
    for number, low in enumerate(knots):
        high = knots[number + 1] if number + 1 < len(knots) else low + 1
        inside = (F.col(doc_id).cast("double") - float(low)) / float(high - low) * pieces
        place = F.greatest(F.lit(0), F.least(F.floor(inside), F.lit(pieces - 1))).cast("long")
        start = number * 2 * fine
        bucket = F.when(F.col(doc_id) >= low, place + (start + fine)).otherwise(bucket)
        if found.count(low) > 1:
            bucket = F.when(F.col(doc_id) == low, by_tie + start).otherwise(bucket)
    return F.when(F.col(doc_id).isNull(), by_tie - (fine + 1)).otherwise(bucket)


def _with_next(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """`rows` with `next`: `value` of the following row; after the last row, of the first.

    Buckets are sorted one by one. The first row of each is added once more behind the bucket
    before it, so that no row looks into another bucket.
    """
    heads = rows.groupBy("bucket").agg(F.min(F.struct(*order)).alias("_head"))
    around = Window.orderBy("bucket")  # one narrow row per bucket
    lists = heads.select(
        F.col("bucket").alias("_of"),
        "_head",
        F.coalesce(
            F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy())
        ).alias("_to"),
    )
    same = F.lit(True)
    for name in order:
        same = same & F.col(name).eqNullSafe(F.col(f"_head.{name}"))
    ghosts = (
        rows.join(F.broadcast(lists), (F.col("bucket") == F.col("_of")) & same)
        .groupBy("_to")
        .agg(*(F.first(c).alias(c) for c in rows.columns if c != "bucket"))
        .withColumnRenamed("_to", "bucket")
        .withColumn("_ghost", F.lit(1))
    )
    both = rows.withColumn("_ghost", F.lit(0)).unionByName(ghosts)
    follow = Window.partitionBy("bucket").orderBy("_ghost", *order)
    return both.withColumn("next", F.lead(value).over(follow)).where(F.col("_ghost") == 0).drop("_ghost")


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp; one row per row of `docs`.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many
    (or all) of the next document by doc_id, nulls first; the last document's next is the
    first, a single document's is itself. Rows that repeat an id follow each other by a hash
    of their texts. A null text is empty; all texts without words have the fingerprint of the
    begin mark alone. An empty table gives no rows. Other columns are not read. Ids are
    numbers; a column of another type is refused.
    """
    plain = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    tied = plain.withColumn("tie", F.xxhash64("text"))
    bucket = id_buckets(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "tie")
    tied = tied.select("doc_id", bucket.alias("bucket"), "text", "tie")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - quarter), F.substring("next", F.lit(1), quarter)
    )
    pairs = _with_next(tied, "text", ["doc_id", "tie"]).select(
        "bucket", "doc_id", F.monotonically_increasing_id().alias("row"), "text", edited.alias("edited")
    )
    keys = ["bucket", "row", "doc_id", "n_chars", "sha256", "kind"]
    entry = lambda kind, sha256, n_chars, words: F.struct(
        F.lit(kind).alias("kind"),
        sha256.cast("string").alias("sha256"),
        n_chars.cast("long").alias("n_chars"),
        F.col(words).alias("words"),
    )
    nothing = F.lit(None)
    own = entry(0, nothing, F.length("text"), "text")
    changed = entry(1, F.sha2(F.col("edited").cast("binary"), 256), nothing, "edited")
    both = pairs.select("bucket", "row", "doc_id", F.inline(F.array(own, changed)))
    voted = written_table(simhash(both, keys, "words"), "fingerprints")
    kind = lambda value, number: F.max(F.when(F.col("kind") == number, F.col(value)))
    held = voted.groupBy("bucket", "row", "doc_id").agg(
        kind("n_chars", 0).alias("n_chars"),
        F.max("sha256").alias("edited_sha256"),
        kind("fp", 0).alias("fp"),
        kind("fp", 1).alias("edited_fp"),
    )
    return _with_next(held, "fp", ["row"]).withColumnRenamed("next", "next_fp").drop("bucket", "row")


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """Bit masks of the permuted tables: all choices of `blocks - radius` blocks.

    Fingerprints that differ in at most `radius` bits differ in at most as many blocks, so
    they agree on all blocks of at least one table.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    of = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(of, blocks - radius)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def near_fingerprints(
    queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """All (query_fp, fp, distance) of distinct fingerprints within `radius` bits.

    `queries` and `fingerprints` have a long column fp. Each table is keyed by its blocks'
    bits; a pair is made only in the first of the tables that it agrees on, and bits are
    compared inside the join.
    """
    masks = [F.lit(_signed(m)) for m in block_tables(radius, blocks)]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        entries = [F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(m).alias("key")) for i, m in enumerate(masks)]
        return df.select("fp").distinct().select(F.col("fp").alias(name), F.inline(F.array(*entries)))

    apart = F.col("query_fp").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*(F.when(apart.bitwiseAND(m) == 0, F.lit(i)) for i, m in enumerate(masks)))
    left, right = keyed(queries, "query_fp").alias("q"), keyed(fingerprints, "fp").alias("f")
    on = (
        (F.col("q.table") == F.col("f.table"))
        & (F.col("q.key") == F.col("f.key"))
        & (F.bit_count(apart) <= radius)
        & (first == F.col("q.table"))
    )
    return left.join(right, on).select("query_fp", "fp", F.bit_count(apart).alias("distance"))


def near_classes(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """query_fp, near_docs, near_ids of the rows (flag `is_query`, fp, doc_id) within `radius`.

    `near_docs` counts rows, the query's own included. `near_ids` has the smallest doc_id of each
    distinct fingerprint within the radius, of which there are at most 43,745 at three bits; the
    other members of its class are the rows with the same fingerprint.
    """
    classes = rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    pairs = near_fingerprints(rows.where("is_query"), classes, radius)
    return (
        pairs.join(classes, "fp")
        .groupBy("query_fp")
        .agg(F.sum("n").alias("near_docs"), F.array_sort(F.collect_list("least")).alias("near_ids"))
    )

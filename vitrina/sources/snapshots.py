"""Saved snapshot documents (JSON, or HTML reports that embed the JSON) as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.functions.text import WS, blank_to_null
from vitrina.operators.pairing import number_snapshots
from vitrina.operators.rows import keep_computed
from vitrina.schemas import PRICE, SNAPSHOT_DOCUMENT
from vitrina.sources.buckets import bucket_width, bucketed_table

# Fixed value: the element of an HTML report that carries its dataset. Reports already
# saved are found by this id.
EMBEDDED_DATASET = r'(?s)<script type="application/json" id="scrap-data">(.*?)</script>'

DEFAULT_BRAND = "Marca"
# A snapshot too large for one document is saved as numbered parts of this name.
PART_SUFFIX = r"\.part(\d+)(?=\.[^.]*$|$)"
PART_STRIDE = 1 << 40
SNAPSHOT_KEY = ["store_id", "snapshot_id"]
# What the first part of a snapshot says of all of it.
HEADER = ["brand", "platform", "currency", "source", "stock_total", "stock_known", "min_price", "max_price"]
# The parts of a large snapshot lie apart.
DOCUMENT_KEY = [*SNAPSHOT_KEY, "part"]


@dataclass(frozen=True)
class SnapshotTables:
    snapshots: DataFrame
    observations: DataFrame
    rejects: DataFrame
    warnings: DataFrame


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file under the paths.

    The folder a file lies in names its store, or the `store_id=…/source_file=…`
    folders that `write_document_files` makes name both.
    """
    reader = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
    return with_file_columns(reader.text(paths))


def with_file_columns(raw: DataFrame) -> DataFrame:
    # the path is URL-encoded, but a plus sign in it is a plus sign
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))

    def folder(name: str) -> Column:
        return blank_to_null(F.regexp_extract(path, f"/{name}=([^/]+)/", 1))

    return raw.select(
        F.coalesce(folder("store_id"), F.regexp_extract(path, "([^/]+)/[^/]+$", 1)).alias(
            "store_id"
        ),
        F.coalesce(folder("source_file"), F.regexp_extract(path, "([^/]+)$", 1)).alias(
            "source_file"
        ),
        F.col("value").alias("body"),
    )


def dataset_text(source_file: Column, body: Column) -> Column:
    """JSON text of a document; null when it is HTML without an embedded dataset."""
    first_char = F.regexp_extract(body, rf"^{WS}*(.)", 1)
    is_html = source_file.rlike(r"(?i)\.html?$") | (first_char == "<")
    embedded = blank_to_null(F.regexp_extract(body, EMBEDDED_DATASET, 1))
    return F.when(is_html, embedded).otherwise(body)


def capture_time(text: Column) -> Column:
    """ISO-8601 text or epoch milliseconds."""
    millis = F.when(text.rlike(r"^-?\d{9,}$"), text.try_cast("bigint"))
    # a time of day alone would be read as today
    dated = F.when(text.rlike(r"^\s*\d{4}"), text.try_cast("timestamp"))
    return F.coalesce(F.timestamp_millis(millis), dated)


def document_datasets(documents: DataFrame) -> DataFrame:
    """Each document's place and its JSON text: the short form, in which documents are exchanged."""
    part = F.regexp_extract("source_file", PART_SUFFIX, 1).try_cast("bigint")
    return documents.select(
        "store_id",
        "source_file",
        F.regexp_replace("source_file", PART_SUFFIX, "").alias("snapshot_id"),
        F.coalesce(part, F.lit(0)).alias("part"),
        dataset_text(F.col("source_file"), F.col("body")).alias("json"),
    )


def parse_documents(documents: DataFrame) -> DataFrame:
    return parse_datasets(document_datasets(documents))


def parse_datasets(datasets: DataFrame) -> DataFrame:
    """Documents with their parsed body and every problem found in each.

    A problem of `errors` rejects the document; `warnings` tell of values that read as unknown.
    """
    stated = F.nullif(blank_to_null(F.col("doc.scrapedAt")), F.lit("0"))
    products = F.col("doc.products")
    nameless = F.size(F.filter(products, lambda p: p.isNull() | p["id"].isNull()))
    readable = F.col("json").isNotNull() & F.col("is_json")

    def problem(when: Column, message: Column | str) -> Column:
        text = F.lit(message) if isinstance(message, str) else message
        return F.when(when, text)

    problems = F.array_compact(
        F.array(
            problem(F.col("json").isNull(), "HTML without an embedded dataset"),
            problem(F.col("json").isNotNull() & ~F.col("is_json"), "not valid JSON"),
            problem(readable & stated.isNull(), 'no "scrapedAt"'),
            problem(
                readable & stated.isNotNull() & F.col("scraped_at").isNull(),
                F.concat(F.lit('"scrapedAt" is not a date: '), stated),
            ),
            problem(readable & products.isNull(), 'no "products" list'),
            problem(readable & (F.size(products) == 0), '"products" is empty'),
            problem(
                readable & (nameless > 0),
                F.concat(nameless.cast("string"), F.lit(' product(s) without "id"')),
            ),
        )
    )
    unreadable = F.size(
        F.filter(products, lambda p: blank_to_null(p["price"]).isNotNull() & p["price"].try_cast(PRICE).isNull())
    )
    warnings = F.array_compact(
        F.array(
            problem(
                readable & (unreadable > 0),
                F.concat(unreadable.cast("string"), F.lit(" product(s) with an unreadable price")),
            )
        )
    )
    # Wrapping the text in brackets makes trailing characters after the document an error.
    length = F.json_array_length(F.concat(F.lit("["), F.col("json"), F.lit("]")))
    is_object = F.regexp_extract(F.col("json"), rf"^{WS}*(.)", 1) == "{"
    return (
        datasets.withColumn("is_json", F.coalesce((length == 1) & is_object, F.lit(False)))
        .withColumn("doc", F.from_json("json", SNAPSHOT_DOCUMENT, {"allowSingleQuotes": "false"}))
        .withColumn("scraped_at", capture_time(F.col("doc.scrapedAt")))
        .select(
            "store_id",
            "source_file",
            "snapshot_id",
            "part",
            problems.alias("errors"),
            warnings.alias("warnings"),
            "scraped_at",
            F.coalesce(blank_to_null(F.col("doc.brand")), F.lit(DEFAULT_BRAND)).alias("brand"),
            blank_to_null(F.col("doc.platform")).alias("platform"),
            blank_to_null(F.col("doc.currency")).alias("currency"),
            blank_to_null(F.col("doc.source")).alias("source"),
            F.col("doc.summary.stockTotal").alias("stock_total"),
            F.col("doc.summary.stockKnown").alias("stock_known"),
            F.col("doc.summary.minPrice").alias("min_price"),
            F.col("doc.summary.maxPrice").alias("max_price"),
            F.size(products).cast("bigint").alias("n_products"),
            products.alias("products"),
        )
    )


def flatten_products(parsed: DataFrame, *more: str) -> DataFrame:
    """One row per product of the faultless documents, keeping its place in the document.

    `more` are columns of the document that its rows keep.
    """
    listed = F.when(F.size("errors") == 0, F.col("products"))
    return parsed.select(
        "store_id",
        "snapshot_id",
        *more,
        "scraped_at",
        "part",
        F.posexplode(listed).alias("index", "product"),
    ).select(
        "store_id",
        "snapshot_id",
        *more,
        "scraped_at",
        (F.col("part") * F.lit(PART_STRIDE) + F.col("index")).alias("pos"),
        F.col("product.id").alias("product_id"),
        F.col("product.name").alias("name"),
        F.col("product.brand").alias("brand"),
        F.col("product.price").try_cast(PRICE).alias("price"),
        F.col("product.stock").alias("stock"),
        F.col("product.soldQty").alias("sold_qty"),
        F.col("product.available").alias("available"),
        F.col("product.variants").alias("variants"),
    )


def document_headers(parsed: DataFrame) -> DataFrame:
    """What is known of each document apart from its products."""
    return parsed.drop("products")


def gathered_snapshots(headers: DataFrame) -> DataFrame:
    """One row per snapshot, with the worst of its documents."""
    return headers.groupBy(*SNAPSHOT_KEY).agg(
        F.max(F.size("errors")).alias("worst"),
        (F.min("scraped_at") < F.max("scraped_at")).alias("torn"),
        F.min("source_file").alias("source_file"),
        F.min("scraped_at").alias("scraped_at"),
        *[F.min_by(name, "part").alias(name) for name in HEADER],
        F.sum("n_products").alias("n_products"),
    )


def valid_snapshots(headers: DataFrame) -> DataFrame:
    """Numbered snapshots whose documents are all faultless and of one time."""
    sound = gathered_snapshots(headers).where((F.col("worst") == 0) & ~F.col("torn"))
    return number_snapshots(sound.drop("worst", "torn"))


def rejected_documents(headers: DataFrame) -> DataFrame:
    """Documents with problems, and first parts of snapshots captured at several times."""
    faulty = headers.select("store_id", "source_file", "errors")
    torn = gathered_snapshots(headers).where((F.col("worst") == 0) & F.col("torn"))
    return keep_computed(faulty, F.size("errors") > 0).unionByName(
        torn.select(
            "store_id",
            "source_file",
            F.array(F.lit('parts differ in "scrapedAt"')).alias("errors"),
        )
    )


def warned_documents(headers: DataFrame) -> DataFrame:
    """Documents with values that read as unknown, whether they are rejected or not."""
    return keep_computed(headers.select("store_id", "source_file", "warnings"), F.size("warnings") > 0)


def numbered_documents(headers: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The number of the snapshot that each document is of; documents of rejected ones have none."""
    numbers = snapshots.select(*SNAPSHOT_KEY, "snap_ord")
    return headers.select(*DOCUMENT_KEY).distinct().join(numbers, SNAPSHOT_KEY).select(*DOCUMENT_KEY, "snap_ord")


def snapshot_tables(parsed: DataFrame) -> SnapshotTables:
    """All results of parsed documents, which are a stored table: headers read its short columns only.

    Snapshots are numbered before their products become rows, and the numbers are stored as the
    documents are, so that no product is exchanged for its number where the documents lie by
    DOCUMENT_KEY.
    """
    headers = document_headers(parsed)
    snapshots = valid_snapshots(headers)
    numbers = bucketed_table(numbered_documents(headers, snapshots), "numbers", DOCUMENT_KEY)
    rows = flatten_products(parsed.join(numbers, DOCUMENT_KEY), "snap_ord")
    return SnapshotTables(snapshots, rows, rejected_documents(headers), warned_documents(headers))


def load_snapshots(documents: DataFrame) -> SnapshotTables:
    """Split documents into snapshots, their product rows, rejects and warnings.

    Every document is read and parsed once, into a table by document that all results come
    from. They are dealt as text, before the parse. A problem rejects the whole snapshot the
    document belongs to; others go on.
    """
    buckets = bucket_width(documents.sparkSession)
    dealt = document_datasets(documents).repartition(buckets, *DOCUMENT_KEY)
    parsed = bucketed_table(parse_datasets(dealt), "parsed", DOCUMENT_KEY, buckets=buckets, dealt=True)
    return snapshot_tables(parsed)

"""From raw documents to packed training sequences, in five stages.

Each stage takes all rows that the one before kept, is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrina.llm import exact_dedup, language, minhash, mixing, packing
from vitrina.llm.common import read_documents
from vitrina.llm.queries import VOCABULARY
from vitrina.session import written_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go: noise, foreign texts, null and empty texts, texts without a letter.

    Rows that repeat go or stay alike. Without any labelled text, texts with a letter stay. An
    empty table stays empty.
    """
    return language.keep_identified(docs, language.train(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays, one row of those that repeat it.

    Null texts count as empty, and one of all empty ones stays; a null id stays only where no other
    has the text. An empty table stays empty.
    """
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles and a similarity of 0.8 the smallest id stays.

    Texts without a word are linked with nothing and stay. Rows that share an id are one
    document and stay or go together. An empty table stays empty.
    """
    return minhash.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: repeated up to three times, or cut, in training order.

    A null source is a source of its own; texts without a word are in no mix. Rows that repeat an
    id take part one by one. An empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences along the curve; a null or empty text is its end token alone.

    Every row is packed, repeats again. An empty table gives no pieces.
    """
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("minhash_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read by the next.

    A stage that was written is not run again when an executor is lost. An empty table gives no rows.
    """
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written_table(stage(spark, docs, sf_dir), name)
    return docs


#: Support vector machines and token ids are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None

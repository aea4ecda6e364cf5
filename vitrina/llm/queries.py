"""Each operator over the whole `documents` table, with the columns that its contract names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrina.llm import (
    chat,
    exact_dedup,
    fingerprints,
    language,
    lm,
    minhash,
    mixing,
    negatives,
    packing,
    resampling,
    secrets,
    tokens,
    toxicity,
)
from vitrina.llm.common import fold, read_documents
from vitrina.session import written_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Documents whose id is divisible by this are the queries of the fingerprint search.
QUERY_IDS = 50


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also, for ids divisible by 50 and null for the rest: `near_docs`, the other documents within
    three bits, and `near_ids`, the smallest doc_id of each fingerprint within three bits, as text."""
    found = written_table(fingerprints.fingerprint_documents(read_documents(spark, sf_dir)), "found")
    is_query = F.coalesce(F.col("doc_id") % QUERY_IDS == 0, F.lit(False))
    near = fingerprints.near_classes(found.select("doc_id", "fp", is_query.alias("is_query")))
    asked = found.where(is_query).join(near, F.col("fp") == F.col("query_fp"))
    both = asked.select(
        *found.columns, (F.col("near_docs") - 1).alias("near_docs"), F.array_join("near_ids", ",").alias("near_ids")
    ).unionByName(
        found.where(~is_query).withColumns(
            {"near_docs": F.lit(None).cast("long"), "near_ids": F.lit(None).cast("string")}
        )
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("fp")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "near_docs",
        "near_ids",
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).drop("source")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_documents(spark, sf_dir))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    scored = lm.score_documents(docs, docs.where(fold("doc_id", 5) != 1))
    held_out = (fold("doc_id", 5) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(fold("doc_id", 4) != 2))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per finding, false ones included; the finding itself is given as its hash."""
    return secrets.scan_secrets(read_documents(spark, sf_dir)).select(
        "doc_id",
        "word_number",
        "part_number",
        F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"),
        F.length("candidate").cast("long").alias("n_chars"),
        "score",
        "is_secret",
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), VOCABULARY)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    model = language.train(docs.where(fold("doc_id", 4) != 2))
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return language.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_documents(spark, sf_dir), VOCABULARY)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_documents(spark, sf_dir), shingle_words=4)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_documents(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(rows.withColumn("label", moved), is_anchor=F.col("vec_id") % 100 == 0)


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = read_documents(spark, sf_dir), read_documents(spark, sf_dir, "benchmark")
    return resampling.resample(docs, target).drop("n_words")


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = chat.with_conversation(
        read_documents(spark, sf_dir, "conversations"), -1, [("user", said), ("assistant", said)]
    )
    return chat.conversation_digests(chat.formatted_pieces(turns))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_lm_scores": op4_lm_scores,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_packing": op7_packing,
    "op8_language_id": op8_language_id,
    "op9_token_counts": op9_token_counts,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_target_resampling": op12_target_resampling,
    "op13_chat_formatting": op13_chat_formatting,
}

SQL = {
    "op2_mixing": mixing.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op10_minhash_dedup": minhash.oracle(4),
    "op11_hard_negatives": negatives.SQL,
    "op12_target_resampling": resampling.SQL,
    "op13_chat_formatting": chat.oracle(),
}

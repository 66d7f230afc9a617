"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import decontam, langid, linededup, piecedrop, pii, quality, secrets, sharding, simhash, tokenfiles
from tessel.llm.common import shared_dir, table, vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token-id files of `documents`, written and read back."""
    return tokenfiles.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of `documents` by fingerprints of 64 bits, three at most differing."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that give items of `benchmark` away, with the items and scores."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents under merge dropout, checked to decode to the texts."""
    return piecedrop.encode_documents(
        table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), dropout=0.1, seed=42
    )


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality rules of all documents, with perplexities and bands."""
    return quality.judge(table(spark, sf_dir, "documents"), few=0)


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, by virtual slots."""
    placed = sharding.shard_documents(
        table(spark, sf_dir, "documents"), shards=16, slots=4096, store=shared_dir(spark, "slot-map")
    )
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "virtual_slot", "map_version"
    )


def op7_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, and the terms that give it away."""
    return pii.protect(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of all documents."""
    # A document's own `lang` is what it declares, and its source stands for the host.
    rows = langid.evidence(table(spark, sf_dir, "documents"), F.col("lang"), F.col("source"))
    return langid.identify(rows).drop("row")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of all pages, with their markup, hosts and suffixes."""
    found = langid.identify(langid.page_evidence(table(spark, sf_dir, "pages"))).drop("row")
    return found.withColumnRenamed("doc_id", "page_id")


def op9_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, with who else holds them."""
    # A document's source stands for the owner, and source with language for the repository.
    return secrets.find_secrets(table(spark, sf_dir, "documents"), owner="source", repo=("source", "lang"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that many share."""
    lines = linededup.dedupe_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_simhash": op2_simhash,
        "op3_decontamination": op3_decontamination,
        "op4_merge_dropout": op4_merge_dropout,
        "op5_perplexity": op5_perplexity,
        "op6_virtual_slots": op6_virtual_slots,
        "op7_disclosure": op7_disclosure,
        "op8_language_id": op8_language_id,
        "op9_ownership": op9_ownership,
        "op10_line_dedup": op10_line_dedup,
        "language_id_pages": language_id_pages,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op10_line_dedup": linededup.ORACLE}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found

"""From raw documents to training tokens, in five stages.

Each stage works on all that its predecessor kept.  All but the last return the columns of `documents`.
Rows that share a doc_id are one document: they stay or go together, and a stage that judges rows keeps the
document if it keeps one of them.  Documents without an id are told apart by their texts: each is judged by its
own, and of equal ones one stays in the near-duplicate stage.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decontam, langid, linededup, neardup, piecedrop
from tessel.llm.common import cut, table, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _unit() -> Column:
    """What stays or goes together: the id, and without one a key from the text, over all ordinary ids."""
    key = F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 62) - 1).bitwiseOR(1 << 62)
    return F.coalesce("doc_id", key)


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", _unit())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose unit is not a doc_id of `gone`."""
    ids = gone.select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.select(COLUMNS).join(ids, _unit() == F.col("gone_id"), "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go."""
    found = langid.identify(langid.evidence(_named(docs), F.col("lang"), F.col("source")))
    return _without(docs, found.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("NOT kept"))


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; n_chars is that of the text that is left."""
    lines = linededup.dedupe_lines(docs, carry=("lang", "source"))
    return lines.select(
        "doc_id", "text", "carried.lang", "carried.source", F.char_length("text").cast("long").alias("n_chars")
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (a similarity of 0.8 or more in five-word shingles) the document with the
    smallest id stays."""
    groups = neardup.groups(_named(docs))
    stays = groups.filter("doc_id = component_id").select(F.col("doc_id").alias("stays")).distinct()
    kept = docs.select(COLUMNS).join(stays, _unit() == F.col("stays"), "left_semi")
    return kept.filter("doc_id IS NOT NULL").unionByName(kept.filter("doc_id IS NULL").dropDuplicates(["text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give a test item away go."""
    return _without(docs, decontam.contamination(_named(docs), table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge dropout, checked to decode to the text."""
    return piecedrop.encode_documents(docs, vocabulary("piece_bpe_32k.model"), dropout=0.1, seed=42)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: SQL has neither the fingerprints' hash nor the tokenizer; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written and read back for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: language ID, exact dedup, near dedup, source mixing, BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir).  All but the last return the columns
of documents.  ``run`` writes every stage's rows as Parquet under the shared folder and reads them
again for the next, so a lost executor costs a part of one stage.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as the operators
say: a null text is empty and goes at the first stage, null ids and sources stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import bpe, exactdedup, langid, mixing, simhash
from ledgerline.session import discard, scratch_path, scratch_scope

SHINGLE_WORDS, RADIUS = 3, 3
MIX_WEIGHTS, MIX_SEED = [5, 2, 1], 42
VOCABULARY = "byte_bpe_50k.json"
#: Share of the words and pairs that op9's encoder remembers; the executors' JVMs have grown by the last stage.
REMEMBER = 0.2
BATCH_ROWS, ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def small_batches(spark: SparkSession) -> None:
    """Whole rows go through Python workers here, so fewer of them at a time.  ``run`` puts the setting back."""
    spark.conf.set(BATCH_ROWS, ROWS_PER_BATCH)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; the field learns from two thirds of those that name one.

    Only ``und`` goes.  The score is not asked: it says how much of a text is in one language, so it is low in clean mixed texts.
    """
    small_batches(spark)
    learn = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1, F.lit(True))
    found = langid.identify(docs, learn, carry=docs.columns)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space the one with the smallest id."""
    return exactdedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked fingerprints' documents the one with the smallest id."""
    return simhash.keep_representatives(docs, words=SHINGLE_WORDS, radius=RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs, MIX_WEIGHTS, seed=MIX_SEED)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, packed as little-endian 32-bit integers, and the digest of the text they decode to."""
    small_batches(spark)
    return bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), outputs=["n_tokens", "ids", "decoded_sha256"], remember=REMEMBER)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The field, the fingerprints and the encoder are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder.

    A stage's rows, and whatever it kept in the shared folder, are deleted once the next stage is written; the last
    rows stay, since the result reads them.  The session's batch size is put back.
    """
    rows, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    batch_rows = spark.conf.get(BATCH_ROWS)
    try:
        for name, stage in STAGES:
            path = scratch_path(spark, f"pipeline-{name}")
            with scratch_scope(spark):
                done = stage(spark, rows, sf_dir)
                done.write.parquet(path)
            if before:
                discard(spark, before)
            rows, before = spark.read.schema(done.schema).parquet(path), path
    finally:
        spark.conf.set(BATCH_ROWS, batch_rows)
    return rows

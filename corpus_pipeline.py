"""From raw documents to token ids: five stages, each reading what its predecessor kept.

Documents whose language cannot be told go; lines that many documents share stay in one of them; of
near copies one document stays; sources are mixed to their target weights; what is left is encoded,
decoded again and summed up. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import bpe, langid
from postlens.llm.common import saved
from postlens.llm.lines import line_dedup
from postlens.llm.mixing import mixed_documents
from postlens.llm.simhash import simhash_dedup

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language, which becomes their ``lang``; null and letterless texts go.

    Scores share one among all learned languages, so a low one is no reason to drop a text. Learned from
    the stage's own labelled rows; if it has none, nothing can be told and nothing goes.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs
    made = langid.identify(docs, model)
    return made.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that at least three documents share; documents left without text go."""
    made = line_dedup(docs)
    kept = made.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text")))
    return _counted(kept.where((F.col("n_dropped") == 0) | (F.col("kept_text") != "")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id."""
    return simhash_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights; a document's text holds the words that the mix takes of it."""
    return _counted(mixed_documents(docs), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its source, language, token count and digests of the ids and of what they decode to."""
    made = bpe.digests(docs.select("doc_id", "source", "lang", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return made.select("doc_id", "source", "lang", "n_tokens", "ids_sha256", "decoded_sha256")


def _counted(made: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew where there is one."""
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


STAGES = [
    ("language ID", language_id),
    ("line dedup", shared_lines),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", mixture),
    ("byte-level BPE", encoding),
]
#: Learned language models, XXH64 fingerprints, seeded draws and BPE have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each keeps is written to the checkpoint folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to token ids: toxicity, near-duplicates, repeated passages, mixing, encoding.

Each stage takes what its predecessor kept, and all but the last return the columns of
``documents``.  SQL can't express the regression of the first stage nor the merges of the last,
so there is no SQL twin; tests hold ``run`` against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import bpe, mixing, near_dedup, substring_dedup, toxicity
from tallyforge.llm.common import cut, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Rows that go to a Python worker at once, unless the session says otherwise: documents are long, and JVM and worker both hold a batch.
BATCH_ROWS = 2000


def _sized(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # Spark's own default
        spark.conf.set(name, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted to the labels of this input, does not reject."""
    _sized(spark)
    return toxicity.grade_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("not toxic").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five words, similarity 0.8."""
    _sized(spark)
    gone = near_dedup.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 20 words or more that stand earlier; white space elsewhere stays."""
    _sized(spark)
    left = substring_dedup.remove_repeated(docs.select(*COLUMNS), window=20, reflow=False)
    return left.select("doc_id", F.when(F.col("text").isNotNull(), F.col("kept_text")).alias("text"), "lang", "source", F.length(F.when(F.col("text").isNotNull(), F.col("kept_text"))).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights follow tempered marginals of source, language and topic."""
    return mixing.mix(mixing.describe(docs.select(*COLUMNS)), power=0.7, keep=0.8).where("sampled").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    _sized(spark)
    return bpe.encode(docs, VOCABULARY).select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

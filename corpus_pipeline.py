"""A corpus pipeline of five stages: toxicity, near-duplicates, secrets, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and
reads it back as the next stage's ``docs``. All stages but the last return the columns of ``documents``.

Defined cases: a null text is clean, in no group of near-duplicates, without secrets, and of size 0, so that the mix
may take it without adding words; repeated rows count as one from the second stage on; null sources are a source of their own; further columns, of any
name, go through to the last stage; a table without rows, or without labels, gives no rows or rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import bpe, common, minhash, mixture, secrets, toxicity

#: SQL cannot express a trained model or a token encoder; the stages are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject; the model learns from the labels of this stage's documents."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    judged = toxicity.severity(docs, model)
    return judged.where(~F.col(judged.columns[-1])).select(*docs.columns)  # its own column, however it had to be named


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return minhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets that are not widely copied replaced in the text; ``n_chars`` follows the text."""
    source = F.coalesce("source", F.lit("\0"))
    redacted = secrets.redact(docs, F.concat_ws("/", source, F.coalesce("lang", F.lit("\0"))), F.col("source"))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else redacted


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to source weights takes them (none to three times)."""
    return mixture.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    return bpe.encode(docs, bpe.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

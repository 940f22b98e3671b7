"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next.

Toxic documents go, one document of each near-duplicate group stays, secrets are redacted, and what is left is packed
into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import jaccard, packing, secrets, toxicity
from corvane.llm.common import fresh, materialize, table
from corvane.plans.stages import release, released


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the first grade of severity; the model learns from the labels of those that are here. Rows with
    null or empty texts stay, as do rows that repeat one that stays; columns that clash with names of the operator stay
    as they are. No documents: no rows; no labels: all rows."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the one with
    the least doc_id. Rows that repeat a doc_id are kept or dropped together unless they repeat it in one group, where
    one stays; a row with a null doc_id stays only where no other of its group has an id."""
    return jaccard.one_of_each(docs, k=5, per_cent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in them replaced by the name of their kind, and n_chars counted anew where texts changed."""
    before = fresh(docs, "_before")
    out = secrets.redact(docs.withColumn(before, F.length("text")))
    changed = F.col(before) != F.length("text")
    out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
    return out.select(*[F.col(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document, with its place in a sequence of at most 1024 tokens. A null or empty text is one
    piece, its end mark; rows that repeat a doc_id are documents of their own; other columns play no part. No documents:
    no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages learn, link, score and pack in ways that SQL cannot express; a test runs them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows of the last. What a stage has written goes when the next is done with it."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        keep: list[str] = []
        with released(keep):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep)
        if last:
            release(spark, last)
        last = keep[0]
    return docs

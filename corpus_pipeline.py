"""A training-data pipeline over ``documents``: each stage is one of the operators, applied to all that its predecessor kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
documents.  Results are written and read again between stages.  Empty tables, null and empty texts,
repeated rows and extra columns pass through as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekiln.llm import bpe, line_dedup, minhash, mixing, toxicity
from lorekiln.llm.common import materialize, release, table


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, after texts have changed."""
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score stays below the threshold; lexicon and model are learned from this input and ``labels``."""
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    columns = docs.columns
    named = docs.toDF(*[f"_{k}" for k in range(len(columns))]).withColumn("text", F.col(f"_{columns.index('text')}"))
    scored = toxicity.score(named, lexicon, keep=tuple(named.columns[:-1]))
    return scored.where(F.col("score") < toxicity.REJECT_FROM).select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(columns)])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the lines that many documents share."""
    return _recounted(line_dedup.dedup_lines(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by shingles of five words."""
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: what it takes of each document, a row for each epoch."""
    return _recounted(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text, with digests of the ids and of the decoded bytes."""
    return bpe.round_trip(docs, keep=("doc_id", "source"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Toxicity scoring and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        release(*written)  # what the stage before wrote
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

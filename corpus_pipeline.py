"""A corpus pipeline: toxic documents go, one document of each near-duplicate group stays, sources are mixed to their
target weights, and the mix is packed into sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; run() writes each result to
the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioframe.llm import lshforest, mixing, packing, toxicity
from folioframe.llm.common import Scratch, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier does not call toxic; it learns from sf_dir's labels.

    Defined cases: null text is empty and has the score of a text without features, which is clean; equal texts go or
    stay together; without a toxic label all rows stay; an empty table gives no rows; other columns pass through."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh(docs, "score")
    return toxicity.score_documents(docs, model, name).filter(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest doc_id, null the last.

    Defined cases: rows are told apart by doc_id and text, so those that share a doc_id may go one by one; all rows
    without words are one group; of rows equal in both one stays, the first by a hash of its columns; an empty table
    gives no rows; other columns pass through."""
    return lshforest.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it.

    Defined cases: null text has size 0, and a row of size 0 the whole part of its source's copies; null source is a
    source of its own; repeated rows are decided one by one; an empty table gives no rows; other columns pass through."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences that hold every row.

    Defined cases: null and empty texts have only the end id; repeated rows are packed one by one; an empty table gives
    no rows; other columns are left out."""
    return packing.digest(packing.pack_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No stage can be told in SQL: a trained classifier, hashed signatures, random rounding and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each one's rows written to the shared folder and read again. An empty table of
    documents gives no rows."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs

"""A training corpus from raw documents: STAGES in order, each written as Parquet and read again as the next one's docs.

All stages but the last return the columns of documents. A document is kept as it is unless a stage says otherwise:
toxicity drops what the grammar rejects, near_duplicates keeps the least doc_id of each group, decontamination drops what
holds a benchmark passage, secrets replaces secrets in the text, packing lays out what is left in bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import core, decontaminate, minhash, packing, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without toxic ones. Insults are learned from the labels; null and empty texts are kept, repeated rows judged each, no rows give none."""
    return toxicity.keep_clean(docs, core.read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near duplicates. Rows without words or id stay; rows of one doc_id stay or go together; no rows give none."""
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark passage. Null and empty texts stay, repeated rows are judged each, no rows give none."""
    return decontaminate.keep_clean(docs, core.read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All of docs, with secrets in the text replaced. Null and empty texts stay as they are, repeated rows are redacted each, no rows give none."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs and their bins. Null and empty texts have none, repeated rows and rows without id are packed each, no rows give none; texts of any length are cut."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the signatures, the suffix arrays or the packing; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the whole table of documents."""
    docs = core.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = core.written(stage(spark, docs, sf_dir))
    return docs

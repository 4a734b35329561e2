"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents, whatever their names. ``run`` writes what a stage keeps to the shared folder before the next one
reads it. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import jaccard, mixing, packing, pii, quality
from attesta.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the quality threshold go. Null and empty texts score like a text without words, repeated rows alike; without a label nothing goes."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.keep(docs, quality.fit(docs.select("doc_id", "text"), labels))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with shingle sets of Jaccard similarity 0.8 or more one stays, repeated rows included. Rows without words or without an id stay."""
    return jaccard.deduplicate(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; null and empty texts stay as they are."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources, a null one among them, are brought to their target weights: whole epochs, then a weighted sample. Rows without words go."""
    return mixing.apply(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row for each piece of a document; repeated rows are packed each by itself, a null id stays null."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", personal_data_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, "stage")
    return docs

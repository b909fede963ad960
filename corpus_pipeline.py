"""Preparing a training corpus: quality, near duplicates, personal data, mixing, packing.

Each stage takes all that the one before it kept, as a table, and its decisions take effect: rejected documents and
duplicates go, personal data is replaced, documents stand as often as the mix takes them, and the last stage gives the
pieces of packed sequences with their token ids, ready to train on. SQL can't express the stages; tests hold each against
plain versions on small inputs.

Rows with null ids and repeated rows: near-dedup leaves one row of each group of near copies, those with an id first, so
equal rows are one after it; null texts are empty, and empty texts are copies of one another. Null sources are a source.
Empty tables give no rows. More columns of documents stay as they are up to packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorelink.llm import mixing, neardup, packing, pii, quality
from lorelink.llm.common import learning_rows, shared_path, table
from lorelink.llm.queries import TOKENIZER


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, learnt from the labels that aren't held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(learning_rows(F.col("doc_id"), 5, 0))
    return quality.keep_good(docs, quality.train(docs, labels))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs sharing 80 % or more of their five-word shingles make, that with the least id.

    SimHash links come first; an exact join of shingles adds the many pairs that 64 bits miss at this similarity.
    """
    return neardup.one_of_each(docs, share=0.8, width=5)


def redacted_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets, n_chars of changed texts set anew."""
    return pii.redact(docs, pii.train(docs))


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as a mix of 150 % of all words takes them, sources weighing 3, 1, 2 in turn."""
    return mixing.mixed(docs)


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and their places in sequences of 2,048 tokens."""
    return packing.pack(docs, TOKENIZER, 2048, with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", distinct_documents),
    ("pii", redacted_documents),
    ("mixing", mixed_documents),
    ("best-fit packing", packed_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

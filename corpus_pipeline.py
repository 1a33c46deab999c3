"""A corpus pipeline: quality, exact copies, near copies, mixing by source, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import exact_dedup, mixing, near_dedup, packing, quality
from loomspan.llm.common import drop_written, scratch, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; rows aren't moved.

    A null or empty text has the score of a text without bytes; rows that repeat fare alike. Without labels every
    score is 0.5, so every row goes. An empty table stays empty, here and in each other stage.
    """
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z the row with the largest doc_id stays.

    Null counts as empty, a null doc_id as the smallest; of rows that share id and text one stays.
    """
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays, of rows that share it one.

    A text without words (or null) is near none and stays; a null doc_id is greater than any other here.
    """
    return near_dedup.without_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a document taken twice is two rows.

    A null source is a source of its own; a text without words is taken as often as its source's certain copies say.
    Rows that repeat are documents of their own.
    """
    return mixing.mixed_rows(docs, mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document, see ``packing.pack``; a null or empty text has the end id only."""
    import public_tokenizers

    return packing.pack(docs, str(public_tokenizers.path("byte_bpe_50k.json")), 1024)


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents in ``sf_dir``.

    Each stage's result is written; the tables that a stage writes for itself, and the result before, are deleted with its end.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            new = written(stage(spark, docs, sf_dir), keep=True)
        if k:
            drop_written(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)

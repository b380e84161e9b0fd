"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.llm import linededup, packing, quality, secrets, simhash
from rillstone.llm.common import dropped, written
from rillstone.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling of the quality classifier selects."""
    return quality.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds."""
    return as_documents(linededup.dedup_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in their texts."""
    return as_documents(secrets.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed(docs, vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: Tokens, sketches and sampling are beyond SQL; tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written as Parquet and read again; one is removed when the next is written.

    Null texts count as empty in every stage and stay null between them. Rows
    with a null id neither lose lines nor are anyone's copies, and are packed
    like others. Of rows that share an id all stay or go together, but for the
    quality stage, which looks at each. Ties of keys are all kept. Nulls in lang,
    source and n_chars are carried; n_chars is counted anew where a text
    changes, and other columns of documents are left behind. Empty tables give
    no rows; without labels every document passes the quality stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

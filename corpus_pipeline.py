"""A training corpus from raw documents: quality, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platen.llm import mixing, packing, pii, quality_rules, simhash
from platen.llm.common import checkpoint_dir
from platen.llm.queries import word_tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules pass; rows are judged one by one, a null or empty text fails.

    Columns of ``docs`` stay as they are, here and in all stages but the last,
    whatever they are called; an empty table gives an empty one in every stage.
    """
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of five-word shingles at least 0.8).

    Null and empty texts are copies of each other. Of rows equal in id and text the first by their other columns stays.
    """
    return simhash.keep_one(docs, shingle=5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; a null text stays null.

    ``n_chars``, if there is such a column, is counted anew.
    """
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights in full.

    Rows of scarce cells come out several times: without, the targets would leave few tokens.
    Rows of equal doc_id share one draw; rows without a word stay once, they weigh nothing.
    """
    return mixing.keep_rows(docs, repeat=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of at most 4096 tokens; a null text is an empty document."""
    return packing.pack(docs, word_tokenizer())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packed", packed),
]

#: Tokenising and tagging have no SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents.

    Each stage's table is removed when the next one is written; the last stage
    keeps what it needs in the checkpoint folder.
    """
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{before}"), True)
        before = name
    out = STAGES[-1][1](spark, docs, sf_dir)
    files.delete(path, True)  # its pieces are checkpointed
    return out

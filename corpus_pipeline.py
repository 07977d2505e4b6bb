"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last returns the columns
of its docs. run() applies them to documents, each stage's output written as Parquet and reread.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact, jaccard, mixing, quality
from tessera.llm.common import free_name, table

#: Shingle width and least similarity in percent of the near-duplicate stage.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "_score")
    return quality.scored(docs, model, score).filter(F.col(score) >= quality.THRESHOLD).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.keep_one(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id."""
    return jaccard.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.copied(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, ids_sha256, decoded_sha256), one for each row of docs."""
    return bpe.encoded(docs, *bpe.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", encode_bpe),
]

#: The classifier and the rounding of copies are not expressed in SQL.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, on whatever file system it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; intermediate tables go to the shared checkpoint folder, until the next one is written."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="pipeline-")
    folder = f"{shared.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}_{name}")
            docs = spark.read.parquet(path)
            if before:
                _delete(spark, before)
            before = path
    return docs

"""A training corpus from documents: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it again for the next stage.  All but the last return the
columns of documents.  Nulls, empty and repeated rows are treated as the operators state.  Every row is kept or
dropped by the verdict on itself, so rows without an id or with a repeated one are judged like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill.llm import decontaminate, language_id, near_dedup, packing, quality
from motifmill.llm.common import short_batches, table, written
from motifmill.llm.queries import tokenizer_file

#: SQL can express neither the trained models nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def unflagged(judged: DataFrame, flag: str, docs: DataFrame) -> DataFrame:
    """The rows that are not flagged, with the columns of docs."""
    return judged.filter(~F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: none is found, or the text is unlike its best one."""
    return unflagged(language_id.learnt_and_judged(docs), "__rejected", docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier and their sites judge not clean."""
    return unflagged(quality.judged(docs, table(spark, sf_dir, "labels")), "__rejected", docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, one of smallest id."""
    return near_dedup.deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return unflagged(decontaminate.flagged(docs, table(spark, sf_dir, "benchmark")), "__contaminated", docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language ID", language),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs

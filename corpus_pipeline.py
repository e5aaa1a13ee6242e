"""Corpus pipeline: toxicity, language ID, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of their input, rows dropped and nothing else changed. Every stage learns from the documents it is given.

Defined cases, for all stages: texts may be null, empty or very long; rows may repeat; tables may be empty; columns
beyond doc_id, text and lang pass through under any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm.common import fresh, own_tables, work_path, write_freed
from strandloom.llm.langid import identify, language_dictionaries
from strandloom.llm.near_duplicates import keep_one
from strandloom.llm.packing import pack
from strandloom.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is below 0.5; learned from those of ``docs`` that ``labels`` marks."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").select("doc_id", "toxic")
    model = fit_toxicity(docs.select("doc_id", "text").join(labels, "doc_id"))
    score = fresh(docs, "toxicity_score")
    scored = score_toxicity(docs, model, keep=tuple(docs.columns), score_col=score)
    return scored.where(F.col(score) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin."""
    dictionaries = language_dictionaries(docs, F.lit(True))
    names = (fresh(docs, "told_lang"), fresh(docs, "told_score"), fresh(docs, "told_accepted"))
    told = identify(docs, dictionaries, keep=tuple(docs.columns), names=names)
    return told.where(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates.

    Operator 8 with the settings of a near-duplicate stage: 256-bit SimHash over 5-word shingles, compared in tiles within
    a radius that holds texts of a Jaccard similarity of 0.8, links verified by whole sets at 0.8 or more.
    """
    return keep_one(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every document left."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash", drop_near_duplicates),
    ("packing", pack_documents),
]

#: Trees, compression and SimHash are beyond SQL; tests/llm compares each stage with a plain recomputation instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet in the shared folder and read again.

    A stage's own work tables are deleted once its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        with own_tables(spark):
            rows = stage(spark, docs, sf_dir)
            write_freed(rows, path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return docs

"""A corpus pipeline of five stages over the documents table.

Each stage takes what its predecessor kept and returns documents again (the last one
returns packed pieces); ``run`` writes every step as Parquet to the shared folder and
goes on from the written table, so a lost executor costs tasks, not stages.  The stages
set the session's Arrow batches to at most 1,000 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import decontam, language, minmax, packing, pii
from tallyloom.llm.common import modest_batches, read, stored

SURE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and texts for which no language has at least half of the probability.

    Where no document has a language to learn from, only the letters are asked for.
    """
    modest_batches(spark)
    model, share = language.train(docs)
    if not model:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    judged = language.predict(docs, model, share, into=("_stage_lang", "_stage_score"))
    return judged.where((F.col("_stage_lang") != "und") & (F.col("_stage_score") >= SURE)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each group linked by five-word shingles at 0.8; rows without id stay."""
    modest_batches(spark)
    groups = minmax.near_duplicates(docs, size=5, percent=80)
    return docs.join(groups.where(~F.col("kept")).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    modest_batches(spark)
    leaks = decontam.overlaps(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind; n_chars counts the new text."""
    modest_batches(spark)
    model, cut = pii.train(docs)
    out = pii.redact(docs, model, cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens."""
    modest_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# SQL has neither trained models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

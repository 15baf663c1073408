"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Every stage but the last returns the columns of documents; ``run`` applies them with a table in the shared folder
between stages, so that a lost executor costs one stage's tasks at most. What a stage wrote on its way, and the table
of the stage before, are deleted once its own table is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import decontaminate, jaccard_join, line_dedup, quality_fm, source_mix
from cargolens.llm.shared import dropped, settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are judged as any."""
    return quality_fm.keep_quality(docs, quality_fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from texts; a document of which nothing but white space is left, goes.

    A null text, and one that had nothing but white space before, stays as it is.
    """
    cut = line_dedup.dedup_lines(docs, short_repeats=True)
    kept = cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one of the smallest doc_id, null last.

    Rows are told apart by doc_id and text, so that a row that shares its doc_id with a copy stays if its own text is no
    copy. Of rows that agree in both, one stays. Texts without words are near to none: all their rows stay.
    """
    digest = F.xxhash64("text")
    keyed = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", digest.alias("digest")).alias("key"), "text")
    near = jaccard_join.join_similar(keyed, "key")
    judged = near.where("n_shingles > 0").groupBy("key").agg(F.max(F.expr("key <> component_id")).alias("gone"), F.count("*").alias("rows"))
    judged = judged.where("gone or rows > 1").select(F.col("key.doc_id").alias("__doc_id"), F.col("key.digest").alias("__digest"), "gone")
    met = docs.withColumn("__row", digest).join(judged, F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("__row") == F.col("__digest")), "left")
    repeated = met.where("not gone").dropDuplicates(["__doc_id", "__digest"])
    return met.where("gone is null").unionByName(repeated).select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; rows that share their doc_id with one go too, as they are one document."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target and taken."""
    return source_mix.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("source_mix", mix_stage),
]
#: Trained models and edit distances of lines have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        if i:
            dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)

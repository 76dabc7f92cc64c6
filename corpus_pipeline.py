"""Corpus pipeline: documents through quality, line dedup, near-copy groups, source mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneguard.llm.line_dedup import dedup_lines
from laneguard.llm.mixing import mix_sources
from laneguard.llm.ngram_join import ngram_components
from laneguard.llm.packing import pack_documents
from laneguard.llm.quality import score_quality
from laneguard.llm.queries import domain_of, weights_table
from laneguard.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).filter("predicted = 1").drop("score", "predicted")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat earlier ones within two edits. A document that had text and has none left goes;
    one that came without text (null, empty or white space) stays."""
    had = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    kept = dedup_lines(docs.withColumn("__had", had)).filter((~F.col("__had")) | F.col("text").rlike(r"\S")).drop("n_lines", "n_removed", "__had")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents with a similarity of 0.8 over five-word shingles. Rows without words,
    or without an id, stay."""
    groups = ngram_components(docs, k=5, num=80, den=100)
    copies = materialize(groups.filter("doc_id != component_id").select("doc_id").distinct(), "near-copies")  # of known size: if few, no text is shuffled
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that target weights choose from nine tenths of all tokens, none more than once."""
    chosen = mix_sources(docs, weights_table(spark), domain_of(), budget_share=(9, 10), max_epochs=1).filter("epochs > 0").select(F.col("doc_id").alias("chosen")).distinct()
    return docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["chosen"]), "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1,024 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_copies", near_copies), ("mix_sources", mix), ("packing", pack)]
ORACLE_SQL = None  # the first stage is a fitted model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

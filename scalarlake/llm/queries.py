"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarlake.llm.bwt import repeated_bytes
from scalarlake.llm.common import count_words
from scalarlake.llm.decontaminate import match, report
from scalarlake.llm.exact import exact_groups
from scalarlake.llm.html import extract
from scalarlake.llm.lines import dedup_report
from scalarlake.llm.minhash import near_duplicates
from scalarlake.llm.mixing import mix_sources
from scalarlake.llm.negatives import hard_negatives
from scalarlake.llm.quality import quality
from scalarlake.llm.topk import top_inner_products
from scalarlake.llm.warc import archive_round_trip
from scalarlake.llm.whitening import whiten
from scalarlake.llm.windows import repeated_windows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampling weight by document: 1 for good ones, 0.25 for bad ones."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return labels.select(F.col("doc_id").alias("label_id"), F.when(F.col("q") == 1, 1.0).otherwise(0.25).alias("weight"))


def mixed(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) of docs, weighted by their label; 0.5 without one.

    Words are counted where texts are read; texts go no further.
    """
    slim = docs.select("doc_id", "source", count_words(F.col("text")).alias("words"))
    rows = slim.join(label_quality(spark, sf_dir), F.col("doc_id") == F.col("label_id"), "left")
    rows = rows.select("doc_id", "source", "words", F.coalesce("weight", F.lit(0.5)).alias("weight"))
    return mix_sources(rows, F.col("weight"), F.col("words")).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", "taken")


def op1_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(match(docs, table(spark, sf_dir, "benchmark")))


def op2_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_warc(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark, sf_dir):
    return dedup_report(table(spark, sf_dir, "documents"))


def op6_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op7_suffix_dedup(spark, sf_dir):
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op8_mixing(spark, sf_dir):
    return mixed(spark, sf_dir, table(spark, sf_dir, "documents")).drop("epochs")


def op9_substring_dedup(spark, sf_dir):
    return repeated_windows(table(spark, sf_dir, "documents")).drop("kept")


def op10_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_top_inner_products(spark, sf_dir):
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, positives=5, negatives=5,
                          low=80, high=100, scale=256, label=moved)


def op13_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"), most=4, scale=256).drop("deviation_digits")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_html_extraction": op2_html_extraction,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_warc": op4_warc,
    "op5_line_dedup": op5_line_dedup,
    "op6_minhash": op6_minhash,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_top_inner_products": op11_top_inner_products,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_whitening": op13_whitening,
}

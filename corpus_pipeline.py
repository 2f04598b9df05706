"""Documents to a training mix: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scalarlake.llm.common import count_words, keep
from scalarlake.llm.decontaminate import remove_spans
from scalarlake.llm.lines import drop_lines
from scalarlake.llm.minhash import one_of_each
from scalarlake.llm.quality import quality
from scalarlake.llm.queries import mixed, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.7 or more; others go.  Null and empty texts are scored like any."""
    names = ["doc_id", "text"]
    # The other columns travel as one, so that none is taken for a result of the classifier.
    others = F.struct(*[F.col(f"`{n}`") for n in docs.columns if n not in names]).alias("others")
    kept = quality(docs.select(*names, others), table(spark, sf_dir, "labels")).where("predicted = 1")
    return kept.select(*[F.col(n) if n in names else F.col(f"others.`{n}`").alias(n) for n in docs.columns])


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows the text that a stage has changed."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines stay once; documents of which nothing is left go."""
    return _counted(drop_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Exactly one row of a group stays, also where rows repeat an id or have none.  Texts without words are in no group
    and stay.
    """
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are more than half such passages go."""
    return _counted(remove_spans(docs, table(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (epochs) and how many words (taken).

    Rows that repeat id, source and size are taken alike.  Columns of docs named like those of the mix are replaced.
    """
    added = ["size", "source_size", "target", "epochs", "taken"]
    mix = mixed(spark, sf_dir, docs).groupBy("doc_id", "source", "size").agg(
        F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.max("epochs").alias("epochs"),
        F.max("taken").alias("taken")).where("epochs > 0").alias("mix")
    rows = docs.drop(*added).alias("docs")
    alike = (F.col("docs.doc_id").eqNullSafe(F.col("mix.doc_id")) & F.col("docs.source").eqNullSafe(F.col("mix.source"))
             & (count_words(F.col("docs.text")) == F.col("mix.size")))
    return rows.join(mix, alike).select("docs.*", *[f"mix.{n}" for n in added])


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: SQL expresses neither the classifier nor SimHash and MinHash; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

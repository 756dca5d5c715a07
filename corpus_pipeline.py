"""A corpus pipeline from the operators in ``cellmap.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmap.llm import cotraining, near_copies, packing
from cellmap.llm import quality_rules as rules
from cellmap.llm.common import join_by_key, settle
from cellmap.llm.exact_dedup import content_sort_dedup
from cellmap.llm.queries import WORD_BPE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifiers reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.classify(docs, labels).filter("kept").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.quality_rules(docs, labels).filter("kept").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts one document stays."""
    return content_sort_dedup(docs, kept_only=True).filter("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies one document stays: that with the smallest identifier, null after all others, then the first of equal rows.

    Rows are decided one by one, so repeated identifiers don't matter. Null, empty and blank texts are copies of each other.
    An empty table gives an empty table, and columns of any name are carried.
    """
    rows = settle(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("no")), "rows")
    of = near_copies.near_copies(rows.select("no", "doc.text"), "no", "text").withColumnRenamed("node", "no")
    members = of.unionByName(of.select(F.col("root").alias("no"), "root").distinct())
    members = settle(members.join(rows.select("no", F.col("doc.doc_id").alias("id")), "no"), "members")
    best = members.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("no").alias("c"))).alias("best"))
    gone = join_by_key(members, best.select("root", F.col("best.c").alias("stays")), "root").filter("no <> stays").select("no")
    return rows.join(gone, "no", "left_anti").select("doc.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in as few sequences as the packing can."""
    return packing.pack(docs, WORD_BPE)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The learned stages, the fingerprints and the packing can't be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

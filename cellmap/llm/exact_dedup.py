"""Exact deduplication by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over their normalised bytes and sorted
externally by those bytes within each partition, so that equal texts lie next to each other. An
aggregate that streams over the sorted rows compares each text with its neighbour's in full
and holds one row at a time, however many are equal. The splitters see the first bytes of the
normalised text and then its digest: the sample that Spark gathers for them stays small however
long the texts are, and texts that share a long beginning still spread over partitions.

A text with very many copies would fill one range. Such texts are found first by a
pre-aggregated count of digests; their rows get a salt behind the content key, so that
the splitters cut through the group. Each salted piece is then sorted and compared as
usual, and a second, small content sort over one row a piece joins the pieces again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, delete_chars, n_partitions, settle

PREFIX_CHARS = 48


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return delete_chars(F.coalesce(text, F.lit("")), SPACES)


def content_sort_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = True,
    kept_only: bool = False,
) -> DataFrame:
    """Group rows of equal normalised text.

    Returns one row per input row (with ``kept_only`` only the rows that stay):
    ``<id_col>``, ``keep_id``, ``group_size`` (long), ``kept``, ``text_sha256`` and, with
    ``carry``, ``row``: a struct of all input columns, so that no name can clash.

    Of equal texts the row with the most code points in the original text stays, then the
    smallest identifier; a null identifier comes after all others. Rows that are equal in
    all this still leave exactly one. A null text counts as empty; empty texts form one
    group. A text of any length is compared whole. An empty table gives an empty table.
    """
    spark = df.sparkSession
    n = n_partitions(spark)
    whole = F.struct(*[df[c] for c in df.columns])
    text = F.col("_row")[text_col] if carry else F.col("_text")
    # Each text is normalised for its digest once; the settled row numbers name a row for good.
    base = settle(
        df.select(F.col(id_col).alias("_id"), (whole.alias("_row") if carry else F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
        .withColumn("_sha", F.sha2(normalised(text), 256)).withColumn("_len", F.length(F.coalesce(text, F.lit("")))).withColumn("_start", F.substring(normalised(text), 1, PREFIX_CHARS))
        .withColumn("_no", F.monotonically_increasing_id()),
        "rows",
    )

    # Digests with so many rows that they would burden one range: at most 4 n of them.
    share = max(64, base.count() // (4 * n))
    hot = base.groupBy("_sha").agg(F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > share).collect()
    if hot:
        table = spark.createDataFrame([(r["_sha"], -(-r["_copies"] // share)) for r in hot], "_sha string, _pieces long")
        salted = base.join(F.broadcast(table), "_sha", "left").withColumn("_pieces", F.coalesce("_pieces", F.lit(1)))
    else:
        salted = base.withColumn("_pieces", F.lit(1).cast("long"))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("_no"), F.col("_pieces")))

    # The best row of each run of equal texts: the longest original, then the least identifier.
    order = [(-F.col("_len")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("id"), F.col("_no").alias("no")]
    best = F.min(F.struct(*order, *([F.col("_row").alias("row")] if kept_only and carry else []))).alias("_best")
    runs = (
        salted.repartitionByRange("_start", "_sha", "_salt")
        .withColumn("_norm", normalised(text))
        .groupBy("_start", "_norm", "_sha", "_salt", "_pieces").agg(best, F.count(F.lit(1)).alias("_n"))
    )
    if hot:
        runs = settle(runs.withColumn("_norm", F.when(F.col("_pieces") > 1, F.col("_norm"))), "runs")
        # One row a piece: fewer than 8 n rows, whatever the size of the table.
        joined = runs.filter("_pieces > 1").groupBy("_sha", "_norm").agg(F.max("_pieces").alias("_pieces"), F.min("_best").alias("_best"), F.sum("_n").alias("_n"))
        runs = runs.filter("_pieces = 1").select("_sha", "_salt", "_best", "_n").unionByName(
            joined.withColumn("_salt", F.lit(0).cast("long") if kept_only else F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).select("_sha", "_salt", "_best", "_n")
        )
    if kept_only:
        row = [F.col("_best.row").alias("row")] if carry else []
        return runs.select(F.col("_best.id").alias(id_col), F.col("_best.id").alias("keep_id"), F.col("_n").cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"), *row)
    row = ["_row"] if carry else []
    found = salted.select("_id", "_sha", "_salt", "_no", *row).join(runs.select("_sha", "_salt", "_best", "_n"), ["_sha", "_salt"])
    return found.select(
        F.col("_id").alias(id_col), F.col("_best.id").alias("keep_id"), F.col("_n").cast("long").alias("group_size"),
        (F.col("_no") == F.col("_best.no")).alias("kept"), F.col("_sha").alias("text_sha256"), *[F.col(c).alias("row") for c in row],
    )

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word rule in this package, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"

_local_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is ``spark.checkpoint.dir``. Only a local master may run without that setting; it
    then gets one temporary folder a session.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dir:
        _local_dir[app] = "file://" + tempfile.mkdtemp(prefix="cellmap-shared-")
    return _local_dir[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/cellmap/{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors. Columns keep their names,
    types and order.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Let the driver find out which shuffles nothing refers to any more; their files are deleted."""
    spark._jvm.System.gc()


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more, and those of finished shuffles.

    Only tables of which all that is left has been settled anew may go.
    """
    spark = df.sparkSession
    if files := df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    forget_shuffles(spark)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete_chars(text: Column, chars: str) -> Column:
    """``text`` without any of ``chars``; plain byte searches, no regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def one_space(text: Column) -> Column:
    """``text`` with every white-space character replaced by a blank."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def smallest_hashed(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """The ``most`` rows whose hashed identifiers are smallest; ``df`` has each identifier once.

    In a large table, rows that are surely too large go before the sort, so that one task
    sees about twice ``most`` rows however many there are.
    """
    h, n = F.xxhash64(id_col), df.count()
    if n > 8 * most:
        df = df.filter(h < F.lit(-(1 << 63) + int((1 << 64) * (2 * most + 200) / n)))
    return df.orderBy(h, id_col).limit(most)


def strings(words: pa.Array) -> list[str]:
    """An array of words without white space as a list; one long text is cheaper to hand over than each word."""
    if not len(words):
        return []
    whole = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
    return pc.binary_join(whole, " ")[0].as_py().split(" ")


def blocks(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, of about ``most_bytes`` bytes of text each; a longer text is a range of its own."""
    upto, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(upto):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
        yield at, end
        pa.default_memory_pool().release_unused()
        at = end


#: Tables of slim rows up to this size are joined plainly: even as one key they are a small task.
FEW = 65_536


def join_by_key(rows: DataFrame, facts: DataFrame, key: str, total: int | None = None, counted: DataFrame | None = None, salt: list[str] | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has each key once, however many rows share a key.

    Keys with more than a fair share of the rows (at most four a shuffle partition) get pieces: their
    rows are dealt over the pieces by a hash (of the columns ``salt``, or all), and their fact goes to each.
    Only those keys are broadcast. ``total`` is the number of rows, if known; ``counted`` a cheaper table of the
    same keys, or one that has their numbers as ``n``.
    """
    of = rows if counted is None else counted
    total = of.count() if total is None else total
    if total <= FEW:
        return rows.join(facts, key)
    share = total // (4 * n_partitions(rows.sparkSession)) + 1
    numbers = of.select(key, F.col("n").alias("_n")) if counted is not None and "n" in counted.columns else of.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = numbers.filter(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("int").alias("_pieces"))
    pieces = F.coalesce("_pieces", F.lit(1))
    left = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*(salt or rows.columns)), pieces).cast("int")).drop("_pieces")
    right = facts.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return left.join(right, [key, "_salt"]).drop("_salt")

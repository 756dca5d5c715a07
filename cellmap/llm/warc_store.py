"""Content-addressed WARC archive.

An archive is a folder with three tables:

``payloads``  one row per distinct payload: its SHA-256 digest, the bytes, their number and
              base32 SHA-1, and the record that carries it. Equality of all copies
              is verified byte by byte (least and greatest copy of a digest must agree) when
              the table is written. It is bucketed by digest, so that reading joins it
              without moving payloads; the number of buckets follows from the bytes.
``headers``   one row per record: the exact bytes ahead of the payload (WARC and HTTP header),
              by record type. A revisit carries no payload, as the WARC 1.1 profile
              ``identical-payload-digest`` has it.
``manifest``  one row: the number of buckets and the limit below which payloads never revisit.

Original records come back through a join of headers and payloads by digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, n_partitions, settle

DATE = "2024-01-01T00:00:00Z"
#: Fixed values of WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BYTES_A_BUCKET = 128 << 20


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 SHA-1: each five hexadecimal digits are four base32 digits."""
    sha = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(sha, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _record_name(page: Column, url: Column, digest: Column, copy: Column) -> Column:
    """A name of its own for each record: page, a digest of URL and payload digest, and the number among equal rows."""
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring(F.sha2(F.concat(digest, url), 256), 1, 24), F.lit(":"), copy.cast("string"))


def _store(pages: DataFrame) -> DataFrame:
    """One row per digest; a group's copies collapse ahead of the shuffle, so a payload moves about once."""
    best = F.max(F.struct("page", "url")).alias("best")
    return pages.groupBy("digest").agg(F.max("payload").alias("payload"), F.min("payload").alias("least"), best)


def write_archive(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Write one record per row of ``df``.

    A null payload is empty, and so is a null URL. Of the records with equal payloads of at least
    ``least_bytes`` bytes, that with the largest identifier (then the greatest URL, then the first of
    equal rows) is the response and the others revisit it; smaller payloads are all responses.
    Null identifiers come last. Repeated rows are records of their own. Carriage returns and line feeds
    in URLs are percent-encoded. Other columns don't matter. An empty table gives an empty archive.
    A payload of any length is stored whole.
    """
    spark = df.sparkSession
    n = n_partitions(spark)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    pages = df.select(F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    slim = settle(pages.select("page", "url", "digest", F.octet_length("payload").cast("long").alias("n_bytes")), "records")
    size = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()
    buckets = max(n, -(-size["b"] // BYTES_A_BUCKET))

    # Payloads with very many copies collapse by pieces first, or one task would get a copy from every task before it.
    share = max(64, size["n"] // (4 * n))
    hot = F.broadcast(slim.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > share).select("digest"))
    cold = _store(pages.join(hot, "digest", "left_anti"))
    some = pages.join(hot, "digest").withColumn("piece", F.pmod(F.xxhash64("page", "url"), F.lit(4 * n)))
    some = some.groupBy("digest", "piece").agg(F.max("payload").alias("payload"), F.min("payload").alias("least"), F.max(F.struct("page", "url")).alias("best"))
    some = some.groupBy("digest").agg(F.max("payload").alias("payload"), F.min("least").alias("least"), F.max("best").alias("best"))
    store = cold.unionByName(some).select(
        "digest",
        F.when(F.col("payload") == F.col("least"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("binary")).alias("payload"),
        F.octet_length("payload").cast("long").alias("n_bytes"),
        base32_sha1(F.col("payload")).alias("sha1"),
        F.col("best.page").alias("best_page"), F.col("best.url").alias("best_url"),
    )
    name = f"payloads_{uuid.uuid4().hex}"
    store.write.option("compression", "zstd").option("path", f"{path}/payloads").bucketBy(buckets, "digest").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    facts = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").drop("payload")

    rows = slim.groupBy("page", "url", "digest").agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    rows = join_by_key(rows, facts, "digest", size["n"])
    is_best = F.col("page").eqNullSafe(F.col("best_page")) & (F.col("url") == F.col("best_url")) & (F.col("copy") == 1)
    rows = rows.withColumn("record_type", F.when(is_best | (F.col("n_bytes") < least_bytes), "response").otherwise("revisit"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF * 2))
    block = F.length(http) + F.when(F.col("record_type") == "response", F.col("n_bytes")).otherwise(0)
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), "record_type",
        F.lit(f"{CRLF}WARC-Record-ID: <"), _record_name(F.col("page"), F.col("url"), F.col("digest"), F.col("copy")), F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}WARC-Target-URI: "), url,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), "sha1",
        F.when(F.col("record_type") == "revisit", F.concat(F.lit(f"{CRLF}WARC-Refers-To: <"), _record_name(F.col("best_page"), F.col("best_url"), F.col("digest"), F.lit(1)), F.lit(f">{CRLF}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), block.cast("string"), F.lit(CRLF * 2), http,
    )
    rows.select("digest", header.cast("binary").alias("header"), "record_type").write.option("compression", "zstd").partitionBy("record_type").parquet(f"{path}/headers")
    spark.createDataFrame([(buckets, least_bytes)], "buckets int, least_bytes long").coalesce(1).write.parquet(f"{path}/manifest")


PAYLOADS = "digest string, payload binary, n_bytes long, sha1 string, best_page long, best_url string"


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    n = spark.read.parquet(f"{path}/manifest").first()["buckets"]
    name = f"payloads_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({PAYLOADS}) "
        f"USING parquet CLUSTERED BY (digest) INTO {n} BUCKETS LOCATION '{path}/payloads'"
    )
    found = spark.table(name)
    found.schema  # resolved now, so that the catalog can forget the name; the files stay
    spark.sql(f"DROP TABLE {name}")
    return found


def _headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest string, header binary, record_type string").parquet(f"{path}/headers")


def original_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record in full, revisits with the payload that they stand for: ``digest``, ``record_type``, ``header``, ``payload``.

    The join is by digest; Spark splits the headers of a payload with very many revisits.
    """
    payloads = spark.read.parquet(f"{path}/payloads").select("digest", "payload")
    return _headers(spark, path).join(payloads, "digest").select("digest", "record_type", "header", "payload")


def _parse(header: bytes) -> tuple[dict[bytes, bytes], int]:
    """Fields of a WARC header, and where its block begins."""
    end = header.index(b"\r\n\r\n")
    lines = header[:end].split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError("not a WARC 1.1 record")
    return dict(x.split(b": ", 1) for x in lines[1:]), end + 4


def _page(name: bytes) -> int | None:
    page = name.split(b":")[2]
    return None if page == b"none" else int(page)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k.split()[0]: [] for k in READ.split(", ")}
        for header, payload, n_bytes, sha1 in zip(*(batch.column(c).to_pylist() for c in ("header", "payload", "n_bytes", "sha1")), strict=True):
            kind = _parse(header)[0][b"WARC-Type"]
            record = header + (payload if kind == b"response" else b"") + b"\r\n\r\n"
            fields, at = _parse(record)
            size = int(fields[b"Content-Length"])
            block = record[at : at + size]
            if len(block) != size or record[at + size :] != b"\r\n\r\n":
                raise ValueError("a record's length is wrong")
            if kind == b"response":
                content = block[block.index(b"\r\n\r\n") + 4 :]
                n_bytes, sha1 = len(content), base64.b32encode(hashlib.sha1(content).digest()).decode()
            if fields[b"WARC-Payload-Digest"] != b"sha1:" + sha1.encode():
                raise ValueError("a payload's digest is wrong")
            out["page_id"].append(_page(fields[b"WARC-Record-ID"][1:-1]))
            out["payload_bytes"].append(n_bytes)
            out["payload_digest"].append(sha1)
            out["record_type"].append(kind.decode())
            out["refers_to"].append(_page(fields[b"WARC-Refers-To"][1:-1]) if kind == b"revisit" else None)
            out["url"].append(fields[b"WARC-Target-URI"].decode())
        types = {"long": pa.int64(), "string": pa.string()}
        yield pa.RecordBatch.from_arrays([pa.array(out[k.split()[0]], types[k.split()[1]]) for k in READ.split(", ")], names=list(out))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Read every record back and verify it.

    Response records are rebuilt from header and payload (a join of distinct digests, payloads
    stay in their buckets) and parsed whole: length and digest are checked. Revisit records
    are parsed, and take size and digest of the full payload from the facts of its verified
    copy; that join moves small rows only. Returns the columns of ``READ``.
    """
    headers, payloads = _headers(spark, path), _payloads(spark, path)
    columns = ["header", "payload", "n_bytes", "sha1"]
    responses = headers.filter("record_type = 'response'").join(payloads, "digest").select(*columns)
    facts = spark.read.schema(PAYLOADS).parquet(f"{path}/payloads").select("digest", "n_bytes", "sha1")
    revisits = join_by_key(headers.filter("record_type = 'revisit'").select("digest", "header"), facts, "digest").select("header", F.lit(None).cast("binary").alias("payload"), "n_bytes", "sha1")
    return responses.unionByName(revisits).mapInArrow(_read_back, READ)

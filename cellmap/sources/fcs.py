"""FCS 3.x files (list mode, single precision) as a Spark data source.

Rows have a fixed width, so partitions are near-equal row ranges over all files and every
task reads just its byte ranges. Files may be anywhere that pyarrow's file systems reach.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .naming import channel_table, clean_names, marker_names
from .slicing import Slice, file_ranges, slices_of
from .spill import find_spillover

ROWS_A_BATCH = 65_536


def open_file(path: str) -> BinaryIO:
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:"), "rb")


def parse_text(segment: bytes) -> dict[str, str]:
    """Keywords of a TEXT segment; its first character delimits, and stands for itself if doubled."""
    text = segment.decode("utf-8", "replace")
    if not text:
        return {}
    mark, parts, part, i = text[0], [], "", 1
    while i < len(text):
        if text[i] != mark:
            part += text[i]
        elif text[i + 1 : i + 2] == mark:
            part += mark
            i += 1
        else:
            parts.append(part)
            part = ""
        i += 1
    return {k.strip().upper() if k.strip().startswith("$") else k.strip(): v for k, v in zip(parts[::2], parts[1::2], strict=False)}


def read_header(path: str) -> tuple[dict[str, tuple[int, int]], dict[str, str]]:
    """Byte ranges of the segments (both ends included) and the keywords; no data is read."""
    with open_file(path) as f:
        head = f.read(58)
        if head[:3] != b"FCS":
            raise ValueError(f"{path} is not an FCS file")
        numbers = [int(head[10 + 8 * i : 18 + 8 * i].strip() or 0) for i in range(6)]
        offsets = {name: (numbers[2 * i], numbers[2 * i + 1]) for i, name in enumerate(("text", "data", "analysis"))}

        def segment(first: int, last: int) -> dict[str, str]:
            f.seek(first)
            return parse_text(f.read(last - first + 1))

        keywords = segment(*offsets["text"])
        more = int(keywords.get("$BEGINSTEXT", "0") or 0), int(keywords.get("$ENDSTEXT", "0") or 0)
        if more[1] > more[0] > 0 and more != offsets["text"]:
            keywords |= segment(*more)
    return offsets, keywords


def fcs_size(offsets: dict[str, tuple[int, int]], keywords: dict[str, str]) -> tuple[int, int]:
    """Rows and channels. Only single precision is read; ranges that don't agree are warned of."""
    if keywords.get("$DATATYPE", "").strip() != "F":
        raise ValueError("only FCS files of data type F can be read")
    rows, channels = int(keywords["$TOT"]), int(keywords["$PAR"])
    first, last = offsets["data"]
    if first and last:
        if last - first not in (rows * channels * 4, rows * channels * 4 - 1):
            warnings.warn("the data range in the header doesn't agree with $TOT and $PAR", stacklevel=2)
        if (int(keywords.get("$BEGINDATA", first)), int(keywords.get("$ENDDATA", last))) != (first, last):
            warnings.warn("the data range in the header doesn't agree with $BEGINDATA and $ENDDATA", stacklevel=2)
    return rows, channels


def fcs_sizes(paths: list[str]) -> list[int]:
    return [fcs_size(*read_header(p))[0] for p in paths]


def column_names(keywords: dict[str, str]) -> list[str]:
    """Cleaned readable names of the channels, in order."""
    return clean_names(marker_names(channel_table(keywords))[1])


def read_rows(path: str, first: int, n: int, compensated: bool = True) -> Iterator[np.ndarray]:
    """Rows from ``first`` (from 0), in blocks, as double precision."""
    offsets, keywords = read_header(path)
    _, channels = fcs_size(offsets, keywords)
    begin = offsets["data"][0] or int(keywords["$BEGINDATA"])
    kind = np.dtype("<f4" if keywords.get("$BYTEORD", "1,2,3,4").replace(" ", "").startswith("1,") else ">f4")
    spill, place = find_spillover(keywords) if compensated else None, []
    if spill:
        raw = marker_names(channel_table(keywords))[0]
        if missing := [x for x in spill[0] if x not in raw]:
            raise ValueError(f"spillover names unknown channels: {missing}")
        place, inverse = [raw.index(x) for x in spill[0]], np.linalg.inv(spill[1])
    with open_file(path) as f:
        f.seek(begin + first * channels * 4)
        while n > 0:
            rows = min(n, ROWS_A_BATCH)
            data = np.frombuffer(f.read(rows * channels * 4), kind)
            if len(data) != rows * channels:
                raise ValueError(f"{path} ends early")
            x = data.reshape(rows, channels).astype(np.float64)
            if spill:
                x[:, place] = x[:, place] @ inverse
            yield x
            n -= rows


def load_fcs(path: str, apply_compensation: bool = True) -> tuple[dict[str, str], np.ndarray]:
    """Keywords and the whole matrix of one file, on the driver."""
    offsets, keywords = read_header(path)
    rows, channels = fcs_size(offsets, keywords)
    parts = list(read_rows(path, 0, rows, apply_compensation))
    return keywords, np.concatenate(parts) if parts else np.zeros((0, channels))


class _Range(InputPartition):
    def __init__(self, ranges: list[tuple[int, int, int]]):
        super().__init__(ranges)
        self.ranges = ranges


class FcsSource(DataSource):
    """Options: ``path`` or ``paths`` (a JSON list), ``compensate`` (true), ``columns`` (comma-separated), ``slices`` (8), ``fileIndex`` (true)."""

    @classmethod
    def name(cls) -> str:
        return "fcs"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]

    def _columns(self) -> list[str]:
        have = column_names(read_header(self._paths()[0])[1])
        if "columns" not in self.options:
            return have
        asked = [c.strip() for c in self.options["columns"].split(",")]
        if missing := [c for c in asked if c not in have]:
            raise ValueError(f"no such channels: {missing}")
        return asked

    def schema(self) -> StructType:
        fields = [StructField(c, DoubleType()) for c in self._columns()]
        return StructType([*fields, StructField("file_idx", IntegerType())] if self.options.get("fileIndex", "true").lower() == "true" else fields)

    def reader(self, schema: StructType) -> FcsReader:
        return FcsReader(self._paths(), schema.names, self.options.get("compensate", "true").lower() == "true", int(self.options.get("slices", "8")))


class FcsReader(DataSourceReader):
    def __init__(self, paths: list[str], names: list[str], compensated: bool, slices: int):
        self.paths, self.names, self.compensated, self.slices = paths, names, compensated, slices

    def partitions(self) -> list[_Range]:
        sizes = fcs_sizes(self.paths)
        ranges = [file_ranges(s, sizes) for s in slices_of(sizes, max(1, min(self.slices, sum(sizes))))]
        return [_Range(r) for r in ranges]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for file, first, n in partition.ranges:
            path = self.paths[file - 1]
            have = column_names(read_header(path)[1])
            wanted = [c for c in self.names if c != "file_idx"]
            if missing := [c for c in wanted if c not in have]:
                raise ValueError(f"{path} lacks channels: {missing}")
            for x in read_rows(path, first, n, self.compensated):
                columns = [pa.array(x[:, have.index(c)]) if c != "file_idx" else pa.array(np.full(len(x), file, np.int32)) for c in self.names]
                yield pa.RecordBatch.from_arrays(columns, names=self.names)


def read_fcs(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, compensate: bool = True, slices: int | None = None) -> DataFrame:
    """Files as one DataFrame with ``file_idx`` (from 1), in ``slices`` near-equal partitions."""
    spark.dataSource.register(FcsSource)
    reader = spark.read.format("fcs").option("paths", json.dumps([paths] if isinstance(paths, str) else list(paths))).option("compensate", str(compensate).lower())
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.option("slices", str(slices or spark.sparkContext.defaultParallelism)).load()


def select_fcs_columns(names: list[str]):
    """A hook for ``DataFrame.transform``: these columns in this order (and the file's number)."""
    def hook(df: DataFrame) -> DataFrame:
        if missing := [n for n in names if n not in df.columns]:
            raise ValueError(f"no such channels: {missing}")
        return df.select(*names, *[c for c in df.columns if c == "file_idx"])

    return hook


def file_vector(spark: SparkSession, sizes: list[int], slices: int) -> DataFrame:
    """``row`` (from 0) and ``file_idx`` (from 1) of files of the given sizes, in ``slices`` near-equal partitions."""
    starts = np.cumsum([0, *sizes[:-1]]).tolist() if sizes else []
    which = F.lit(0)
    for i, at in enumerate(starts):  # the last start that isn't beyond the row
        which = F.when(F.col("row") >= at, F.lit(i + 1)).otherwise(which)
    return spark.range(0, sum(sizes), 1, max(1, slices)).select(F.col("id").alias("row")).withColumn("file_idx", which.cast("int"))


__all__ = ["FcsSource", "Slice", "column_names", "fcs_size", "fcs_sizes", "file_vector", "load_fcs", "read_fcs", "read_header", "read_rows", "select_fcs_columns"]

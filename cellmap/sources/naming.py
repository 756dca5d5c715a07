"""Channel metadata and column names of cytometry files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def clean_names(names: Sequence[str]) -> list[str]:
    """Names that are safe as columns: no dashes, no leading digit, no repeats (``_2``, ``_3``, ... are added)."""
    out: list[str] = []
    for name in names:
        name = name.replace("-", "_")
        if name[:1].isnumeric():
            name = "_" + name
        free, k = name, 1
        while free in out:
            k += 1
            free = f"{name}_{k}"
        out.append(free)
    return out


def channel_table(keywords: dict[str, str]) -> list[dict[str, str]]:
    """One entry per channel with every ``$P<n><property>``; properties sorted, missing ones empty."""
    found = [(int(m[1]), m[2], v) for k, v in keywords.items() if (m := re.fullmatch(r"\$P(\d+)(.+)", k))]
    properties = sorted({p for _, p, _ in found})
    table = [dict.fromkeys(properties, "") for _ in range(int(keywords["$PAR"].strip()))]
    for channel, p, v in found:
        if 1 <= channel <= len(table):
            table[channel - 1][p] = v
    return table


def metadata_frame(spark: SparkSession, keywords: dict[str, str]) -> DataFrame:
    """``channel_table`` as a DataFrame, with the channel's number."""
    table = channel_table(keywords)
    columns = sorted({k for r in table for k in r})
    return spark.createDataFrame([(i + 1, *(r[c] for c in columns)) for i, r in enumerate(table)], ", ".join(["channel int", *(f"`{c}` string" for c in columns)]))


def marker_names(table: list[dict[str, str]]) -> tuple[list[str], list[str]]:
    """Raw names, and readable ones: the stain's name where there is one, as it stands."""
    raw = [r["N"] for r in table]
    return raw, [r["S"] if r.get("S", "").strip() else r["N"] for r in table]

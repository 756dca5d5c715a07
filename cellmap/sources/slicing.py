"""Near-equal contiguous slices of the rows of several files."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np


class Slice(NamedTuple):
    """First and last row, by file and place in it; all from 1, ends included."""

    start_file: int
    start_off: int
    final_file: int
    final_off: int


def slices_of(lengths: Sequence[int], slices: int) -> list[Slice]:
    """Cut files of the given lengths, one behind the other, into ``slices`` parts that differ by a row at most.

    The first parts are the longer ones. A part without rows ends one row ahead of its start.
    """
    if slices < 1:
        raise ValueError("at least one slice is needed")
    upto = list(itertools.accumulate(lengths))
    total = upto[-1] if upto else 0
    least, longer = divmod(total, slices)

    def place(row: int) -> tuple[int, int]:  # row from 0
        f = bisect.bisect_right(upto, row)
        return f + 1, row - (upto[f - 1] if f else 0) + 1

    out, at = [], 0
    for s in range(slices):
        n = least + (s < longer)
        if n:
            out.append(Slice(*place(at), *place(at + n - 1)))
        else:
            f, off = place(at) if at < total else (max(1, len(lengths)), (lengths[-1] if lengths else 0) + 1)
            out.append(Slice(f, off, f, off - 1))
        at += n
    return out


def file_ranges(s: Slice, lengths: Sequence[int]) -> list[tuple[int, int, int]]:
    """The slice as (file, first row, rows), files from 1 and rows from 0; files without rows in it are left out."""
    out = []
    for f in range(s.start_file, s.final_file + 1):
        first = s.start_off - 1 if f == s.start_file else 0
        last = s.final_off if f == s.final_file else lengths[f - 1]
        if last > first:
            out.append((f, first, last - first))
    return out


def collect_slice(load: Callable[[int, int, int], np.ndarray], s: Slice, lengths: Sequence[int]) -> np.ndarray | None:
    """A slice's rows (or entries), from a loader of (file, first row, rows) that reads no more than asked for."""
    parts = [load(*r) for r in file_ranges(s, lengths)]
    return np.concatenate(parts) if parts else None

"""Exact quantiles of expanding and sliding frames, in n log n steps a series.

Spark's ``percentile`` over a frame sorts the frame again at every row, so an expanding frame costs the square of a series.
Here all frames of a series are answered together by a wavelet matrix over the ranks of its values: level by level, from the
highest bit of a rank to the lowest, values are parted by that bit (in their order), and every query follows its frame to
the side that holds the order statistic it asks for. A level is a few passes of numpy over the series, and only one level
is held at a time.

Values between two order statistics are interpolated linearly, as ``percentile`` does it. Nulls are skipped.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType


def order_statistics(values: np.ndarray, begin: np.ndarray, end: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The ``nth`` smallest (from 0) of values[begin:end], for each query; frames must hold that many."""
    n = len(values)
    sorted_values = np.sort(values)
    order = np.argsort(values, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    begin, end, left = begin.astype(np.int64), end.astype(np.int64), nth.astype(np.int64)
    found = np.zeros(len(begin), np.int64)
    for bit in range(max(0, n - 1).bit_length() - 1, -1, -1):
        high = (rank >> bit) & 1
        ones = np.concatenate([[0], np.cumsum(high)])
        zeros = n - ones[-1]
        low_begin, low_end = begin - ones[begin], end - ones[end]
        up = left >= low_end - low_begin
        left = np.where(up, left - (low_end - low_begin), left)
        begin, end = np.where(up, zeros + ones[begin], low_begin), np.where(up, zeros + ones[end], low_end)
        found |= np.where(up, 1 << bit, 0)
        rank = np.concatenate([rank[high == 0], rank[high == 1]])
    return sorted_values[found]


def frame_quantiles(values: np.ndarray, start: int | None, end: int, shares: Sequence[float], at_least: int = 1) -> np.ndarray:
    """len(values) x len(shares): quantiles over the rows i + start .. i + end (all from the first on, if ``start`` is None).

    Missing values are NaN; frames with fewer than ``at_least`` values give NaN.
    """
    n = len(values)
    out = np.full((n, len(shares)), np.nan)
    there = np.isfinite(values)
    count = np.concatenate([[0], np.cumsum(there)])
    i = np.arange(n)
    a = np.zeros(n, np.int64) if start is None else count[np.clip(i + start, 0, n)]
    b = count[np.clip(i + end + 1, 0, n)]
    rows = np.flatnonzero(b - a >= max(1, at_least))
    a, b, own = a[rows], b[rows], values[there]
    for k, share in enumerate(shares):
        place = (b - a - 1) * share
        low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
        x, y = np.split(order_statistics(own, np.tile(a, 2), np.tile(b, 2), np.concatenate([low, high])), 2)
        out[rows, k] = np.where(low == high, x, (high - place) * x + (place - low) * y)
    return out


def with_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], start: int | None, end: int, at_least: int = 1, date: str = "date", out: str = "_q") -> DataFrame:
    """``df`` with an array of the quantiles of ``value`` over each row's frame; null with fewer than ``at_least`` values.

    Series are dealt to all shuffle partitions. Without keys, sliding frames are taken range by range (``scan``); an expanding
    one needs all that came before, so there the table is one task.
    """
    from . import scan
    from .learn import dealt

    shares = [float(s) for s in shares]
    if not keys and start is not None:
        return scan.in_ranges(df, keys, date, lambda x, k: with_quantiles(x, k, value, shares, start, end, at_least, date, out), -start, max(0, end))
    names = df.columns

    def add(table: pa.Table) -> pa.Table:
        order = pc.array_sort_indices(table[date].combine_chunks(), order="ascending", null_placement="at_start").to_numpy()
        own = table[value].cast(pa.float64()).combine_chunks().fill_null(np.nan).to_numpy(zero_copy_only=False)
        found = np.empty((len(own), len(shares)))
        found[order] = frame_quantiles(own[order], start, end, shares, at_least)
        none = np.isnan(found[:, 0])
        cut = np.arange(0, found.size + 1, len(shares), dtype=np.int32)
        return table.select(names).append_column(out, pa.ListArray.from_arrays(pa.array(cut), pa.array(found.ravel()), mask=pa.array(none)))

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(DoubleType()))])
    return dealt(df, keys).applyInArrow(add, schema)

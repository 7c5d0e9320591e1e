"""Edit distances over batches of pairs: every step of the dynamic programme is one numpy operation for all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kindred.functions.shipping import ship

#: Cells of the tables filled at once.
CELLS = 4_000_000


def udf(kernel: Callable):
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(batched(kernel, a.tolist(), b.tolist()), dtype="float64")

    return distance


def batched(kernel: Callable, a: list[str | None], b: list[str | None]) -> np.ndarray:
    """kernel over pairs of similar lengths together; nan for a pair with a null."""
    out = np.full(len(a), np.nan)
    sizes = [(len(x), len(y), i) for i, (x, y) in enumerate(zip(a, b, strict=True)) if isinstance(x, str) and isinstance(y, str)]
    sizes.sort()
    first = 0
    while first < len(sizes):
        last, m, n = first, 0, 0
        while last < len(sizes):
            m2, n2 = max(m, sizes[last][0]), max(n, sizes[last][1])
            if last > first and (last - first + 1) * (m2 + 2) * (n2 + 2) > CELLS:
                break
            m, n, last = m2, n2, last + 1
        at = [i for *_, i in sizes[first:last]]
        out[at] = kernel(_codes([a[i] for i in at], m, -1), _codes([b[i] for i in at], n, -2), np.array([len(a[i]) for i in at]), np.array([len(b[i]) for i in at]))
        first = last
    return out


def _codes(names: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(names), width), pad, np.int32)
    for i, s in enumerate(names):
        if s:
            out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le"), np.int32)
    return out


def osa(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edits and swaps of neighbours, no substring edited twice."""
    n, (wa, wb) = len(a), (a.shape[1], b.shape[1])
    out = np.where(la == 0, lb, 0).astype(float)
    rows = np.arange(n)
    before, row = None, np.broadcast_to(np.arange(wb + 1), (n, wb + 1)).copy()
    for i in range(1, wa + 1):
        new = np.empty_like(row)
        new[:, 0] = i
        for j in range(1, wb + 1):
            unlike = a[:, i - 1] != b[:, j - 1]
            best = np.minimum(np.minimum(row[:, j], new[:, j - 1]) + 1, row[:, j - 1] + unlike)
            if i > 1 and j > 1:
                swap = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                best = np.where(swap, np.minimum(best, before[:, j - 2] + 1), best)
            new[:, j] = best
        before, row = row, new
        done = la == i
        out[done] = row[rows[done], lb[done]]
    return out


def dl(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Damerau and Levenshtein's distance without that restriction."""
    n, (wa, wb) = len(a), (a.shape[1], b.shape[1])
    rows, big = np.arange(n), wa + wb + 5
    table = np.full((n, wa + 2, wb + 2), big, np.int32)  # shifted by one: the first row and column are the border
    table[:, 1, 1:] = np.arange(wb + 1)
    table[:, 1:, 1] = np.arange(wa + 1)
    seen = np.zeros((n, wb), np.int64)  # last row before this one whose letter is b's
    for i in range(1, wa + 1):
        column = np.zeros(n, np.int64)  # last column before this one whose letter is a's
        for j in range(1, wb + 1):
            same = a[:, i - 1] == b[:, j - 1]
            best = np.minimum(np.minimum(table[:, i, j + 1], table[:, i + 1, j]) + 1, table[:, i, j] + ~same)
            k = seen[:, j - 1]
            swap = table[rows, k, column] + (i - k - 1) + 1 + (j - column - 1)
            table[:, i + 1, j + 1] = np.where((k > 0) & (column > 0), np.minimum(best, swap), best)
            column = np.where(same, j, column)
        seen = np.where(a[:, i - 1 : i] == b, i, seen)
    return table[rows, la + 1, lb + 1].astype(float)


def lcs(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Letters outside the longest common subsequence, of both names."""
    n, (wa, wb) = len(a), (a.shape[1], b.shape[1])
    row = np.zeros((n, wb + 1), np.int32)
    for i in range(1, wa + 1):
        new = np.zeros_like(row)
        for j in range(1, wb + 1):
            new[:, j] = np.where(a[:, i - 1] == b[:, j - 1], row[:, j - 1] + 1, np.maximum(row[:, j], new[:, j - 1]))
        row = new  # padding matches nothing, so that the last row and column hold each pair's own length
    return (la + lb - 2 * row[:, wb]).astype(float)


def jaro(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """1 - Jaro's similarity."""
    n, (wa, wb) = len(a), (a.shape[1], b.shape[1])
    if not wa or not wb:
        return np.where((la == 0) & (lb == 0), 0.0, 1.0)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used, matched = np.zeros((n, wb), bool), np.zeros((n, wa), bool)
    places, rows = np.arange(wb), np.arange(n)
    for i in range(wa):
        free = (a[:, i : i + 1] == b) & ~used & (np.abs(places[None, :] - i) <= reach[:, None])
        hit = free.any(axis=1)
        used[rows[hit], free.argmax(axis=1)[hit]] = True
        matched[:, i] = hit
    m = matched.sum(axis=1)
    width = min(wa, wb)
    left = np.take_along_axis(a, np.argsort(~matched, axis=1, kind="stable"), 1)[:, :width]
    right = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), 1)[:, :width]
    swapped = ((left != right) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1) // 2
    some = np.maximum(m, 1)
    alike = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (some - swapped) / some) / 3
    return np.where((la == 0) & (lb == 0), 0.0, np.where(m == 0, 1.0, 1 - alike))

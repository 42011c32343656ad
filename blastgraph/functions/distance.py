"""Edit distance with adjacent transpositions (optimal string alignment) and a ceiling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Pairs whose tables are filled together.
TOGETHER = 4096


def _codes(names: list[str]) -> np.ndarray:
    """Code points, a row for each string, zeros behind its end."""
    raw = np.array(names, dtype=str)
    return raw.view(np.uint32).reshape(len(names), -1) if raw.dtype.itemsize else np.zeros((len(names), 0), np.uint32)


def _filled(left: np.ndarray, right: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Distances of pairs, row by row of all their tables at once. The step that depends on its left neighbour
    is a running minimum once each column's own cost is taken off."""
    width = int(n.max(initial=0))
    column = np.arange(width + 1, dtype=np.int32)
    before = row = np.broadcast_to(column, (len(left), width + 1))
    out = n.astype(np.int32)  # of empty left strings
    for i in range(1, int(m.max(initial=0)) + 1):
        x = left[:, i - 1, None]
        best = np.empty((len(left), width + 1), np.int32)
        best[:, 0] = i
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (x != right[:, :width]))
        if i > 1 and width > 1:
            swapped = (x == right[:, : width - 1]) & (left[:, i - 2, None] == right[:, 1:width])
            best[:, 2:] = np.where(swapped, np.minimum(best[:, 2:], before[:, :-2] + 1), best[:, 2:])
        before, row = row, np.minimum.accumulate(best - column, axis=1) + column
        done = np.flatnonzero(m == i)
        out[done] = row[done, n[done]]
    return out


def osa(left: list[str], right: list[str], ceiling: int) -> np.ndarray:
    """Distances of pairs of strings, ``ceiling + 1`` where they are larger."""
    m, n = (np.array([len(x) for x in side], np.int64) for side in (left, right))
    out = np.full(len(m), ceiling + 1, np.int32)
    near = np.flatnonzero(abs(m - n) <= ceiling)
    near = near[np.lexsort((m[near], n[near]))]  # tables of a size together
    for at in range(0, len(near), TOGETHER):
        part = near[at : at + TOGETHER]
        table = _filled(_codes([left[i] for i in part]), _codes([right[i] for i in part]), m[part], n[part])
        out[part] = np.minimum(table, ceiling + 1)
    return out


def within_one(a: Column, b: Column) -> Column:
    """Whether two strings differ by at most one edit, natively: levenshtein <= 1, or two
    neighbours swapped in otherwise equal strings."""
    n = F.length(a)
    # Length of the common prefix of strings of one length, from the first place that differs.
    place = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))), True).cast("int")
    swapped = F.concat(F.substr(a, F.lit(1), place - 1), F.substr(a, place + 1, F.lit(1)), F.substr(a, place, F.lit(1)), F.substr(a, place + 2))
    return (F.levenshtein(a, b, 1) >= 0) | ((n == F.length(b)) & (place > 0) & (place < n) & (swapped == b))


def distance(a: Column, b: Column, ceiling: int) -> Column:
    """Distance up to ``ceiling``; native for one edit, Arrow-batched beyond."""
    if ceiling == 1:
        return F.when(a == b, 0).when(within_one(a, b), 1).otherwise(2)

    @F.pandas_udf("int")
    def measured(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(osa(left.tolist(), right.tolist(), ceiling))

    return measured(a, b)

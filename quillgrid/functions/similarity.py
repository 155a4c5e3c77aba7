"""Similarity of names and vectors as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: Column, b: Column) -> Column:
    """2 * LCS / (len a + len b); 0 if either is empty. A substitution counts as two edits.

    The longest common subsequence is a fold over the characters of ``a`` that
    carries one row of the dynamic programme. It stays in the JVM; where pairs
    are many and names long, ``indel_ratio_arrow`` is faster.
    """
    letters, other = F.split(a, ""), F.split(b, "")
    start = F.transform(F.array_append(other, F.lit("")), lambda _: F.lit(0))

    def step(row, x):
        # row[j] holds the LCS with the first j letters of b; the fold builds the next row from left to right.
        return F.aggregate(
            F.sequence(F.lit(1), F.size(other)),
            F.array(F.lit(0)),
            lambda new, j: F.array_append(
                new,
                F.when(F.element_at(other, j) == x, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(new, j), F.element_at(row, j + 1))),
            ),
        )

    lcs = F.element_at(F.aggregate(letters, start, step), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(2.0 * lcs / (F.length(a) + F.length(b)))


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence (Hyyro 2004)."""
    if len(a) < len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return (full ^ v).bit_count()


#: Letters of a text that fit one machine word, and entries that a table of masks may have.
WORD, MASKS = 64, 1 << 22


def _codes(texts: list[str]) -> np.ndarray:
    """Code points, a row a text, zeros after its end."""
    held = np.array(texts, dtype=np.str_)
    return held.view(np.uint32).reshape(len(texts), -1)


def lcs_lengths(xs: list[str], ys: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``lcs_length`` of the pairs (xs[i], ys[j]), all of one to ``WORD`` letters: every pair is a lane of one machine word."""
    x, y = _codes(xs), _codes(ys)
    kinds = max(int(x.max()), int(y.max())) + 1
    if kinds > 256:
        kinds, found = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
        x, y, kinds = found[: x.size].reshape(x.shape), found[x.size :].reshape(y.shape), len(kinds)
    if len(xs) * (kinds + 1) > MASKS and len(i) > 1:
        half = len(i) // 2
        parts = []
        for p, q in ((i[:half], j[:half]), (i[half:], j[half:])):
            (p_at, p), (q_at, q) = (np.unique(v, return_inverse=True) for v in (p, q))
            parts.append(lcs_lengths([xs[k] for k in p_at], [ys[k] for k in q_at], p, q))
        return np.concatenate(parts)
    # The mask of a letter has a bit for each of its places; the last column is of no letter.
    masks = np.zeros((len(xs), kinds + 1), np.uint64)
    x_size, y_size = (np.fromiter(map(len, v), np.int64, len(v)) for v in (xs, ys))
    for k in range(x.shape[1]):
        rows = np.flatnonzero(x_size > k)
        masks[rows, x[rows, k]] |= np.uint64(1 << k)
    y = np.where(np.arange(y.shape[1]) < y_size[:, None], y, kinds).astype(np.int64)
    v = np.full(len(i), np.iinfo(np.uint64).max, np.uint64)
    flat, at = masks.ravel(), i.astype(np.int64) * (kinds + 1)
    for k in range(y.shape[1]):
        u = v & flat[at + y[j, k]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    (i, xs), (j, ys) = ((k, list(v)) for k, v in (pd.factorize(a), pd.factorize(b)))
    out = np.full(len(a), np.nan)
    known = np.flatnonzero((i >= 0) & (j >= 0))
    if not len(known):
        return pd.Series(out)
    i, j = i[known], j[known]
    la, lb = (np.fromiter(map(len, v), np.int64, len(v))[k] for v, k in ((xs, i), (ys, j)))
    common = np.zeros(len(known), np.int64)
    some, fits = (la > 0) & (lb > 0), (la <= WORD) & (lb <= WORD)
    lanes = np.flatnonzero(some & fits)
    if len(lanes):
        (x_at, p), (y_at, q) = (np.unique(v[lanes], return_inverse=True) for v in (i, j))
        common[lanes] = lcs_lengths([xs[k] for k in x_at], [ys[k] for k in y_at], p, q)
    seen: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(some & ~fits).tolist():
        pair = int(i[k]), int(j[k])
        if pair not in seen:
            seen[pair] = lcs_length(xs[pair[0]], ys[pair[1]])
        common[k] = seen[pair]
    out[known] = 2 * common / np.maximum(la + lb, 1)
    return pd.Series(out)


def indel_ratio_arrow(a: Column, b: Column) -> Column:
    """``indel_ratio`` in Arrow batches: names of up to ``WORD`` letters a batch at once, longer ones pair by pair."""
    return F.pandas_udf(_ratios, "double")(a, b)


KINDS = tuple("abcdefghijklmnopqrstuvwxyz ")


def letter_counts(text: Column) -> list[Column]:
    """Counts of each letter a-z, of spaces, and of the rest: a bag for ``bag_bound``. Plain columns, so that joins on them compile."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(k), F.lit(""))) for k in KINDS]
    return [*counts, F.length(F.regexp_replace(text, "[a-z ]", ""))]


def bag_bound(a: Column, b: Column, bag_a: list[Column], bag_b: list[Column]) -> Column:
    """An upper bound of ``indel_ratio``: no common subsequence has more letters than the common bag."""
    common = reduce(lambda s, x: s + x, (F.least(x, y) for x, y in zip(bag_a, bag_b, strict=True)))
    return 2.0 * common / (F.length(a) + F.length(b))


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    n = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))

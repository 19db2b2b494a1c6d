"""Similarity of strings: the normalised indel ratio, 200 x LCS / (len a + len b)."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pricewright.runtime import ship

if TYPE_CHECKING:
    import numpy as np


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 and more positions at a
    time: the row of the table is one integer, a set bit is a step not taken."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio_of(a: str, b: str) -> float:
    """Ratio from 0 to 100; two empty strings are alike."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def ratios(texts: list[str]) -> Callable[[str], np.ndarray]:
    """A function from a text to its indel ratios with all of these, worked out
    side by side: the bit-parallel row of every text is a machine word, and one
    step takes the next character of all texts. Beyond 64 characters the words
    are chained by their carries."""
    import numpy as np

    if not texts:
        return lambda a: np.empty(0)
    sizes = np.array([len(t) for t in texts])
    codes = np.zeros((int(sizes.max(initial=0)), len(texts)), "int64")
    alphabet: dict[str, int] = {}
    for i, t in enumerate(texts):
        for j, ch in enumerate(t):
            codes[j, i] = alphabet.setdefault(ch, len(alphabet) + 1)

    def score(a: str) -> np.ndarray:
        words = max(1, -(-len(a) // 64))
        where = np.zeros((words, len(alphabet) + 1), "uint64")
        for i, ch in enumerate(a):
            if ch in alphabet:
                where[i // 64, alphabet[ch]] |= np.uint64(1 << i % 64)
        rows = np.full((words, len(texts)), ~np.uint64(0), "uint64")
        for step in codes:
            carry = np.zeros(len(texts), "uint64")
            for w in range(words):
                row = rows[w]
                hit = row & where[w][step]
                total = row + hit
                over = total < row
                total += carry
                over |= total < carry
                rows[w] = total | (row - hit)
                carry = over.astype("uint64")
        rest = len(a) - 64 * (words - 1)
        if rest < 64:
            rows[-1] |= ~np.uint64((1 << rest) - 1)
        common = np.bitwise_count(~rows).sum(axis=0, dtype="int64")
        total = sizes + len(a)
        return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))

    return score


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


def indel_ratio(a: Column, b: Column) -> Column:
    """Indel ratio by Arrow batches; null if either side is."""
    ship(SparkSession.active())
    return _ratio(a, b)


def indel_ratio_sql(a: Column, b: Column) -> Column:
    """The same as one native expression, for small inputs: the table's rows
    are folded over the characters of a."""
    chars_b = F.split(b, "")
    zero = F.array_repeat(F.lit(0), F.length(b) + 1)

    def row(prev: Column, ch: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            diag = F.element_at(prev, j) + F.when(F.element_at(chars_b, j) == ch, 1).otherwise(0)
            best = F.greatest(F.element_at(acc, -1), F.element_at(prev, j + 1), diag)
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    lcs = F.element_at(F.aggregate(F.split(a, ""), zero, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(200.0 * lcs / total)


def upper_bound(a: Column, b: Column) -> Column:
    """What the ratio can be at most, from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * F.least(F.length(a), F.length(b)) / total)

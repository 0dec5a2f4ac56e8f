"""Similarity of long texts: numpy in tasks, as an array of a string a character costs many times what a sort of numbers does."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ALONE = np.uint64(1 << 63)
_SPACES = [c for c in range(0x3002) if chr(c).isspace()]
_INK = np.ones(0x3002, bool)  # up to one after the last white space, which stands for all after it
_INK[_SPACES] = False


def points(text: str | None) -> np.ndarray:
    """Code points, white space aside."""
    found = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return found[_INK[np.minimum(found, 0x3001)]]


def bigrams(found: np.ndarray, wide: bool = True) -> np.ndarray:
    """Distinct bigrams of code points, as sorted numbers, of half the size unless ``wide``; a single character is its own only one."""
    if len(found) < 2:
        return found.astype(np.uint64) | _ALONE
    both = np.sort(found[:-1].astype(np.uint64) << np.uint64(32) | found[1:] if wide else found[:-1] << np.uint32(16) | found[1:])
    return both[np.concatenate(([True], both[1:] != both[:-1]))]


def similarity(a: str | None, b: str | None) -> float:
    """As :func:`grainmill.functions.text.jaccard`."""
    x, y = points(a), points(b)
    if not len(x) or not len(y):
        return 0.0
    wide = min(len(x), len(y)) < 2 or max(x.max(), y.max()) > 0xFFFF
    x, y = bigrams(x, wide), bigrams(y, wide)
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(x) + len(y) - shared)


def jaccards(left: Column, right: Column) -> Column:
    """:func:`similarity` of the texts at each place of two arrays. Like all Python functions it cannot stand within a lambda."""

    @F.pandas_udf("array<double>")
    def each(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([[similarity(x, y) for x, y in zip(xs, ys, strict=True)] for xs, ys in zip(a, b, strict=True)], dtype="object")

    return each(left, right)

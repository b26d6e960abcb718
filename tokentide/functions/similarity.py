"""Jaro-Winkler similarity, which Spark lacks: an Arrow-batched UDF, computed for a whole batch of pairs at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, padded by zeros; lengths)."""
    width = max(map(len, words), default=0) or 1
    return np.array(words, f"U{width}").view(np.uint32).reshape(len(words), width), np.fromiter(map(len, words), np.int64, len(words))


def jaro_winkler(first: list[str], second: list[str], scale: float = 0.1, gate: float = 0.7) -> np.ndarray:
    """Jaro similarity of each pair, raised for a common prefix of up to four characters where it is above ``gate``.

    One step takes a character of every first word and gives it the earliest equal character of
    its second word that is free and within reach.
    """
    a, m_a = _codes(first)
    b, m_b = _codes(second)
    rows, places = np.arange(len(a)), np.arange(b.shape[1])
    reach = np.maximum(np.maximum(m_a, m_b) // 2 - 1, 0)
    used_a, used_b = np.zeros(a.shape, bool), np.zeros(b.shape, bool)
    for i in range(a.shape[1]):
        near = (places >= (i - reach)[:, None]) & (places < np.minimum(i + reach + 1, m_b)[:, None])
        free = near & ~used_b & (b == a[:, i : i + 1]) & (i < m_a)[:, None]
        hit = free.any(1)
        used_b[rows[hit], free.argmax(1)[hit]] = True
        used_a[hit, i] = True
    m = used_a.sum(1)
    width = min(a.shape[1], b.shape[1])
    in_order = [np.take_along_axis(x, np.argsort(~used, 1, kind="stable")[:, :width], 1) for x, used in ((a, used_a), (b, used_b))]
    swaps = ((in_order[0] != in_order[1]) & (np.arange(width) < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / m_a + m / m_b + (m - swaps) / m) / 3, 0.0)
    short = min(4, width)
    alike = (a[:, :short] == b[:, :short]) & (np.arange(short) < np.minimum(m_a, m_b)[:, None])
    prefix = np.cumprod(alike, 1).sum(1)
    raised = np.where(jaro > gate, jaro + prefix * scale * (1 - jaro), jaro)
    return np.where([x == y for x, y in zip(first, second)], 1.0, raised)


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if there.any():
        out[there] = jaro_winkler(a[there].tolist(), b[there].tolist())
    return pd.Series(out).where(there, None)

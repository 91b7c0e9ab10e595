"""Token-set similarity of short texts, as a pandas function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over the characters of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit) | (row - hit)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def _ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 * 2 * _common(a, b) / total if total else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: best insert-delete similarity among shared tokens and shared plus own tokens; 0 without tokens."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    shared, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if shared and not (left and right):
        return 100.0
    one, two = " ".join(filter(None, (shared, left))), " ".join(filter(None, (shared, right)))
    best = _ratio(one, two)
    return max(best, _ratio(shared, one), _ratio(shared, two)) if shared else best


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """0 to 100: insert-delete similarity of the sorted tokens."""
    return _ratio(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())))


@F.pandas_udf(T.DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = token_set_ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=float)

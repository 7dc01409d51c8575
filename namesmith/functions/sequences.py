"""Longest common subsequence of two token arrays, as a vectorised UDF.

The recurrence needs a table per pair, which nested higher-order functions can only
build by copying arrays; an Arrow batch of bit-parallel integer steps is far cheaper.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(a, b) -> int:
    """Bit-parallel LCS length: one big-integer update per item of ``b``."""
    where: dict[str, int] = {}
    for i, item in enumerate(a):
        where[item] = where.get(item, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for item in b:
        hit = row & where.get(item, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(
        [None if a is None or b is None else _lcs(a, b) for a, b in zip(left, right)],
        dtype="Int32",
    )

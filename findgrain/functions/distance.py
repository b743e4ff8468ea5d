"""Edit distance with adjacent transpositions, and the equi-join keys that find near words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance on code points: insert, delete, substitute, swap of neighbours, none twice in one place."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        new = [i]
        for j, cb in enumerate(b, 1):
            best = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (ca != cb))
            if i > 1 and j > 1 and ca == b[j - 2] and a[i - 2] == cb:
                best = min(best, before[j - 2] + 1)
            new.append(best)
        before, row = row, new
    return row[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def _one_less(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))


def deletions(s: Column, k: int) -> Column:
    """A word and all its forms with up to ``k`` letters left out. Words within distance k share such a form."""
    level = F.array(s)
    forms = level
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda x: F.length(x) > 0), _one_less)))
        forms = F.concat(forms, level)
    return F.array_distinct(forms)

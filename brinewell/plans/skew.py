"""Equi-joins to a table of unique keys some of which hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in SHARE of all rows is heavy, so there are fewer than SHARE heavy keys at every size.
SHARE = 1000


def join_heavy(rows: DataFrame, side: DataFrame, keys: Sequence[str], weight: str, how: str = "left") -> DataFrame:
    """``rows`` joined to ``side``, which has one row for each key and in ``weight`` the rows of that key.

    The heavy keys' rows meet a broadcast of fewer than SHARE rows where they
    lie, the others are shuffled. Both inputs should be stored tables, as each
    is read twice. Null keys match nothing. ``weight`` is not returned.
    """
    keys = list(keys)
    total = side.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(side.where(F.col(weight) * SHARE > total).drop(weight))
    few = rows.join(heavy, keys)
    rest = rows.join(F.broadcast(side.where(F.col(weight) * SHARE > total).select(*keys)), keys, "left_anti")
    return few.unionByName(rest.join(side.where(F.col(weight) * SHARE <= total).drop(weight), keys, how).select(*few.columns))

"""Deterministic top-k.

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: every task keeps
its own best ``k`` rows and only those reach the final merge, so no global
sort and no unbounded data on one task.  Every ordering ends with the key
columns, so ties come out in one fixed order (the source analysis leaves tie order
unspecified; a fixed one is needed for any comparison).

``ranked_top_k`` numbers those ``k`` rows; only they meet in one task.

``top_k_per_group`` ranks in two steps, the same for every ``k``: within (group,
one of ``BUCKETS`` parts by a hash of the keys), keeping ``k`` of each, then within
the group.  So a group's rows spread over ``BUCKETS`` tasks, and at most
``k * BUCKETS`` of them meet in one, also where ``k`` is above the bound up to which
Spark trims a window's groups by itself (``WindowGroupLimit``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(measure: str, keys: Sequence[str], descending: bool) -> list[Column]:
    first = F.col(measure).desc() if descending else F.col(measure).asc()
    return [first] + [F.col(k).asc_nulls_first() for k in keys]


def top_k(df: DataFrame, k: int, measure: str, keys: Sequence[str], descending: bool = True) -> DataFrame:
    """First ``k`` rows by ``measure`` (desc by default), ties broken by ``keys`` ascending."""
    return df.orderBy(*_order(measure, keys, descending)).limit(k)


#: Parts of a group in the first step.
BUCKETS = 32


def ranked_top_k(df: DataFrame, k: int, measure: str, keys: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """First ``k`` rows with their 1-based ``rank_col``."""
    place = F.row_number().over(Window.orderBy(*_order(measure, keys, True)))
    return top_k(df, k, measure, keys).withColumn(rank_col, place)


def top_k_per_group(df: DataFrame, k: int, group: Sequence[str], measure: str,
                    keys: Sequence[str], rank_col: str = "rank", descending: bool = True) -> DataFrame:
    """First ``k`` rows of each ``group`` with their 1-based ``rank_col``."""
    order = _order(measure, keys, descending)
    part = Window.partitionBy(*group, "_part").orderBy(*order)
    parts = df.withColumn("_part", F.pmod(F.hash(*keys), F.lit(BUCKETS)))
    best = parts.withColumn("_place", F.row_number().over(part)).where(F.col("_place") <= k).drop("_part", "_place")
    w = Window.partitionBy(*group).orderBy(*order)
    return best.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)

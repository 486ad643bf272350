"""Synthetic page views and membership changes: numbers follow from an id, names come from given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _named(rows: DataFrame, number: Column, names: DataFrame, key: str, name: str, out: str) -> DataFrame:
    """``rows`` with column ``out``: the ``name`` of the row of ``names`` whose ``key`` is ``number``."""
    looked_up = names.select(F.col(key).alias("_number"), F.col(name).alias(out))
    return rows.withColumn("_at", number).join(looked_up, F.col("_at") == F.col("_number")).drop("_at", "_number")


def page_views(ids: DataFrame, ident: str, pages: DataFrame, key: str, name: str, n_pages: int, members: int) -> DataFrame:
    """One page view per id; ``pages`` numbers its rows 0 to ``n_pages`` - 1 in column ``key``."""
    i = F.col(ident)
    views = ids.select(i.alias("view_id"), F.pmod(i * i + 3 * i, F.lit(members)).alias("member_id"))
    return _named(views, F.pmod(F.col("view_id") * 17 + 2, F.lit(n_pages)), pages, key, name, "page")


def member_changes(ids: DataFrame, ident: str, groups: DataFrame, key: str, name: str, n_groups: int) -> DataFrame:
    """One membership change per id: the group that the member joins, and a level from 1 to 9."""
    i = F.col(ident)
    changes = ids.select(i.alias("member_id"), (F.pmod(i, F.lit(9)) + 1).alias("level"))
    return _named(changes, F.pmod(F.col("member_id") * 3 + 1, F.lit(n_groups)), groups, key, name, "member_group")

"""Queries again over all of their tables: the older ones take large quantities or late orders alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .change_plans import q_activity_union
from .read_models import q_count_map, q_counts, q_score, q_strict, q_tier
from .registry import SQL, query
from .search_plans import q_filter, q_interleave
from .stand_ins import all_dishes

#: A supplier has some 600 lines, which saturates every score; its branches (by part) have some 37 each.
BRANCHES = 16


def branch_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_dishes(spark, sf_dir).withColumn("restaurant_id", F.col("restaurant_id") * BRANCHES + F.col("l_partkey") % BRANCHES)


def _whole(f):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(spark, sf, rows=all_dishes)

    run.__name__, run.__doc__ = f"{f.__name__}_whole", f.__doc__
    return query(_all_rows(SQL[f.__name__]))(run)


def _all_rows(sql: str) -> str:
    return _swapped(sql, " WHERE l_quantity >= 48)", ")")


def _swapped(sql: str, old: str, new: str) -> str:
    if sql.count(old) != 1:
        raise ValueError(f"not once in the SQL: {old}")
    return sql.replace(old, new)


for _f in (q_counts, q_strict, q_count_map, q_tier, q_filter, q_interleave):
    _whole(_f)

_BRANCH_SQL = _swapped(_swapped(_all_rows(SQL["q_score"]), "l_suppkey AS restaurant_id", f"l_suppkey * {BRANCHES} + l_partkey % {BRANCHES} AS restaurant_id"), "s_suppkey = restaurant_id", f"s_suppkey = restaurant_id // {BRANCHES}")


@query(_BRANCH_SQL)
def q_score_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The composite score of each supplier's branches, and its parts."""
    return q_score(spark, sf, rows=branch_dishes, branches=BRANCHES)


@query(_swapped(SQL["q_activity_union"], " WHERE o_orderdate >= TIMESTAMP '2001-01-01'", ""))
def q_activity_union_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Unlike events as one feed."""
    return q_activity_union(spark, sf, orders_where="true")

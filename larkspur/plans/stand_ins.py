"""The engine's tables as views of the test tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: A large quantity marks a venue's own dishes: without it every venue is saturated.
DISHES_SQL = """dishes AS (
  SELECT l_suppkey AS restaurant_id, l_orderkey, l_linenumber, l_partkey, p_name AS name,
    CASE WHEN s_nationkey % 5 = 0 THEN 'bakery' WHEN s_nationkey % 5 = 1 THEN 'cafe' WHEN s_nationkey % 5 = 2 THEN NULL ELSE 'restaurant' END AS primary_type,
    CASE WHEN p_size % 7 = 0 THEN 'drink' WHEN p_size % 7 = 1 THEN 'dessert' WHEN p_size % 7 = 2 THEN NULL ELSE 'food' END AS category,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'vegan' WHEN l_returnflag = 'A' THEN 'likely_vegan' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'vegan_adaptable'
      WHEN l_returnflag = 'N' THEN 'unclear' ELSE 'not_vegan' END AS verdict,
    1 - 5 * l_discount AS confidence, CASE WHEN l_linenumber <= 2 THEN 'side' WHEN l_linenumber = 3 THEN NULL ELSE 'main' END AS serving_role,
    CASE WHEN l_quantity >= 49.5 THEN 'high' WHEN l_quantity >= 48.5 THEN 'moderate' ELSE 'low' END AS protein_level,
    l_shipdate AS created_at, l_extendedprice, l_quantity, p_size, p_retailprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 48)"""


def dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dishes of large quantity, 6 % of all."""
    return all_dishes(spark, sf_dir).where("l_quantity >= 48")


def all_dishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified dishes: line items, with part and supplier as dish and venue."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    venues = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    kind, size, nation = F.col("l_returnflag"), F.col("p_size") % 7, F.col("s_nationkey") % 5
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(venues, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("restaurant_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("p_name").alias("name"),
        F.when(nation == 0, "bakery").when(nation == 1, "cafe").when(nation == 2, F.lit(None)).otherwise("restaurant").alias("primary_type"),
        F.when(size == 0, "drink").when(size == 1, "dessert").when(size == 2, F.lit(None)).otherwise("food").alias("category"),
        F.when((kind == "A") & (F.col("l_linestatus") == "F"), "vegan").when(kind == "A", "likely_vegan").when((kind == "N") & (F.col("l_linestatus") == "F"), "vegan_adaptable").when(kind == "N", "unclear").otherwise("not_vegan").alias("verdict"),
        (1 - 5 * F.col("l_discount")).alias("confidence"),
        F.when(F.col("l_linenumber") <= 2, "side").when(F.col("l_linenumber") == 3, F.lit(None)).otherwise("main").alias("serving_role"),
        F.when(F.col("l_quantity") >= 49.5, "high").when(F.col("l_quantity") >= 48.5, "moderate").otherwise("low").alias("protein_level"),
        F.col("l_shipdate").alias("created_at"), "l_extendedprice", "l_quantity", "p_size", "p_retailprice",
    )


#: Places of customers and suppliers, from their keys.
PLACE_SQL = "28.5 + ({k} * 37 % 1000) / 2000.0 AS lat, -81.5 + ({k} * 91 % 1000) / 2000.0 AS lng"


def with_place(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumns({"lat": F.lit(28.5) + (k * 37 % 1000) / 2000.0, "lng": F.lit(-81.5) + (k * 91 % 1000) / 2000.0})

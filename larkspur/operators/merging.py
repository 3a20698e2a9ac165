"""Classified dishes that a menu repeats, merged into one.

The order of a menu decides: the first of equal copies keeps its place, tags are united in the order in which they
come.  Every part of that is an aggregate which combines on the map side (a best by a key, a first place of a tag), so a dish
that is repeated by a third of all rows is never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .identity import display_quality, identity_columns

#: Fixed value: how many ingredients a merged dish keeps.
MOST_INGREDIENTS = 8


def merged_dishes(dishes: DataFrame, owner: str = "restaurant_id", place: str = "place") -> DataFrame:
    """The dishes of each owner without copies, in the columns of ``dishes``: owner, place (its order, unique),
    name, price, raw_description, calories, confidence, meal_types, key_ingredients, and any others.

    Copies agree in the identity key (name, price, description and calories, see ``identity_columns``).  Of copies the
    one with the longest description, then the highest confidence, then the earliest, stays, at the place of the earliest, under the
    spelling that is easiest to read (the earliest of equals), with all meal types and the first eight ingredients of all copies.
    What has no copies is left as it is.  Null texts count as empty, null confidence as the lowest, null tags as none.
    """
    names = dishes.columns
    keys = [owner, "k_name", "k_price", "k_desc", "k_cal"]
    rows = identity_columns(dishes)
    early = (-F.col(place)).alias("early")
    best = F.struct(F.coalesce(F.length("raw_description"), F.lit(0)).alias("size"), F.col("confidence"), early)
    spelled = F.struct(display_quality(F.coalesce("name", F.lit(""))).alias("q"), early)
    one = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), best).alias("row"), F.max_by("name", spelled).alias("spelling"), F.min(place).alias("first"), F.count("*").alias("n"))

    def tags(column: str, most: int | None) -> DataFrame:
        each = rows.select(*keys, place, F.posexplode(column).alias("i", "tag")).groupBy(*keys, "tag").agg(F.min(F.struct(place, "i")).alias("at"))
        if most:
            each = each.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where(F.col("r") <= most)
        return each.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]).alias(f"all_{column}"))

    for column, most in (("meal_types", None), ("key_ingredients", MOST_INGREDIENTS)):
        united, on = tags(column, most), F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
        one = one.join(united, on, "left").drop(*[f"{k}_" for k in keys])
    merged = {"name": F.col("spelling"), place: F.col("first"), "meal_types": F.coalesce("all_meal_types", F.array().cast(dishes.schema["meal_types"].dataType)), "key_ingredients": F.coalesce("all_key_ingredients", F.array().cast(dishes.schema["key_ingredients"].dataType))}
    return one.select(*[F.when(F.col("n") > 1, merged[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in merged else F.col(f"row.{c}").alias(c) for c in names])

"""Core tables: columns, defaults of additive migrations, and closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: vocabularies of the data model -----------------------------------------------
VERDICTS = ("vegan", "likely_vegan", "vegan_adaptable", "unclear", "not_vegan")
CATEGORIES = ("food", "drink", "dessert")
VOTES = ("up", "down")
CHANGE_TYPES = ("added", "removed", "price_changed", "verdict_changed")
REPORT_STATUSES = ("open", "resolved")
REVIEW_STATUSES = ("verified", "known_issue")
EXCLUDED_PRIMARY_TYPES = ("convenience_store", "gas_station", "grocery_store", "supermarket", "liquor_store", "pharmacy", "store", "shopping_mall", "pet_care")
DESSERT_VENUE_TYPES = ("ice_cream_shop", "dessert_shop", "dessert_restaurant", "bakery", "donut_shop", "bagel_shop", "cake_shop", "pastry_shop", "chocolate_shop", "chocolate_factory", "candy_store", "confectionery", "frozen_yogurt_shop", "acai_shop")
EDITORIAL_URL = "google:editorial_summary"
# -------------------------------------------------------------------------------------------------

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_A = T.ArrayType(_S)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


RESTAURANTS = _struct(
    id=_L, place_id=_S, name=_S, address=_S, website_url=_S, lat=_D, lng=_D, last_scraped_at=_TS, consumer_hidden=_B, refresh_enabled=_B, archived=_B, serves_vegetarian=_B,
    price_level=_S, primary_type=_S, editorial_summary=_S, rating=_D, user_rating_count=_L, open_now=_B, opening_hours=_A, business_status=_S, last_classified_hash=_S, last_classify_cost=_D,
)
DISHES = _struct(id=_L, restaurant_id=_L, name=_S, raw_description=_S, price=_S, calories=_S, category=_S)
SOURCES = _struct(id=_L, restaurant_id=_L, dish_id=_L, type=_S, content=_S, url=_S, fetched_at=_TS)
CLASSIFICATIONS = _struct(
    id=_L, dish_id=_L, verdict=_S, confidence=_D, reasoning=_S, source_id=_L, model_version=_S, created_at=_TS, dairy_status=_S, gluten_status=_S, nut_status=_S, protein_level=_S,
    serving_role=_S, meal_types=_A, key_ingredients=_A, alcohol_status=_S, vegetarian_status=_S, egg_status=_S, soy_status=_S, sesame_status=_S, meat_sources=_A, spice_level=_S, cooking_method=_S,
    dish_format=_S, flavor_profile=_A, ingredient_tags=_A,
)
MENU_VERSIONS = _struct(id=_L, restaurant_id=_L, content_hash=_S, content=_S, menu_score=_D, char_count=_L, fetched_at=_TS)
DISH_CHANGES = _struct(restaurant_id=_L, observed_at=_TS, change_type=_S, dish_name=_S, old_price=_S, new_price=_S, old_verdict=_S, new_verdict=_S)

DEFAULTS = {"consumer_hidden": False, "refresh_enabled": True, "archived": False}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive migration: every column of ``schema`` in its type and order; a missing one has its
    default, else null.  Columns that the schema lacks go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def one_of(c: Column, values: tuple[str, ...], other: str | None = None) -> Column:
    """The value if the closed vocabulary has it, else ``other``."""
    return F.when(c.isin(*values), c).otherwise(F.lit(other))

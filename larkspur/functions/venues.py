"""Cuisine groups and kinds of venues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_contained

# --- fixed values: groups in order, the first match counts -----------------------------------------------------
CUISINES = (
    ("Vegan & Health", ("vegan", "vegetarian", "health_food")),
    ("Italian & Pizza", ("italian", "pizza")),
    ("Japanese & Sushi", ("japanese", "sushi", "ramen")),
    ("Chinese", ("chinese",)),
    ("Thai", ("thai",)),
    ("Vietnamese", ("vietnamese",)),
    ("Korean", ("korean",)),
    ("Indian", ("indian",)),
    ("Other Asian", ("asian", "malaysian", "filipino", "indonesian", "hawaiian", "poke")),
    ("Mexican & Latin", ("mexican", "taco", "burrito", "tex_mex", "latin", "cuban", "peruvian", "colombian", "brazilian", "argentin", "venezuelan", "caribbean", "spanish", "tapas", "arepa", "empanada")),
    ("Mediterranean & Middle Eastern", ("mediterranean", "greek", "middle_eastern", "turkish", "persian", "lebanese", "israeli", "falafel", "kebab", "afghan")),
    ("Seafood", ("seafood", "oyster", "fish", "crab", "lobster")),
    ("Barbecue & Southern", ("barbecue", "bbq", "cajun", "creole", "soul_food", "southern")),
    ("American & Burgers", ("american", "steak", "hamburger", "burger", "hot_dog", "chicken", "wings", "diner", "cheesesteak")),
    ("Breakfast & Brunch", ("breakfast", "brunch", "pancake", "waffle")),
    ("Sandwiches & Deli", ("sandwich", "deli", "bagel")),
    ("Coffee & Tea", ("coffee", "cafe", "tea_house", "boba", "bubble_tea")),
    ("Sweets & Treats", ("ice_cream", "dessert", "bakery", "cake", "donut", "doughnut", "chocolate", "candy", "confectionery", "frozen_yogurt", "gelato", "pastry", "creperie", "acai", "juice", "smoothie")),
    ("Bars & Breweries", ("bar", "pub", "brewery", "brewpub", "beer", "wine", "cocktail", "lounge", "taproom", "distillery")),
    ("Fast Food", ("fast_food", "food_court")),
)
DESSERT_FIRST = ("ice_cream_shop", "dessert_shop", "dessert_restaurant", "donut_shop", "cake_shop", "pastry_shop", "chocolate_shop", "chocolate_factory", "candy_store", "confectionery", "frozen_yogurt_shop")
COFFEE = ("coffee_shop", "coffee_roastery", "coffee_stand", "cafe", "tea_house")
# -----------------------------------------------------------------------------------------------------------------


def cuisine(primary_type: Column) -> Column:
    kind = F.lower(F.coalesce(primary_type, F.lit("")))
    out = F.when(kind.isin("", "restaurant"), "Other")
    for label, words in CUISINES:
        out = out.when(any_contained(kind, words), label)
    return out.otherwise("Other")


def venue_kind(primary_type: Column) -> Column:
    kind = F.lower(F.coalesce(primary_type, F.lit("")))
    return F.when(kind.isin(*DESSERT_FIRST, "bakery", "acai_shop"), "dessert").when(kind.isin(*COFFEE), "coffee").otherwise("restaurant")


def preferred_category(primary_type: Column, food: Column, dessert: Column, drink: Column) -> Column:
    """The menu tab to open: dessert first at dessert venues, and at bakeries with as many desserts."""
    kind = F.lower(F.coalesce(primary_type, F.lit("")))
    first = (dessert > 0) & (kind.isin(*DESSERT_FIRST) | ((kind == "bakery") & (dessert >= food)))
    return F.when(first, "dessert").when(food > 0, "food").when(dessert > 0, "dessert").when(drink > 0, "drink").otherwise("food")


def cuisine_options(venues, primary_type: str = "primary_type"):
    """(label, place) of the cuisines there are, by name, with Other at the end.  There are at most as many as groups."""
    from pyspark.sql import Window

    labels = venues.select(cuisine(F.col(primary_type)).alias("label")).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy(F.col("label") == "Other", "label")) - 1).alias("place"))

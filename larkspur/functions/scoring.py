"""Verdict predicates, suitability tiers and the composite venue score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DESSERT_VENUE_TYPES, EXCLUDED_PRIMARY_TYPES

# --- fixed values: cut-offs and weights ----------------------------------------------------------
MIN_CONFIDENCE = 0.75
SIDE_WEIGHT, SELECTION_SATURATION, SUBSTANCE_SATURATION, TREAT_SATURATION = 0.25, 12.0, 3.0, 5.0
RATING_PRIOR, RATING_PRIOR_WEIGHT = 4.0, 25.0
PLANT_PROTEIN = r"(?iu)\b(tofu|seitan|tempeh|edamame|beyond|impossible|vegan (?:protein|chick'?n|chicken|sausage|pepperoni|beef|steak|meat))\b"
# -------------------------------------------------------------------------------------------------


def plant_protein(menu: Column) -> Column:
    """whether a menu offers a plant protein anywhere; without a menu, no."""
    return F.coalesce(menu.rlike(PLANT_PROTEIN), F.lit(False))


def strict_vegan(verdict: Column, confidence: Column) -> Column:
    return F.coalesce((verdict == "vegan") | ((verdict == "likely_vegan") & (confidence >= MIN_CONFIDENCE)), F.lit(False))


def veganish(verdict: Column) -> Column:
    return F.coalesce(verdict.isin("vegan", "likely_vegan", "vegan_adaptable"), F.lit(False))


def consumer_venue(archived: Column, hidden: Column, primary_type: Column) -> Column:
    """Neither archived nor hidden, and of no excluded type; an unknown type stays visible."""
    no = F.lit(False)
    return ~F.coalesce(archived, no) & ~F.coalesce(hidden, no) & ~F.coalesce(primary_type.isin(*EXCLUDED_PRIMARY_TYPES), no)


def dessert_venue(primary_type: Column) -> Column:
    return F.coalesce(F.lower(primary_type).isin(*DESSERT_VENUE_TYPES), F.lit(False))


def substance_tenths(protein: Column, name: Column) -> Column:
    """How filling a counted dish is, in tenths (whole numbers sum alike in any order)."""
    return F.when(protein == "high", 10).when(F.lower(name).contains("vegan") | name.contains("Ⓥ"), 9).when(protein == "moderate", 6).otherwise(1)


def selection(meals: Column, sides: Column) -> Column:
    return F.lit(5.0) * F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), meals + sides * F.lit(SIDE_WEIGHT))) / F.log1p(F.lit(SELECTION_SATURATION)))


def substance(meals: Column, points: Column, dessert: Column, plant_protein: Column, saturation: float = SUBSTANCE_SATURATION, treats: float = TREAT_SATURATION) -> Column:
    own = F.greatest(F.lit(0.0), points) + F.when(plant_protein, 1.0).otherwise(0.0)
    return F.when(meals <= 0, 0.0).when(dessert, F.lit(3.0) * F.least(F.lit(1.0), meals / F.lit(treats))).otherwise(F.lit(3.0) * F.least(F.lit(1.0), own / F.lit(saturation)))


def shrunk_rating(rating: Column, count: Column) -> Column:
    n = F.greatest(F.lit(0), count).cast("double")
    return F.when(count.isNull(), rating).otherwise((n * rating + RATING_PRIOR_WEIGHT * RATING_PRIOR) / (n + RATING_PRIOR_WEIGHT))


def reputation(rating: Column, count: Column) -> Column:
    """An unknown rating is neutral (1.0), not bad."""
    return F.when(rating.isNull(), 1.0).otherwise(F.lit(2.0) * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (shrunk_rating(rating, count) - 3.0) / 2.0)))


def tier(profile: str, verdict: Column, vegetarian_status: Column | None = None, meats: Column | None = None) -> Column:
    """0 suits, 1 likely, 2 adaptable, 3 unknown, 4 no, for a diet profile."""
    if profile not in ("vegan", "vegetarian", "pescatarian"):
        raise ValueError(f"no profile {profile}")
    vegan = F.when(verdict == "vegan", 0).when(verdict == "likely_vegan", 1).when(verdict == "vegan_adaptable", 2).when(verdict == "not_vegan", 4).otherwise(3)
    if profile == "vegan":
        return vegan
    vegetarian = F.when(vegetarian_status == "vegetarian", 0).when(vegetarian_status == "not_vegetarian", 4).when(vegan <= 1, vegan).when(vegan == 2, 1).otherwise(3)
    if profile == "vegetarian":
        return vegetarian
    some = F.coalesce(meats, F.array().cast("array<string>"))
    return F.when(F.exists(some, lambda m: ~m.isin("fish", "shellfish")), 4).when(F.size(some) > 0, 0).when(vegetarian == 4, 3).otherwise(vegetarian)


def clamp(c: Column) -> Column:
    """A confidence from 0 to 1; what is no number is 0."""
    x = c.try_cast("double")
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.nanvl(x, F.lit(0.0)))), F.lit(0.0))


# --- fixed values: verdict pairs that differ in calibration alone ---------------------------------
NEIGHBOURS = (("vegan", "likely_vegan"), ("likely_vegan", "vegan_adaptable"), ("unclear", "likely_vegan"), ("unclear", "vegan_adaptable"), ("unclear", "not_vegan"))
# -------------------------------------------------------------------------------------------------


def soft_agreement(a: Column, b: Column) -> Column:
    """Equal verdicts, or neighbours."""
    near = a == b
    for x, y in NEIGHBOURS:
        near = near | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return F.coalesce(near, F.lit(False))


def token_cost(chars: Column, per_input: float = 0.14, per_output: float = 0.28) -> Column:
    """Estimated list price of classifying a menu: 4 characters a token in, a dish of 110 tokens out
    for each 120 characters; prices per million tokens."""
    return (chars / 4.0 * per_input + chars / 120.0 * 110.0 * per_output) / 1e6

"""Search: the intent of a query text, predicates and relevance as columns, rankings."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import tier, veganish
from .text import any_contained, normal_search

# --- fixed values: search words -------------------------------------------------------------------
PROTEIN_WORDS = ("tofu", "tempeh", "seitan", "lentil", "chickpea", "bean", "edamame", "egg", "chicken", "beef", "pork", "fish", "salmon", "tuna")
MEAL_WORDS = {
    "breakfast": ("breakfast", "pancake", "waffle", "omelet", "omelette", "scramble", "oatmeal", "french toast", "benedict"),
    "brunch": ("brunch", "benedict", "mimosa"),
    "lunch": ("lunch",),
    "dinner": ("dinner", "supper"),
    "snack": ("snack", "small plate", "appetizer", "starter"),
}
FLAG_PATTERNS = {
    "vegan_friendly": r"\b(?:vegan(?: friendly)?|plant based)\b",
    "vegetarian": r"\bvegetarian\b",
    "dairy": r"\b(?:dairy free|no dairy)\b",
    "gluten": r"\b(?:gluten free|no gluten)\b",
    "nut": r"\b(?:nut free|no nuts?)\b",
    "egg": r"\b(?:egg free|no eggs?)\b",
    "soy": r"\b(?:soy free|no soy)\b",
    "sesame": r"\b(?:sesame free|no sesame)\b",
    "high_protein": r"\b(?:high protein|protein rich)\b",
}
# ---------------------------------------------------------------------------------------------------
ALLERGENS = ("dairy", "gluten", "nut", "egg", "soy", "sesame")


@dataclass(frozen=True)
class Intent:
    """What a query text asks for."""

    query: str
    flags: frozenset[str] = frozenset()
    meals: tuple[str, ...] = ()
    terms: tuple[str, ...] = field(default=())

    def labels(self) -> list[str]:
        named = {"vegan_friendly": "vegan-friendly", "vegetarian": "vegetarian", "high_protein": "high protein"} | {a: f"{a}-free" for a in ALLERGENS}
        return [named[f] for f in FLAG_PATTERNS if f in self.flags] + list(self.meals)


def normal_query(text: str) -> str:
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text or "") if not "̀" <= c <= "ͯ").lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", plain)).strip()


def parse_query(text: str) -> Intent:
    query = left = normal_query(text)
    flags = {f for f, p in FLAG_PATTERNS.items() if re.search(p, query)}
    meals = tuple(m for m in MEAL_WORDS if re.search(rf"\b{m}\b", query))
    for p in (*FLAG_PATTERNS.values(), *(rf"\b{m}\b" for m in MEAL_WORDS)):
        left = re.sub(p, " ", left)
    return Intent(query, frozenset(flags), meals, tuple(left.split()))


def has_term(haystack: Column, term: str) -> Column:
    found = haystack.contains(term)
    return found | haystack.contains(term[:-1]) if len(term) > 3 and term.endswith("s") else found


def haystack(columns: list[Column], arrays: list[Column] = ()) -> Column:
    """The searchable text of a row."""
    parts = [*columns, *(F.array_join(a, " ") for a in arrays)]
    return normal_search(F.concat_ws(" ", *parts))


def matches(intent: Intent, hay: Column, verdict: Column, vegetarian: Column, statuses: dict[str, Column], protein: Column, meal_types: Column) -> Column:
    ok = F.lit(True)
    if "vegan_friendly" in intent.flags:
        ok = ok & veganish(verdict)
    if "vegetarian" in intent.flags:
        ok = ok & (F.coalesce(vegetarian == "vegetarian", F.lit(False)) | veganish(verdict))
    for a in ALLERGENS:
        if a in intent.flags:
            ok = ok & F.coalesce(statuses[a] == "free", F.lit(False))
    if "high_protein" in intent.flags:
        known = protein.isNotNull() & ~protein.isin("", "unclear")
        ok = ok & F.when(protein == "high", True).when(known, False).otherwise(any_contained(hay, PROTEIN_WORDS))
    for m in intent.meals:
        ok = ok & (F.coalesce(F.array_contains(meal_types, m), F.lit(False)) | any_contained(hay, MEAL_WORDS[m]))
    for t in intent.terms:
        ok = ok & has_term(hay, t)
    return ok


def relevance(intent: Intent, name: Column, ingredients: Column, description: Column, verdict: Column, protein: Column) -> Column:
    """Points of a row whose texts are in search form."""
    q = intent.query
    score = F.when(name == q, 100)
    if q:
        score = score.when(name.startswith(q), 70).when(name.contains(q), 50)
    score = score.otherwise(0)
    for t in intent.terms:
        score = score + F.when(name.contains(t), 12).when(ingredients.contains(t), 9).when(description.contains(t), 5).otherwise(1)
    if "vegan_friendly" in intent.flags:
        score = score + F.when(verdict == "vegan", 4).otherwise(0)
    if "high_protein" in intent.flags:
        score = score + F.when(protein == "high", 4).otherwise(0)
    return score


SORTS = {
    "recommended": [("rating", True), ("confidence", True)],
    "restaurant": [("restaurant_name", False)],
    "rating": [("rating", True), ("user_rating_count", True)],
    "confidence": [("confidence", True)],
    "price": [("price_value", False)],
    "price_desc": [("price_value", True)],
    "distance": [("distance", False)],
    "name": [],
}


def rank_keys(mode: str, searching: bool, profile: str = "vegan") -> list[Column]:
    """The lexicographic keys: searching puts the tier and the score first, browsing the role; unknown
    values come last in either direction; names and ids end all ties."""
    level, role = tier(profile, F.col("verdict")), F.when(F.col("serving_role") == "side", 1).otherwise(0)
    own = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in SORTS[mode]]
    head = [level.asc(), F.col("score").desc(), role.asc()] if searching else [role.asc(), level.asc()]
    return [*head, *own, F.col("name").asc_nulls_last(), F.col("id").asc()]


def interleave(rows: DataFrame, profile: str = "vegan") -> DataFrame:
    """``occ``: the occurrence of a row among those of its venue with its role and tier, so that ordering
    by (role, tier, occ) lets venues take turns.  One partitioned window, no global position."""
    level, role = tier(profile, F.col("verdict")), F.when(F.col("serving_role") == "side", 1).otherwise(0)
    w = Window.partitionBy("restaurant_id", level, role).orderBy(F.col("rating").desc_nulls_last(), F.col("confidence").desc_nulls_last(), F.col("name").asc_nulls_last(), "id")
    return rows.withColumn("occ", F.row_number().over(w).cast("long")).withColumns({"tier": level, "role": role})

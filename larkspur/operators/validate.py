"""Rule-based record validation: ordered overrides of classified rows, attribute batches, run checks.

Each rule is a condition with new values; later rules see what earlier ones left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alcohol_status, any_contained, any_word
from ..schemas import VERDICTS, one_of

# --- fixed values: rule words -----------------------------------------------------------------------------
ANIMAL_WORDS = (
    "chicken", "beef", "pork", "bacon", "ham", "sausage", "pepperoni", "salami", "chorizo", "prosciutto", "pastrami", "brisket", "meatball", "steak", "veal", "lamb", "turkey", "duck", "foie gras",
    "fish", "salmon", "tuna", "anchovy", "anchovies", "sardine", "cod", "mahi", "tilapia", "shrimp", "prawn", "crab", "lobster", "clam", "mussel", "oyster", "scallop", "squid", "calamari", "octopus", "eel",
    "unagi", "caviar", "roe", "cheese", "mozzarella", "parmesan", "cheddar", "feta", "ricotta", "provolone", "gouda", "brie", "queso", "burrata", "halloumi", "butter", "cream", "milk", "yogurt", "ghee",
    "custard", "gelato", "egg", "eggs", "mayo", "mayonnaise", "aioli", "ranch", "alfredo", "honey", "gelatin", "lard", "tallow", "whey",
)
MOCK_WORDS = (
    "vegan", "plant-based", "plant based", "dairy-free", "dairy free", "non-dairy", "meatless", "mock", "imitation", "impossible", "beyond", "tofu", "tempeh", "seitan", "soy", "cashew", "almond", "oat",
    "coconut", "nutritional yeast", "vegetable broth", "veggie", "jackfruit", "substitute", "alternative", "faux", "chick'n", "chikn", "no-egg", "eggless", "aquafaba", "flax",
)
BATTER_WORDS = (
    "pancake", "pancakes", "waffle", "waffles", "french toast", "crepe", "crepes", "crêpe", "crêpes", "croissant", "croissants", "brioche", "challah", "biscuit", "biscuits", "muffin", "muffins", "donut",
    "donuts", "doughnut", "doughnuts",
)
BATTER_EXEMPT = ("scallion pancake", "green onion pancake", "spring onion pancake", "banh xeo", "bánh xèo", "dosa", "injera", "socca", "jianbing", "moo shu", "mu shu", "chay")
ANIMAL_DISHES = (
    "margherita", "caprese", "bianca", "quattro formaggi", "formaggio", "quesadilla", "mac and cheese", "mac & cheese", "grilled cheese", "saganaki", "tiramisu", "cannoli", "flan", "creme brulee",
    "crème brûlée", "milk tea",
)
PIZZA_WORDS = ("pizza", "pizzas", "pizzette", "flatbread", "flatbreads", "calzone", "stromboli")
CHEESE_WORDS = (
    "cheese", "mozzarella", "parmesan", "parmigiano", "pecorino", "grana padano", "asiago", "fontina", "gorgonzola", "ricotta", "provolone", "burrata", "stracciatella", "taleggio", "feta", "cheddar",
    "queso", "brie", "gouda", "halloumi", "manchego",
)
FLAVOURS = ("creamy_rich", "fresh_light", "tangy", "sweet", "smoky", "savory", "herbal", "garlicky", "umami")
MEATS = ("beef", "pork", "chicken", "turkey", "duck", "lamb", "goat", "veal", "fish", "shellfish", "other_meat")
ENUMS = {
    "vegetarian_status": ("vegetarian", "not_vegetarian", "unclear"),
    "protein_source": ("meat_analogue", "tofu_tempeh_seitan", "legume", "nut", "animal", "none", "unclear"),
    "egg_status": ("contains", "free", "unclear"),
    "soy_status": ("contains", "free", "unclear"),
    "sesame_status": ("contains", "free", "unclear"),
    "spice_level": ("none", "mild", "medium", "hot", "unclear"),
    "cooking_method": ("fried", "grilled", "baked", "roasted", "raw", "steamed", "boiled_simmered", "sauteed", "stir_fry", "mixed", "unclear"),
    "dish_format": (
        "bowl", "poke", "sushi", "ramen", "pho", "noodle_dish", "pasta", "pizza", "flatbread", "sandwich", "wrap", "burrito", "taco", "quesadilla", "nachos", "burger", "hot_dog", "gyro", "kebab",
        "dumpling", "empanada", "spring_roll", "curry", "stir_fry", "fried_rice", "rice_dish", "soup", "stew", "chili", "salad", "small_plate", "plate", "breakfast_plate", "omelet",
        "pancake_waffle", "baked_good", "pastry", "dessert", "drink", "other",
    ),
}
# -------------------------------------------------------------------------------------------------------------


def mock_qualified(text: Column) -> Column:
    return any_contained(F.lower(text), MOCK_WORDS)


def animal_word(text: Column) -> Column:
    """Whether a text names an animal ingredient and nothing qualifies it."""
    return text.rlike(any_word(ANIMAL_WORDS)) & ~mock_qualified(text)


def batter_risk(text: Column) -> Column:
    return text.rlike(any_word(BATTER_WORDS)) & ~any_contained(F.lower(text), BATTER_EXEMPT) & ~mock_qualified(text)


def namesake(name: Column, text: Column) -> Column:
    return (name.rlike(any_word(ANIMAL_WORDS)) | name.rlike(any_word(ANIMAL_DISHES))) & ~mock_qualified(text)


def baked_cheese(name: Column, text: Column) -> Column:
    return name.rlike(any_word(PIZZA_WORDS)) & text.rlike(any_word(CHEESE_WORDS)) & ~mock_qualified(text)


def add_on(name: Column, text: Column) -> Column:
    context = r"(?iu)\b(?:add\s+to\s+your|add\s+to\s+any|add\s+on|add[- ]?on|protein\s+add|make\s+it\s+with|top\s+with)\b"
    return name.rlike(r"(?iu)^\s*(?:add|add[- ]?on|extra|side of)\b") | text.rlike(context)


def validated(rows: DataFrame) -> DataFrame:
    """Rows of (name, description, verdict, confidence, category, reasoning, serving_role, alcohol_status,
    dairy_status, gluten_status, nut_status, protein_level, meal_types, key_ingredients, fully_vegan_venue)
    under the rules in their order; rows without a name or with an unknown verdict go.

    ``rules`` names the rules that changed a row, in order.
    """
    name, words, venue = F.trim("name"), F.col("__words"), F.coalesce("fully_vegan_venue", F.lit(False))
    out = rows.where(F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False)) & (F.coalesce(name, F.lit("")) != ""))
    out = out.withColumns({
        "name": F.substring(name, 1, 200), "confidence": F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence"))), F.lit(0.0)),
        "__words": F.concat_ws(" ", name, F.coalesce("description", F.lit(""))), "rules": F.array().cast("array<string>"),
    })
    verdict, confidence = F.col("verdict"), F.col("confidence")
    high, low = (lambda x: F.greatest(confidence, F.lit(x))), (lambda x: F.least(confidence, F.lit(x)))
    steps = [
        ("vegan_venue", venue, "vegan", high(0.99)),
        ("vegan_name", verdict.isin("likely_vegan", "vegan_adaptable", "unclear") & F.col("name").rlike(r"(?iu)\bvegan\b") & ~animal_word(F.coalesce("description", F.lit(""))), "vegan", high(0.85)),
        ("batter", ~venue & verdict.isin("vegan", "likely_vegan") & batter_risk(words), "unclear", low(0.4)),
        ("namesake", ~venue & (verdict == "vegan_adaptable") & namesake(F.col("name"), words), "not_vegan", high(0.8)),
        ("baked_cheese", ~venue & (verdict != "not_vegan") & baked_cheese(F.col("name"), words), "not_vegan", high(0.8)),
    ]
    for rule, when, new, sure in steps:
        out = out.withColumn("__hit", when)
        hit = F.col("__hit")
        out = out.withColumns({"verdict": F.when(hit, new).otherwise(verdict), "confidence": F.when(hit, sure).otherwise(confidence), "rules": F.when(hit, F.array_append("rules", F.lit(rule))).otherwise(F.col("rules"))})
    out = out.withColumn("category", one_of(F.col("category"), ("food", "drink", "dessert"), "food"))
    stated = one_of(F.col("alcohol_status"), ("alcoholic", "non_alcoholic", "unclear"), "unclear")
    out = out.withColumn("alcohol_status", F.when((F.col("category") == "drink") & (stated == "unclear"), alcohol_status(words)).otherwise(stated))
    extra = add_on(F.col("name"), words)
    out = out.withColumns({
        **{c: one_of(F.col(c), ("free", "contains", "unclear"), "unclear") for c in ("dairy_status", "gluten_status", "nut_status")},
        "protein_level": one_of(F.col("protein_level"), ("high", "moderate", "low", "unclear"), "unclear"),
        "serving_role": F.when(extra, "side").otherwise(one_of(F.col("serving_role"), ("meal", "side", "unclear"), "unclear")),
        "rules": F.when(extra, F.array_append("rules", F.lit("add_on"))).otherwise(F.col("rules")),
        "meal_types": F.array_distinct(F.filter(F.coalesce("meal_types", F.array().cast("array<string>")), lambda m: m.isin("breakfast", "brunch", "lunch", "dinner", "snack"))),
        "key_ingredients": F.array_distinct(F.filter(F.transform(F.slice(F.coalesce("key_ingredients", F.array().cast("array<string>")), 1, 8), lambda x: F.substring(F.lower(F.trim(x)), 1, 80)), lambda x: x != "")),
    })
    return out.drop("__words", "__hit")


def guarded(rows: DataFrame) -> DataFrame:
    """The run guardrail on rows: a vegan verdict on a text that names an animal ingredient is unclear."""
    text = F.concat_ws(" ", "name", "description", "reasoning", F.array_join("key_ingredients", " "))
    hit = F.col("verdict").isin("vegan", "likely_vegan") & animal_word(text)
    return rows.withColumn("__hit", hit).withColumns({"verdict": F.when(F.col("__hit"), "unclear").otherwise(F.col("verdict")), "confidence": F.when(F.col("__hit"), F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")), "downgraded": F.col("__hit")}).drop("__hit")


def _outside(values: tuple[str, ...]):
    return lambda v: ~F.coalesce(v.isin(*values), F.lit(False))


def attribute_batch(expected: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, problems) of second-pass attributes: answers (id, enum columns, meat_sources,
    flavor_profile, ingredient_tags) against the expected ids; one bad value drops its row alone."""
    ids = expected.select("id").distinct()
    empty = F.array().cast("array<string>")
    bad = [F.when(~F.coalesce(F.col(c).isin(*values), F.lit(False)), F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("None")))) for c, values in ENUMS.items()]
    for c, values in (("meat_sources", MEATS), ("flavor_profile", FLAVOURS)):
        bad.append(F.when(F.col(c).isNull() | F.exists(F.coalesce(F.col(c), empty), _outside(values)), F.lit(c)))
    bad.append(F.when(F.col("ingredient_tags").isNull() | F.exists(F.coalesce("ingredient_tags", empty), lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), F.lit("ingredient_tags")))
    known = answers.join(ids, "id", "left_semi").withColumn("__bad", F.array_compact(F.array(*bad)))
    good = known.where(F.size("__bad") == 0).drop("__bad").withColumns({"meat_sources": F.slice(F.array_distinct("meat_sources"), 1, 4), "flavor_profile": F.slice("flavor_profile", 1, 3), "ingredient_tags": F.slice(F.transform("ingredient_tags", lambda t: F.lower(F.trim(t))), 1, 6)})
    problems = known.where(F.size("__bad") > 0).select("id", F.array_join("__bad", ", ").alias("problem"))
    problems = problems.unionByName(answers.join(ids, "id", "left_anti").select("id", F.lit("unexpected id").alias("problem")))
    return good, problems.unionByName(ids.join(answers.select("id").distinct(), "id", "left_anti").select("id", F.lit("missing from response").alias("problem")))


def ocr_accepted(chars: Column, score: Column, detached: Column) -> Column:
    """The ladder of text read from photos: too short is rejected, a good one accepted, else retried."""
    return F.when(chars < 150, "reject").when((chars >= 200) & (score >= 0.60) & ~detached, "accept").otherwise("retry")


def route_usable(method: Column, score: Column, chars: Column, prior_chars: Column, new_score: Column, new_chars: Column, single_section: Column, is_pdf: Column) -> Column:
    """Whether a learned route's result stands."""
    learned = method.isin("http", "headless") & ((score >= 0.75) | is_pdf)
    thin = single_section & ((score < 0.75) | (chars < 5000))
    shrunk = (prior_chars >= 1200) & (new_chars < prior_chars * 0.55)
    return F.coalesce(learned & ~thin & (new_score >= 0.6) & ~shrunk, F.lit(False))

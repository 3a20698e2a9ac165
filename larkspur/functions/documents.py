"""How menu-like a document is, and lines of it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import split_lines, stripped

# --- fixed values: menu words ------------------------------------------------------------------------
SECTION_WORDS = (
    "appetizer", "appetizers", "starter", "starters", "entree", "entrees", "entrée", "mains", "main course", "sides", "side dishes", "salad", "salads", "soup", "soups", "dessert", "desserts",
    "beverage", "beverages", "drinks", "sandwiches", "burgers", "pizzas", "pasta", "small plates", "specialties", "à la carte", "a la carte",
)
FOOD_WORDS = (
    "chicken", "beef", "pork", "shrimp", "salmon", "tuna", "fish", "lamb", "bacon", "sausage", "turkey", "steak", "cheese", "mozzarella", "parmesan", "cheddar", "tomato", "onion", "garlic", "basil",
    "cilantro", "lettuce", "spinach", "mushroom", "pepper", "avocado", "cucumber", "rice", "noodle", "pasta", "bread", "bun", "tortilla", "beans", "lentil", "chickpea", "tofu", "hummus", "falafel",
    "curry", "sauce", "dressing", "vinaigrette", "grilled", "fried", "roasted", "baked", "sauteed", "sautéed", "crispy", "marinated", "braised", "smoked", "served with", "topped with", "side of",
    "vegan", "vegetarian", "gluten", "dairy", "egg", "cream", "butter", "wrap", "bowl", "plate", "taco", "burrito", "sandwich", "burger", "salad", "soup", "appetizer", "dessert", "espresso", "latte",
    "chocolate", "vanilla", "caramel", "cake", "cheesecake", "brownie", "cookie", "sorbet", "gelato", "ice cream", "custard", "pudding", "tart", "pie", "mousse", "ganache", "meringue", "sundae",
)
GIFT_WORDS = ("gift card", "egift", "e-gift", "gift cards", "voucher", "check balance", "reload card", "recipient")
MENU_THRESHOLD = 0.45
PRICE = r"(?:\$\s?\d{1,3}(?:\.\d{2})?)|(?:\b\d{1,3}\.\d{2}\b)"
TRAILING_PRICE = r"(?m)(?:\s[-–—]\s?|\.{2,}\s?|\.\s\.\s)(\d{1,3})(?:\.\d{2})?\s*$"
# -----------------------------------------------------------------------------------------------------


#: Up to so many words, a pass for each is faster than one for all.
SHORT_LIST = 8


def _tree(words: list[str]) -> str:
    """A pattern that matches where one of the words begins, by their common beginnings."""
    heads: dict[str, list[str]] = {}
    for w in sorted(words):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = heads.pop("", None) is not None
    branches = [re.escape(c) + (_tree(rest) if any(rest) else "") for c, rest in heads.items()]
    return f"(?:{'|'.join(branches)})" + ("?" if ends else "")


def substring_hits(low: Column, words: tuple[str, ...]) -> Column:
    """Occurrences of all words as substrings, not as whole words.  One pass finds the places where words begin; a word that
    begins with another is counted besides, and one that can overlap itself is counted by what is left without it, as
    are all of a short list."""
    once = list(dict.fromkeys(words))
    looped = [w for w in once if len(once) <= SHORT_LIST or any(w.startswith(w[k:]) for k in range(1, len(w)))]
    told = [w for w in once if w not in looped]
    total = F.lit(0)
    if told:
        first = "".join(re.escape(c) for c in sorted({w[0] for w in told}))
        total = total + F.regexp_count(low, F.lit(f"(?=[{first}])(?={_tree(told)})"))
    for w in told:
        if any(w != v and w.startswith(v) for v in told):
            total = total + F.regexp_count(low, F.lit(re.escape(w)))
    for w in looped:
        total = total + F.floor((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w))
    return total.cast("int")


def present(low: Column, words: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + low.contains(w).cast("int")
    return total


def menu_signals(text: Column, food: tuple[str, ...] = FOOD_WORDS, sections: tuple[str, ...] = SECTION_WORDS, low: Column | None = None) -> dict[str, Column]:
    """The counts that the score is made of.  ``low``: a column of the lower-case text, which each word
    list is looked up in; without it every look-up lowers the text."""
    low = F.lower(text) if low is None else low
    lines = F.filter(F.transform(split_lines(text), stripped), lambda x: x != "")
    return {
        # no price without a digit; null texts have no count
        "prices": F.when(~text.rlike("[0-9]"), 0).otherwise(F.regexp_count(text, F.lit(PRICE)) + F.regexp_count(text, F.lit(TRAILING_PRICE))).cast("int"),
        "food": substring_hits(low, food),
        "sections": present(low, sections),
        "gifts": substring_hits(low, GIFT_WORDS),
        "lines": F.size(lines),
        "short_lines": F.size(F.filter(lines, lambda x: F.length(x).between(3, 80))),
    }


def menu_score(prices: Column, food: Column, sections: Column, gifts: Column, lines: Column, short_lines: Column, digits: int = 3) -> Column:
    """From 0 to 1, rounded: prices, food words, sections and short lines; texts without prices on
    the other signals if that is more; voucher pages at most 0.25."""
    one = F.lit(1.0)
    p, f, s = F.least(prices / 8.0, one), F.least(food / 25.0, one), F.least(sections / 3.0, one)
    t = F.when(lines > 0, short_lines / lines).otherwise(0.0)
    score = p * 0.40 + f * 0.25 + s * 0.20 + t * 0.15
    score = F.when(prices == 0, F.greatest(score, f * 0.40 + s * 0.30 + t * 0.30)).otherwise(score)
    score = F.when((gifts >= 3) & (food < 10), F.least(score, F.lit(0.25))).otherwise(score)
    return F.round(F.least(score, one), digits)


def detached_prices(text: Column, longest: int = 2) -> Column:
    """Whether more than ``longest`` lines in a row hold nothing but a price."""
    bare = r"\s*\$?\s?\d{1,3}(?:\.\d{2})?\s*"
    return text.rlike(rf"(?m)(?:^{bare}$\n?){{{longest + 1},}}")

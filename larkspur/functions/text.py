"""Prices, keys, labels, hashes and URL parts as Column factories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: letters that search folds to ASCII -------------------------------------------
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
# --- fixed values: drink words -------------------------------------------------------------------
ZERO_PROOF = ("virgin", "mocktail", "non-alcoholic", "non alcoholic", "zero proof", "zero-proof", "alcohol-free", "alcohol free", "0% abv")
ALCOHOL = (
    "beer", "ipa", "lager", "stout", "porter", "pilsner", "hefeweizen", "saison", "ale", "cider", "hard seltzer", "hard kombucha", "michelada",
    "wine", "chardonnay", "sauvignon", "cabernet", "merlot", "pinot", "riesling", "malbec", "prosecco", "champagne", "cava", "lambrusco",
    "sangria", "mimosa", "rosé", "port wine", "sherry", "vermouth",
    "whiskey", "whisky", "bourbon", "scotch", "rye", "tequila", "mezcal", "vodka", "gin", "rum", "brandy", "cognac", "absinthe", "schnapps",
    "soju", "sake", "shochu", "liqueur", "amaretto", "baileys", "kahlua", "aperol", "campari", "fireball", "jameson", "jack daniels",
    "cocktail", "margarita", "martini", "mojito", "negroni", "old fashioned", "manhattan", "cosmopolitan", "daiquiri", "paloma",
    "spritz", "moscow mule", "mai tai", "pina colada", "piña colada", "bloody mary", "long island", "whiskey sour", "hot toddy", "sidecar",
    "boilermaker", "on the rocks", "single malt", "hard lemonade",
)
SOFT = (
    "soda", "coke", "coca-cola", "pepsi", "sprite", "fanta", "dr pepper", "root beer", "ginger ale", "ginger beer", "cola", "tonic water",
    "lemonade", "limeade", "juice", "orange juice", "iced tea", "sweet tea", "green tea", "herbal tea", "chai", "matcha",
    "coffee", "espresso", "latte", "cappuccino", "americano", "macchiato", "cold brew", "mocha", "hot chocolate", "smoothie", "milkshake",
    "milk shake", "shake", "float", "sparkling water", "mineral water", "bottled water", "still water", "kombucha",
    "agua fresca", "horchata", "boba", "bubble tea", "energy drink", "gatorade", "red bull", "milk", "oat milk", "almond milk", "cocoa",
    "frappe", "slush", "italian soda", "arnold palmer", "shirley temple",
)
# -------------------------------------------------------------------------------------------------


def any_word(words: tuple[str, ...]) -> str:
    """A case-blind pattern for whole words, Unicode-aware."""
    import re

    return r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + r")(?![\p{L}\p{N}_])"


def any_contained(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def normal_search(c: Column) -> Column:
    """Lower case, accents folded, _ and - as spaces, other marks as spaces, squeezed (null: empty)."""
    folded = F.translate(F.lower(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN)
    folded = F.regexp_replace(folded, r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^a-z0-9\s]", " "), r"\s+", " "))


def first_price(c: Column) -> Column:
    """The first number of up to three digits, the base price of a menu text; null without one."""
    return F.nullif(F.regexp_extract(c, r"\d{1,3}(?:\.\d{1,2})?", 0), F.lit("")).cast("double")


def numbers(c: Column) -> Column:
    """All numbers of up to four digits, in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(r"(\d{1,4}(?:\.\d{1,2})?)"), F.lit(1)).cast("array<double>"), F.array().cast("array<double>"))


def audit_price(c: Column) -> Column:
    return F.array_min(F.filter(numbers(c), lambda x: x > 0))


def audit_calories(c: Column) -> Column:
    return F.array_max(F.filter(numbers(c), lambda x: x > 0))


def price_key(c: Column) -> Column:
    """Numbers without trailing zeros, joined by /; texts without a number by their letters and digits."""
    found = F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(F.size(found) == 0, letters_and_digits(c)).otherwise(F.array_join(plain, "/"))


def money(value: Column) -> Column:
    """Whole amounts without cents, others with two."""
    return F.when(value == F.floor(value), F.concat(F.lit("$"), F.floor(value).cast("string"))).otherwise(F.format_string("$%.2f", value))


def iso_time(c: Column) -> Column:
    """An ISO time with or without an offset, as an instant; null where it is none."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(c))


def letters_and_digits(c: Column) -> Column:
    """Lower-case letters and digits alone (null: empty); texts beyond ASCII want ``canonical_text``."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]", "")


def lost_decimal(c: Column) -> Column:
    """The corrected price of a cents-only text whose value was read as whole units; else null."""
    cents = F.regexp_extract(c, r"^\s*\+?\.(\d{2})\b", 1)
    return F.when((cents != "") & (audit_price(c) >= 10), F.concat(F.lit("$0."), cents))


def calorie_label(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t == "", None).when(F.lower(t).rlike(r"cal"), t).otherwise(F.concat(t, F.lit(" cal")))


PRICE_LEVELS = ("PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE")


def price_level_rank(c: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, PRICE_LEVELS)), c), F.lit(0)).cast("int")


def price_level_symbol(c: Column) -> Column:
    return F.repeat(F.lit("$"), price_level_rank(c))


def pretty_type(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def dish_key(c: Column) -> Column:
    """A slug of letters and digits, 200 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", ""), 1, 200)


def evidence_split(c: Column) -> Column:
    """(reasoning, evidence) of a text that holds both; evidence is null without the mark."""
    mark = ' | evidence: "'
    at = F.instr(c, mark)
    return F.struct(F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c).alias("reasoning"), F.when(at > 0, F.regexp_replace(F.substr(c, at + len(mark)), r'"$', "")).alias("evidence"))


#: White space as texts of web pages hold it: Unicode's, and the information separators.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def stripped(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(WHITE))


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at either end."""
    spaced = F.translate(c, WHITE, " " * len(WHITE))
    return F.trim(F.when(spaced.contains("  "), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced))


def split_lines(c: Column) -> Column:
    """The lines of a text, at any line end."""
    return F.split(c, _LINE_END)


def menu_hash(c: Column) -> Column:
    return F.sha2(squeezed(c), 256)


def page_set_hash(pages: Column) -> Column:
    """Of an array of page texts: squeezed, lower-cased, distinct, in order, joined by newlines."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(F.transform(pages, lambda p: F.lower(squeezed(p))))), "\n"), 256)


def finding_fingerprint(code: Column, field: Column, current: Column) -> Column:
    named = [F.coalesce(c.cast("string"), F.lit("None")) for c in (code, field, current)]
    return F.substring(F.sha2(F.concat_ws("|", *named), 256), 1, 16)


def preview(c: Column, size: int = 96) -> Column:
    t = squeezed(c)
    return F.when(F.length(t) > size, F.concat(F.rtrim(F.substring(t, 1, size - 1)), F.lit("…"))).otherwise(t)


def alcohol_status(c: Column) -> Column:
    """Zero-proof words first, then alcohol, then soft drinks."""
    return (
        F.when(c.rlike(any_word(ZERO_PROOF)), "non_alcoholic").when(c.rlike(any_word(ALCOHOL)), "alcoholic").when(c.rlike(any_word(SOFT)), "non_alcoholic").otherwise("unclear")
    )


def url_host(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1)), r"^www\.", "")


def url_normal(c: Column) -> Column:
    """Without fragment, final slash, scheme and leading www."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"#.*$", ""), r"/+$", ""), r"^https?://", ""), r"^www\.", "")


def url_tokens(c: Column) -> Column:
    """Lower-case letter and digit runs of path, query and fragment, decoded; the mark of structured menus,
    which is no part of the address, does not count."""
    rest = F.regexp_replace(F.regexp_replace(c, r"#structured-menu$", ""), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.filter(F.split(F.lower(F.coalesce(F.try_url_decode(rest), rest)), r"[^0-9a-z]+"), lambda t: t != "")


def host_in(c: Column, hosts: tuple[str, ...]) -> Column:
    host, found = url_host(c), F.lit(False)
    for h in hosts:
        found = found | (host == h) | host.endswith("." + h)
    return found


# --- fixed values: words of menu sections in URL paths --------------------------------------------
SECTION_PATH_WORDS = ("breakfast", "lunch", "dinner", "brunch", "sandwiches", "salads", "soups", "wraps", "desserts", "deserts", "burgers", "appetizers", "starters", "sides", "beverages", "drinks", "specials", "entrees", "entrées", "mains", "pasta", "kids", "family-style-meals")
# ---------------------------------------------------------------------------------------------------


def single_section_url(c: Column) -> Column:
    path = F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    return path.rlike("(?<![a-z])(" + "|".join(SECTION_PATH_WORDS) + ")(?![a-z])")


def server_error_page(c: Column) -> Column:
    return (F.length(c) < 1500) & c.rlike(r"(?i)internal server error|bad gateway|service unavailable|encountered an internal error")


def valid_username(c: Column, reserved: tuple[str, ...] = ()) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_]{3,20}$"), F.lit(False)) & ~F.lower(c).isin(*reserved or ("",))


def json_list(c: Column) -> Column:
    """A total decoder: null, garbage and non-lists give an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def names_overlap(a: Column, b: Column) -> Column:
    """One name holds the other, or they share a word of more than three letters."""
    x, y = F.lower(a), F.lower(b)
    long = lambda c: F.filter(F.split(c, r"[^a-z0-9]+"), lambda t: F.length(t) > 3)
    return x.contains(y) | y.contains(x) | F.arrays_overlap(long(x), long(y))


def same_brand(a: Column, b: Column) -> Column:
    """The leading words that two names share hold one that is not generic."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9']+)"), F.lit(1))
    x, y = words(a), words(b)
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    differ = F.filter(F.transform(pairs, lambda p, i: F.when(~p.x.eqNullSafe(p.y), i + 1)), lambda i: i.isNotNull())
    shared = F.slice(x, 1, F.coalesce(F.get(differ, F.lit(0)) - 1, F.size(x)))
    return F.exists(shared, lambda t: ~t.isin("the", "cafe", "café", "el", "la", "los", "las", "orlando"))


def shared_items(a: Column, b: Column) -> Column:
    """How many distinct items two arrays share."""
    return F.size(F.array_intersect(a, b))


def holds_all(a: Column, b: Column) -> Column:
    """Whether an array holds every item of another."""
    return F.size(F.array_except(b, a)) == 0


#: The words that may end a menu page's path in place of a part of the day.
DAYPARTS = ("dinner", "lunch", "brunch", "breakfast", "happy-hour", "wine", "dessert", "desserts", "drinks")


def url_path(c: Column) -> Column:
    """The path of an address, without query, fragment and final slashes."""
    return F.regexp_replace(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def daypart_segment(c: Column) -> Column:
    """The last path segment in lower case if it names a part of the day, else null."""
    last = F.lower(F.substring_index(url_path(c), "/", -1))
    return F.when(last.isin(*DAYPARTS), last)


def sibling_slug(c: Column, sections: tuple[str, ...]) -> Column:
    """struct(parent, prefix) of a path that ends in a word before "menu" or "menus" that is no section;
    null for any other."""
    path = url_path(c)
    slug = F.lower(F.substring_index(path, "/", -1))
    prefix = F.btrim(F.regexp_replace(slug, r"menus?$", ""), F.lit("-_"))
    hit = path.contains("/") & slug.rlike(r".menus?$") & (prefix != "") & ~prefix.isin(*sections)
    return F.when(hit, F.struct(F.regexp_replace(path, r"/[^/]*$", "").alias("parent"), prefix.alias("prefix")))


def catalogue_price(c: Column) -> Column:
    """The price text of a JSON object with low, high, regular and plain prices; any other text as it is."""
    get = lambda k: F.nullif(F.get_json_object(c, f"$.{k}"), F.lit(""))
    low, high = get("low_formatted"), get("high_formatted")
    one = F.coalesce(high, low, get("regular_formatted"), get("formatted"), F.lit(""))
    both = F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(low, F.lit(" - "), high)).otherwise(stripped(one))
    return F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*\{"), both).otherwise(stripped(F.coalesce(c, F.lit(""))))


def listed_addresses(c: Column) -> Column:
    """The texts of a JSON list, stripped, distinct, in order, without empty ones; else an empty array."""
    return F.array_distinct(F.filter(F.transform(json_list(c), stripped), lambda x: x.isNotNull() & (x != "")))


def json_unescaped(c: Column) -> Column:
    """The text that a JSON string holds between its quotes; of what is no JSON the quotes and backslashes."""
    read = F.get_json_object(F.concat(F.lit('{"v":"'), c, F.lit('"}')), "$.v")
    return F.coalesce(read, F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))

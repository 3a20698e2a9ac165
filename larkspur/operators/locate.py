"""Location-aware URL filters on token arrays, with higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import url_tokens

# --- fixed values: road words ---------------------------------------------------------------------------
STREET_SUFFIXES = (
    "st", "street", "ave", "avenue", "av", "rd", "road", "dr", "drive", "blvd", "boulevard", "hwy", "highway", "ln", "lane", "way", "pkwy", "parkway", "trl", "trail", "ct", "court", "cir", "circle",
    "pl", "place", "plaza", "ter", "terrace", "sq", "square",
)
GENERIC_WORDS = (
    *STREET_SUFFIXES, "n", "s", "e", "w", "ne", "nw", "se", "sw", "north", "south", "east", "west", "suite", "ste", "unit", "apt", "bldg", "building", "floor", "fl", "usa", "us",
)
LOCATION_SEGMENTS = ("location", "locations", "branch")
# -----------------------------------------------------------------------------------------------------------


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^0-9a-z]+"), lambda t: t != "")


def address_parts(address: Column) -> Column:
    """struct(number, street, city): number and words of the first part, words of the last part before
    the state and zip."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")
    street = _words(F.get(parts, F.lit(0)))
    state = F.filter(F.transform(parts, lambda p, i: F.when(p.rlike(r"^[A-Z]{2}\s*\d{5}(-\d{4})?$") & (i > 0), i)), lambda i: i.isNotNull())
    end = F.coalesce(F.get(state, F.lit(0)), F.size(parts))
    city = F.when(end > 1, _words(F.get(parts, end - 1))).otherwise(F.array().cast("array<string>"))
    digits = F.filter(street, lambda t: t.rlike(r"^\d+$"))
    names = F.filter(street, lambda t: ~t.rlike(r"^\d+$") & ~t.isin(*GENERIC_WORDS))
    return F.struct(F.get(digits, F.lit(0)).alias("number"), F.array_distinct(names).alias("street"), city.alias("city"))


def _subset(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(F.array_except(a, b)) == 0)


def strong_match(url: Column, place: Column) -> Column:
    """The street number is a token, or all street words are and one stands before a road word."""
    t = url_tokens(url)
    ahead = F.exists(F.transform(t, lambda x, i: F.array_contains(place["street"], x) & F.exists(F.slice(t, i + 2, 2), lambda s: s.isin(*STREET_SUFFIXES))), lambda b: b)
    return F.coalesce(F.array_contains(t, place["number"]), F.lit(False)) | (_subset(place["street"], t) & ahead)


def plausible_match(url: Column, place: Column) -> Column:
    t = url_tokens(url)
    fused = F.array_join(place["city"], "")
    return strong_match(url, place) | _subset(place["city"], t) | ((fused != "") & F.array_contains(t, fused))


def location_specific(url: Column) -> Column:
    """A location route with something after it, or a number of up to five digits near a road word."""
    t = url_tokens(url)
    n = F.size(t)
    hit = F.transform(
        t,
        lambda x, i: (x.isin(*LOCATION_SEGMENTS) & (i + 1 < n))
        | (x.rlike(r"^[1-9]\d{0,4}$") & ~F.coalesce(F.get(t, i + 1).rlike(r"^\d+$"), F.lit(False)) & F.exists(F.slice(t, i + 2, 5), lambda s: s.isin(*STREET_SUFFIXES))),
    )
    return F.exists(hit, lambda b: b)


def filter_urls(urls: DataFrame, record: str, url: str = "url", address: str = "address") -> DataFrame:
    """URLs of each record without other locations' pages: once a URL of the record names its own street,
    location pages that do not plausibly name the record's place go."""
    place = address_parts(F.col(address))
    own = urls.withColumns({"__anchor": strong_match(F.col(url), place), "__plausible": plausible_match(F.col(url), place), "__specific": location_specific(F.col(url))})
    anchored = F.max("__anchor").over(Window.partitionBy(record))
    return own.withColumn("__any", anchored).where(~(F.col("__any") & F.col("__specific") & ~F.col("__plausible"))).drop("__anchor", "__plausible", "__specific", "__any")


def _is_place(span: Column, place: Column) -> Column:
    """Whether a span is exactly the record's city, street or number."""
    same = lambda x: (F.size(x) > 0) & (F.size(F.array_except(x, span)) == 0) & (F.size(F.array_except(span, x)) == 0)
    fused = F.array_join(place["city"], "")
    return same(place["city"]) | same(place["street"]) | ((F.size(F.array_distinct(span)) == 1) & (((fused != "") & (F.get(span, F.lit(0)) == fused)) | F.coalesce(F.get(span, F.lit(0)) == place["number"], F.lit(False))))


# --- fixed values: words that tell a site's menu pages apart, not its places --------------------------------
SECTION_WORDS = (
    "menu", "menus", "food", "dinner", "lunch", "brunch", "breakfast", "dessert", "desserts", "drink", "drinks", "cocktail", "cocktails", "wine", "wines", "beer", "beers", "bar", "kids", "catering",
    "happy", "hour", "specials", "special", "daily", "weekend", "seasonal", "holiday", "evening", "late", "night", "takeout", "delivery",
    "appetizers", "apps", "starters", "entrees", "mains", "sides", "salads", "soups", "sandwiches", "burgers", "tacos", "pizza", "pizzas", "sushi", "snacks", "bites", "small", "plates", "bakery",
    "pastry", "pastries", "cake", "cakes", "coffee", "tea", "vegan", "vegetarian", "gluten", "restaurants", "cafe", "order", "online",
)
# --------------------------------------------------------------------------------------------------------------


def sibling_drops(urls: DataFrame, record: str, url: str = "url", address: str = "address", longest: int = 4) -> DataFrame:
    """(record, url) of pages that differ from one of the record's own pages, on the same host, in one
    span of up to four tokens, where the own page's span is the record's place and the other's is neither
    that nor a menu section.  Pages meet by record, host and the tokens before and after a span, where the own pages
    are few: of those that agree in all that only the first and last words of the place count."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = urls.select(F.col(record).alias("r"), F.col(url).alias("u"), host.alias("h"), url_tokens(F.col(url)).alias("t"), address_parts(F.col(address)).alias("place")).distinct()
    ends = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.transform(F.sequence(i, F.least(i + (longest - 1), F.size("t"))), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    spans = rows.where(F.size("t") > 0).select("r", "u", "h", "t", "place", F.explode(ends).alias("e"))
    spans = spans.select("r", "u", "h", "place", F.slice("t", F.col("e.i"), F.col("e.j") - F.col("e.i") + 1).alias("x"), F.array_join(F.slice("t", F.lit(1), F.col("e.i") - 1), " ").alias("head"), F.array_join(F.slice("t", F.col("e.j") + 1, F.size("t")), " ").alias("tail"))
    spans = spans.withColumns({"own": F.coalesce(_is_place(F.col("x"), F.col("place")), F.lit(False)), "a": F.get("x", F.lit(0)), "b": F.element_at("x", -1)})
    keys = ["r", "h", "head", "tail"]
    places = spans.where("own").groupBy(*keys).agg(F.collect_set(F.struct("a", "b")).alias("places"))
    other = spans.where(~F.col("own") & ~F.exists("x", lambda t: t.isin(*SECTION_WORDS)))
    hit = other.join(places, keys).where(F.exists("places", lambda p: (p["a"] != F.col("a")) & (p["b"] != F.col("b"))))
    return hit.select(F.col("r").alias(record), F.col("u").alias(url)).distinct()


def filter_pages(pages: DataFrame, record: str = "restaurant_id", url: str = "url", text: str = "text", address: str = "address") -> DataFrame:
    """Pages without sibling menus of other places: among a record's pages whose last path segment is a
    place word before "menu", the most specific level (words before the city, then the city) that some
    page names twice or more decides, and pages with under half of the most namings go."""
    base = F.substring_index(F.col(url), "#", 1)
    path = F.regexp_replace(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    slug = F.lower(F.element_at(F.split(path, "/"), -1))
    prefix = F.regexp_replace(F.regexp_replace(slug, r"menus?$", ""), r"^[-_]+|[-_]+$", "")
    sibling = slug.rlike(r".menus?$") & (prefix != "") & ~prefix.isin(*SECTION_WORDS)
    place = address_parts(F.col(address))
    own = F.array_distinct(F.filter(F.concat(place["street"], F.filter(F.array(place["number"]), lambda x: x.isNotNull())), lambda t: F.length(t) > 2))
    count = lambda words: F.coalesce(F.aggregate(words, F.lit(0), lambda n, w: n + F.size(F.split(F.concat(F.lit(" "), F.regexp_replace(F.lower(F.col(text)), r"[^a-z0-9']+", "  "), F.lit(" ")), F.concat(F.lit(" "), w, F.lit(" ")))) - 1), F.lit(0))
    city = F.array_join(place["city"], " ")
    squeezed = F.regexp_replace(F.lower(F.col(text)), r"[^a-z0-9]+", " ")
    in_city = F.when(city != "", F.size(F.split(squeezed, city)) - 1).otherwise(0)
    named = pages.withColumns({"__base": base, "__parent": F.when(sibling, F.regexp_replace(path, r"/[^/]*$", "")), "__own": count(own), "__city": in_city})
    per = named.where("__parent IS NOT NULL").groupBy(record, "__parent", "__base").agg(F.max("__own").alias("a"), F.max("__city").alias("b"))
    best = per.groupBy(record, "__parent").agg(F.max("a").alias("ma"), F.max("b").alias("mb"), F.count("*").alias("n")).where("n > 1")
    gone = per.join(best, [record, "__parent"]).where("CASE WHEN ma >= 2 THEN a * 2 < ma WHEN mb >= 2 THEN b * 2 < mb ELSE false END").select(record, "__base").distinct()
    return named.join(gone, [record, "__base"], "left_anti").drop("__base", "__parent", "__own", "__city")

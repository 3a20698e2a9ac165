"""Threads, mentions, notes and notifications; operational buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mention_counts(comments: DataFrame) -> DataFrame:
    """(place_id, dish_key, n) of comments (place_id, mentions array<struct<dish_key, ...>>)."""
    return comments.select("place_id", F.explode("mentions.dish_key").alias("dish_key")).groupBy("place_id", "dish_key").agg(F.count("*").alias("n"))


def notes_by_place(notes: DataFrame) -> DataFrame:
    """(place_id, notes newest first, newest), to be ordered by newest."""
    held = notes.where("place_id IS NOT NULL").groupBy("place_id").agg(F.collect_list(F.struct("created_at", "id", "body")).alias("all"), F.max("created_at").alias("newest"))
    return held.select("place_id", F.reverse(F.array_sort("all")).alias("notes"), "newest")


def real_mentions(comments: DataFrame, profiles: DataFrame, most: int = 10) -> DataFrame:
    """(id, user_ids): of the usernames that a comment lists, distinct and at most ``most``, those that
    exist and that stand in its body as @name."""
    listed = comments.select("id", "body", F.posexplode(F.slice(F.array_distinct(F.transform("usernames", lambda u: F.lower(u))), 1, most)).alias("place", "u"))
    known = listed.join(profiles.select(F.lower("username").alias("u"), "user_id"), "u")
    standing = known.where(F.rlike(F.concat(F.lit(" "), F.lower("body"), F.lit(" ")), F.concat(F.lit(r"[^a-z0-9_]@"), F.col("u"), F.lit("[^a-z0-9_]"))))
    return standing.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "user_id"))), lambda s: s.user_id).alias("user_ids"))


def bad_replies(comments: DataFrame) -> DataFrame:
    """Replies whose parent is missing or stands at another place."""
    parents = comments.select(F.col("id").alias("parent_id"), F.col("place_id").alias("parent_place"))
    return comments.where("parent_id IS NOT NULL").join(parents, "parent_id", "left").where("parent_place IS NULL OR parent_place <> place_id").drop("parent_place")


def notifications(comments: DataFrame, user: str) -> DataFrame:
    """Replies to the user's comments and mentions of the user, a reply where it is both; own ones not."""
    mine = comments.where(F.col("user_id") == user).select(F.col("id").alias("parent_id"))
    others = comments.where(F.col("user_id") != user)
    replies = others.join(mine, "parent_id", "left_semi").withColumn("kind", F.lit("reply"))
    mentions = others.where(F.array_contains("mentioned", user)).withColumn("kind", F.lit("mention")).join(replies.select("id"), "id", "left_anti")
    return replies.unionByName(mentions).orderBy(F.desc("created_at"), "id")


def resolved_favourites(favourites: DataFrame, dishes: DataFrame) -> DataFrame:
    """(…, dish_id): by place and dish key, else by the local id."""
    by_key = dishes.groupBy("place_id", "dish_key").agg(F.min("id").alias("__by_key"))
    return favourites.join(by_key, ["place_id", "dish_key"], "left").withColumn("dish_id", F.coalesce("__by_key", "local_id")).drop("__by_key")


def rehydrated(dishes: DataFrame, venues: DataFrame, fields: tuple[str, ...], key: str = "restaurant_id") -> DataFrame:
    """Compact dishes with their venue's name and ``fields``: what the directory says counts, then what the dish
    says; a dish without any name of its venue is at a Restaurant."""
    told = venues.select(F.col("id").alias("__id"), F.col("name").alias("__name"), *[F.col(f).alias(f"__{f}") for f in fields])
    held = dishes.join(told, F.col(key) == F.col("__id"), "left")
    own = lambda c: F.col(c) if c in dishes.columns else F.lit(None)
    out = {"restaurant_name": F.coalesce("__name", own("restaurant_name"), F.lit("Restaurant")), **{f: F.coalesce(f"__{f}", own(f)) for f in fields}}
    return held.withColumns(out).drop("__id", "__name", *[f"__{f}" for f in fields])


def workload(chars: Column) -> Column:
    """Estimated minutes of classifying a menu."""
    return F.when(chars <= 5_000, "<2").when(chars <= 15_000, "2-5").when(chars <= 30_000, "4-8").otherwise("7-12+")


def usage_window(used: Column, resets_at: Column, now: Column) -> Column:
    """Percent used, 0 to 100; a window that was reset since is empty."""
    return F.when(resets_at < now, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), used)))


def pdf_date(c: Column) -> Column:
    """The day of a PDF date text."""
    return F.try_to_date(F.regexp_extract(c, r"^D:(\d{8})", 1), "yyyyMMdd")


def stale(embedded: Column, header: Column, today: Column, days: int = 550) -> Column:
    """Whether the newer of two dates is too old; unknown dates are fresh."""
    return F.coalesce(F.datediff(today, F.greatest(embedded, header)) > days, F.lit(False))


def structured_counts(c: Column) -> Column:
    """struct(products, categories): the largest counts that markers in a text state."""
    top = lambda what: F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(rf"\[structured-menu [^\]]*?{what}=(\d+)"), F.lit(1)), lambda x: x.cast("int"))), F.lit(0))
    return F.struct(top("products").alias("products"), top("categories").alias("categories"))


def new_lines(before: Column, after: Column) -> Column:
    """Lines of ``after`` that ``before`` lacks, and their neighbours, as an array."""
    fresh = F.transform(after, lambda x: ~F.array_contains(before, x))
    return F.transform(F.filter(F.transform(after, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: F.exists(F.slice(fresh, F.greatest(s.i, F.lit(1)), F.when(s.i == 0, 2).otherwise(3)), lambda b: b)), lambda s: s.x)


def reattached_prices(words: DataFrame) -> DataFrame:
    """(line, price) of boxes (page, id, kind 'text' or 'price', left, top, bottom, value): each price goes
    to the text left of it with the largest vertical overlap, of at least half its height; ties to the
    first.  Boxes meet by page and by the bands of their height, not all with all.  Of texts in the same place the
    first can win alone, and prices in the same place have one text, so each place meets others once."""
    band, place = 64, ("page", "left", "top", "bottom")
    spread = lambda rows: rows.withColumn("band", F.explode(F.sequence(F.floor(F.col("top") / band), F.floor(F.col("bottom") / band))))
    texts = words.where("kind = 'text'").groupBy(*place).agg(F.min("id").alias("id"), F.min_by("value", "id").alias("value"))
    prices = words.where("kind = 'price'").select(*place, "id", "value")
    t, p = spread(texts).alias("t"), spread(prices.select(*place).distinct()).alias("p")
    both = t.join(p, F.expr("t.page = p.page AND t.band = p.band AND t.left < p.left"))
    overlap = F.least("t.bottom", "p.bottom") - F.greatest("t.top", "p.top")
    close = both.where(overlap * 2 >= F.col("p.bottom") - F.col("p.top")).select("p.*", F.struct(overlap.alias("o"), (-F.col("t.id")).alias("n")).alias("k"), F.col("t.value").alias("line"))
    best = close.groupBy(*place).agg(F.max_by(F.struct("k", "line"), "k").alias("x"))
    found = prices.join(best, list(place)).select("page", F.col("id").alias("price_id"), "x.k", "x.line", F.col("value").alias("price"))
    return found.groupBy("page", "price_id").agg(F.max_by(F.struct("line", "price"), "k").alias("x")).select("page", "price_id", "x.line", "x.price")

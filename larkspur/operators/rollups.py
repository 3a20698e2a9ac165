"""Read models and aggregates: venue counts and scores, directories, facets, audits, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import dessert_venue, reputation, selection, strict_vegan, substance, substance_tenths


def count_map(rows: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """(key, map of value to rows): counts for keys that are known only at run time."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(out))


def venue_counts(dishes: DataFrame) -> DataFrame:
    """One aggregation per venue over (restaurant_id, primary_type, category, serving_role, verdict,
    confidence, protein_level, name): totals, strict vegan meals and sides, substance in tenths.

    A null category is food; drinks and desserts count in the total alone, but a dessert venue's desserts
    are its meals; a null or unclear role is a meal."""
    no = F.lit(False)
    food = F.col("category").isNull() | (F.col("category") == "food")
    product = F.coalesce(F.col("category") == "dessert", no) & dessert_venue(F.col("primary_type"))
    counted = food | product
    side = F.coalesce(F.col("serving_role") == "side", no) & ~product
    strict = strict_vegan(F.col("verdict"), F.col("confidence"))
    meal, own_side = counted & ~side, counted & side
    return dishes.groupBy("restaurant_id").agg(
        F.count("*").alias("total"),
        F.count_if(meal).alias("meals"),
        F.count_if(own_side).alias("sides"),
        F.count_if(meal & strict).alias("vegan_meals"),
        F.count_if(own_side & strict).alias("vegan_sides"),
        F.coalesce(F.sum(F.when(meal & strict, substance_tenths(F.col("protein_level"), F.col("name")))), F.lit(0)).alias("substance_tenths"),
    )


def venue_scores(counts: DataFrame, digits: int = 1) -> DataFrame:
    """``counts`` (with rating, user_rating_count, is_dessert_venue, plant_protein) and the score with its
    parts; the score is rounded from the parts as they are, not from their rounded values."""
    meals = F.col("vegan_meals").cast("double")
    a = selection(meals, F.col("vegan_sides").cast("double"))
    b = substance(meals, F.col("substance_tenths") / 10.0, F.col("is_dessert_venue"), F.col("plant_protein"))
    c = reputation(F.col("rating"), F.col("user_rating_count"))
    basis = F.when(F.col("is_dessert_venue"), "treat_variety").otherwise("protein")
    return counts.withColumns({"score": F.round(a + b + c, digits), "selection": F.round(a, digits), "substance": F.round(b, digits), "reputation": F.round(c, digits), "basis": basis})


def ordered_text(rows: DataFrame, key: str, order: list[str], text: str, head: Column | None = None, joiner: str = "\n\n") -> DataFrame:
    """(key, text, n): the texts of a key in order, joined; with ``head`` before each text unless there
    is only one."""
    piece = F.struct(*order, F.coalesce(head, F.lit("")).alias("__head") if head is not None else F.lit("").alias("__head"), F.coalesce(text, F.lit("")).alias("__text"))
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(piece)).alias("__all"))
    many = F.array_join(F.transform("__all", lambda p: F.concat(p["__head"], p["__text"])), joiner)
    one = F.get("__all", F.lit(0))["__text"]
    return held.select(key, F.when(F.size("__all") == 1, one).otherwise(many).alias("text"), F.size("__all").cast("long").alias("n"))


def census(rows: DataFrame, bucket: Column, buckets: tuple[str, ...]) -> DataFrame:
    """(bucket, n) with a row for each bucket, zero where it is empty."""
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def findings(rows: DataFrame, rules: list[tuple[str, str, Column]], keep: list[str]) -> DataFrame:
    """A row for each rule (code, severity, condition) that holds for a row, from one pass."""
    hits = F.array_compact(F.array(*[F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, when in rules]))
    return rows.select(*keep, F.inline(hits))


def with_reviews(found: DataFrame, reviews: DataFrame, keys: list[str]) -> DataFrame:
    """A review counts only while the fingerprint that it was given for holds."""
    r = reviews.select(*keys, F.col("fingerprint").alias("__fp"), F.col("status").alias("review_status"))
    joined = found.join(r, keys, "left")
    return joined.withColumn("review_status", F.when(F.col("__fp") == F.col("fingerprint"), F.col("review_status"))).drop("__fp")


def first_owner(rows: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """``owner``: the first row's struct of ``order`` among those with equal content; a pre-aggregated
    minimum joined back, so a common content does not gather in one task."""
    owners = rows.groupBy(digest).agg(F.min(F.struct(*order)).alias("owner"))
    return rows.join(owners, digest)


def feed(parts: list[DataFrame], order: str = "ts") -> DataFrame:
    """Unlike events as one feed, newest first."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(F.col(order).desc())


def priority_union(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The row of each key from the first part that has it."""
    out = None
    for k, p in enumerate(parts):
        p = p.withColumn("__priority", F.lit(k))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    whole = F.struct(*[c for c in out.columns if c != "__priority"])
    return out.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(whole, "__priority").alias("__row")).select("__row.*")


def unread(events: DataFrame, seen: DataFrame, user: str, at: str = "ts") -> DataFrame:
    """(user, unread): events after the user's watermark; without one all are."""
    joined = events.join(seen.select(user, "seen_at"), user, "left")
    return joined.groupBy(user).agg(F.count_if(F.col("seen_at").isNull() | (F.col(at) > F.col("seen_at"))).alias("unread"))


def run_guards(runs: DataFrame, key: str, verdict: str, confidence: str, least: int = 10) -> DataFrame:
    """(key, n, vegan_rate, spread) of runs with enough rows."""
    vegan = F.when(F.col(verdict).isin("vegan", "likely_vegan"), 1.0).otherwise(0.0)
    return runs.groupBy(key).agg(F.count("*").alias("n"), F.avg(vegan).alias("vegan_rate"), F.stddev_pop(confidence).alias("spread")).where(F.col("n") >= least)


def pins(dishes: DataFrame, venue: str = "restaurant_id", place: str = "place", context: tuple[str, ...] = ("restaurant_name", "address", "lat", "lng", "distance", "rating", "user_rating_count", "primary_type", "price_level", "website_url")) -> DataFrame:
    """(venue, the context columns, count) for the map: how many shown dishes a venue has, and what the first of them in
    ``place`` says of it.  Dishes without a position are on no map."""
    placed = dishes.where("lat IS NOT NULL AND lng IS NOT NULL")
    first = placed.groupBy(venue).agg(F.min_by(F.struct(*context), place).alias("x"), F.count("*").alias("count"))
    return first.select(venue, "x.*", "count")


def run_summary(results: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, ok, failed, skipped, dishes, cost) of a run's results (status ok, failed or skipped; dishes; cost)."""
    of = lambda status: F.count(F.when(F.col("status") == status, 1))
    done = F.col("status") == "ok"
    return results.groupBy(run).agg(of("ok").alias("ok"), of("failed").alias("failed"), of("skipped").alias("skipped"), F.coalesce(F.sum(F.when(done, F.col("dishes"))), F.lit(0)).alias("dishes"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 2).alias("cost"))


def dropped_types(places: DataFrame, food_venue: Column) -> DataFrame:
    """(primary_type, n) of new places (those without already_added_id) that are no food venues, most first."""
    dropped = places.where(F.col("already_added_id").isNull() & ~F.coalesce(food_venue, F.lit(False)))
    return dropped.groupBy(F.coalesce(F.nullif("primary_type", F.lit("")), F.lit("unknown")).alias("primary_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "primary_type")

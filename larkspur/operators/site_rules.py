"""Rules of sites and runs: pages to probe, enrichment targets, request checks, snapshots of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DAYPARTS, daypart_segment, url_normal, url_path


def daypart_probes(pages: DataFrame, record: str, url: str, order: str, most: int = 12) -> DataFrame:
    """(record, url, place) of unlinked pages worth fetching, at most ``most`` a record: the other parts of
    the day beside a page that ends in one; where a record has none of these, all of them below its menu
    pages.  Addresses that the record's pages have already (without fragment, final slash, scheme and
    leading www) are left out; what comes from the earliest page comes first.
    """
    base = F.regexp_replace(F.substring_index(F.col(url), "#", 1), r"/+$", "")
    rows = pages.select(F.col(record).alias("r"), base.alias("base"), F.col(order).alias("o")).groupBy("r", "base").agg(F.min("o").alias("o"))
    kind = F.when(daypart_segment(F.col("base")).isNotNull(), 1).when(F.lower(url_path(F.col("base"))).contains("menu"), 2)
    rows = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    least = rows.groupBy("r").agg(F.min("kind").alias("kind"))
    parent = F.when(F.col("kind") == 1, F.regexp_replace("base", r"/[^/]*$", "")).otherwise(F.col("base"))
    words = F.posexplode(F.array(*map(F.lit, DAYPARTS)))
    made = rows.join(least, ["r", "kind"]).select("r", "base", "o", parent.alias("parent"), words.alias("i", "word")).select("r", "base", "o", "i", F.concat_ws("/", "parent", "word").alias("u")).where("u <> base")
    made = made.withColumn("key", url_normal(F.col("u"))).groupBy("r", "key").agg(F.min(F.struct("o", "i", "u")).alias("m"))
    seen = pages.select(F.col(record).alias("r"), url_normal(F.col(url)).alias("key")).distinct()
    place = F.row_number().over(Window.partitionBy("r").orderBy("m.o", "m.i", "m.u"))
    return made.join(seen, ["r", "key"], "left_anti").select(F.col("r").alias(record), F.col("m.u").alias(url), place.alias("place")).where(F.col("place") <= most)


def enrichment_targets(restaurants: DataFrame, everything: bool = False) -> DataFrame:
    """Restaurants that were never enriched, or lack a rating count or opening hours."""
    lacking = F.col("enriched_at").isNull() | F.col("user_rating_count").isNull() | F.col("hours_enriched_at").isNull()
    return restaurants if everything else restaurants.where(lacking)


def request_errors(ids: Column, stale_days: Column, most: int = 1000) -> Column:
    """What is wrong with a run's request, else null; what a request leaves out (null) is right."""
    return F.when(stale_days < 1, "stale_days").when((F.size(ids) == 0) | (F.size(ids) > most) | F.exists(ids, lambda x: x.isNull()), "restaurant_ids")


def whitelisted(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The columns of ``fields`` that the rows have, in that order."""
    return rows.select(*[F.col(f"`{c}`") for c in fields if c in rows.columns])


def random_rows(rows: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` random rows, all rows alike (a top-n by a random key, merged from the tasks' own)."""
    own = "__random"
    while own in rows.columns:
        own += "_"
    return rows.withColumn(own, F.rand(seed)).orderBy(own).limit(n).drop(own)


def stamped(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """Rows of a shard with the shard's key where they lack it."""
    return rows.withColumn(key, F.coalesce(F.col(key), value))

"""Single-table updates as pure functions: flags, fixes, reviews, signals and attribute backfills."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EDITORIAL_URL


def update(rows: DataFrame, when: Column, **values: Column) -> DataFrame:
    """Columns of the rows where a condition holds; a null condition does not."""
    hit = F.coalesce(when, F.lit(False))
    return rows.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def update_by(rows: DataFrame, delta: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` of the rows that ``delta`` has by ``key`` (unique there)."""
    d = delta.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = rows.join(d, F.col(key) == F.col("__key"), "left")
    return joined.withColumns({c: F.when(F.col("__key").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}).drop("__key", *[f"__{c}" for c in columns])


def food_signals(restaurants: DataFrame, sources: DataFrame, details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(restaurants, sources) with fresh details by id: closed venues are archived, and an editorial text
    is the venue's evidence row."""
    columns = tuple(c for c in details.columns if c != "id")
    after = update_by(restaurants, details, "id", columns)
    if "business_status" in columns:
        after = update(after, F.col("business_status") == "CLOSED_PERMANENTLY", archived=F.lit(True))
    if "editorial_summary" not in columns:
        return after, sources
    told = details.where("editorial_summary IS NOT NULL").select(F.col("id").alias("restaurant_id"), F.lit("text").alias("type"), F.col("editorial_summary").alias("content"), F.lit(EDITORIAL_URL).alias("url"))
    kept = sources.join(told.select("restaurant_id", "url"), ["restaurant_id", "url"], "left_anti")
    return after, kept.unionByName(told, allowMissingColumns=True)


def apply_fixes(dishes: DataFrame, fixes: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Fixes (dish_id, field, value) of price or calories that equal the current suggestion (dish_id,
    field, suggested); all others are left out."""
    ok = fixes.where(F.col("field").isin("price", "calories")).join(suggestions.select("dish_id", "field", F.col("suggested").alias("value")).distinct(), ["dish_id", "field", "value"], "left_semi")
    for field in ("price", "calories"):
        delta = ok.where(F.col("field") == field).groupBy(F.col("dish_id").alias("id")).agg(F.max("value").alias(field))
        dishes = update_by(dishes, delta, "id", (field,))
    return dishes


def dismiss(reviews: DataFrame, new: DataFrame, keys: list[str], current: DataFrame) -> DataFrame:
    """Reviews with new ones (keys, fingerprint, ...) upserted whose fingerprint is that of the current
    finding; stale ones are not taken."""
    fresh = new.join(current.select(*keys, "fingerprint").distinct(), [*keys, "fingerprint"], "left_semi")
    return reviews.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def audit_rows(entries: DataFrame) -> DataFrame:
    """Audit entries with the defaults of what they leave out."""
    defaults = {"provider": "unknown", "check_type": "spot_check", "rule": "", "status": "flagged", "detail": ""}
    return entries.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in entries.columns else F.lit(v) for c, v in defaults.items()})


def pending(dishes: DataFrame, classifications: DataFrame) -> DataFrame:
    """Dishes without a classification, or whose latest one was not enriched."""
    last = classifications.groupBy("dish_id").agg(F.max_by("attributes_enriched_at", "id").alias("__at"), F.count("*").alias("__n"))
    return dishes.join(last, F.col("id") == F.col("dish_id"), "left").where("__n IS NULL OR __at IS NULL").select(*[dishes[c] for c in dishes.columns])


def in_batches(rows: DataFrame, key: str, size: int, call: Callable[[list[dict]], list[dict]], schema: str, retry: bool = True) -> DataFrame:
    """Answers of an outside service for batches of rows, from the executors.  Of a batch that was answered
    short the second attempt counts if it accepted more.  ``call`` is the pluggable boundary."""
    import pandas as pd

    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                some = pdf.iloc[at : at + size].to_dict("records")
                best = call(some)
                if retry and len(best) < len(some):
                    again = call(some)
                    best = again if len(again) > len(best) else best
                yield pd.DataFrame(best, columns=names)

    return rows.sortWithinPartitions(key).mapInPandas(run, schema)


def guidance(corrections: DataFrame, most: int = 15) -> DataFrame:
    """One row: the latest active corrections as lines; null without any."""
    last = corrections.where("active").orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    line = F.concat(F.lit("- "), F.col("dish_name"), F.lit(": "), F.col("wrong_verdict"), F.lit(" -> "), F.col("correct_verdict"))
    held = last.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("o"), (-F.col("id")).alias("i"), line.alias("l")))).alias("a"))
    return held.select(F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda s: s.l), "\n")).alias("guidance"))

"""What the views over venues, menus and findings show: predicates, ages and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------------------------------
ADMIN_MODES = ("refresh_on", "refresh_paused", "needs_menu", "scrape_failing", "ready_to_classify", "classified", "stale", "excluded", "no_website", "quality")
REPAIR_MARKERS = (
    "website exists but no menu scraped", "menu suspiciously small", "weak menu score", "only one menu section captured", "partially captured ordering page", "unresolved dynamic menu loader",
)
STALE_DAYS = 30
# --------------------------------------------------------------------------------------------------------------


def age_days(at: Column, now: Column) -> Column:
    """Days and parts of a day since a time, 0 for times to come; null for unknown ones."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0))


def menu_stale(at: Column, now: Column, days: int = STALE_DAYS) -> Column:
    """Captured more than so many days ago; never captured is not stale."""
    return F.coalesce(at.isNotNull() & (age_days(at, now) > days), F.lit(False))


def relative_label(at: Column, now: Column) -> Column:
    """How long ago in words, else null."""
    age = age_days(at, now)
    whole = lambda c: F.floor(c).cast("string")
    label = F.when(age < 1, "today").when(age < 2, "yesterday").when(age < 30, F.concat(whole(age), F.lit(" days ago"))).when(age < 60, "1 month ago").otherwise(F.concat(whole(age / 30), F.lit(" months ago")))
    return F.when(at.isNotNull(), label)


def in_city(address: Column, city: Column) -> Column:
    """The city stands as a part of the address between commas."""
    return F.coalesce(F.lower(address).contains(F.concat(F.lit(", "), F.lower(city), F.lit(","))), F.lit(False))


def repairable(flags: Column, review: Column) -> Column:
    """P20: a finding that no one reviewed, with a flag that says the capture failed."""
    failed = F.exists(flags, lambda f: F.lower(f).rlike("|".join(REPAIR_MARKERS)))
    return F.coalesce(failed, F.lit(False)) & (F.coalesce(review, F.lit("")) == "")


def like_ascii(c: Column, pattern: str) -> Column:
    """P25: ``LIKE`` as SQLite has it: A to Z match in either case, other letters only themselves."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(c, upper, lower).like(pattern.translate(str.maketrans(upper, lower)))


def admin_mode(mode: str, now: Column | None = None) -> Column:
    """One of the ten filters of the venue table, over refresh_enabled, consumer, website_url, has_menu_text,
    crawl_failures, dish_count, menu_fetched_at and flagged (an open quality finding); any other mode shows all."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    site = F.coalesce(F.col("website_url"), F.lit("")) != ""
    dishes = F.coalesce("dish_count", F.lit(0)) > 0
    missing = yes("consumer") & site & ~yes("has_menu_text")
    rules = {
        "refresh_on": yes("refresh_enabled"), "refresh_paused": ~yes("refresh_enabled"), "needs_menu": missing, "scrape_failing": missing & (F.coalesce("crawl_failures", F.lit(0)) > 0),
        "ready_to_classify": yes("has_menu_text") & ~dishes, "classified": dishes, "excluded": ~yes("consumer"), "no_website": ~site, "quality": yes("flagged"),
    }
    if mode == "stale":
        return menu_stale(F.col("menu_fetched_at"), F.current_timestamp() if now is None else now)
    return rules.get(mode, F.lit(True))


def admin_rows(archived: bool = False, area: str = "all", search: str = "") -> Column:
    """The rows that any mode looks at: archived ones or the others, of one area or ``metro:`` name, whose name
    or address holds the search text."""
    own = F.coalesce(F.col("archived"), F.lit(False)) == F.lit(archived)
    district = F.coalesce(F.nullif("area", F.lit("")), F.lit("Unknown"))
    if area.startswith("metro:"):
        own = own & (F.coalesce(F.nullif("metro", F.lit("")), district) == area.removeprefix("metro:"))
    elif area != "all":
        own = own & (district == area)
    q = search.strip().lower()
    holds = lambda c: F.coalesce(F.lower(c).contains(q), F.lit(False))
    return own & (holds("name") | holds("address")) if q else own

"""Which of the pages of a crawl are kept: best first, no text inside another, one ordering platform, a budget.

Choosing is greedy, so it is done in rounds.  A round takes the next few pages of each key and folds them in order
over what is kept; the budget bounds that, so it fits one row.  All other pages then meet their key's row: those
that no longer fit, or whose text is in a kept one or holds one, are done with.  Every round keeps a page for each key
that has any left, a kept page uses up ``least`` characters at least, and no key's pages ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_set_hash
from ..sources.tables import settled
from .community import structured_counts
from .weblinks import ordering_host, visit_key

# --- fixed values: what makes pages worth keeping ------------------------------------------------------------
LEAST_CHARS, MOST_CHARS = 200, 50_000
ORDERING_PRICES = 8
STRONG, WEAK, SECTIONS = 0.75, 0.6, 2
# --------------------------------------------------------------------------------------------------------------
#: Pages of a key that a round folds.
ROUND = 32


def chosen_pages(pages: DataFrame, key: str, page: str, text: str, order: list[Column], least: int = LEAST_CHARS, most: int = MOST_CHARS, size: int = ROUND) -> DataFrame:
    """(key, kept): the pages kept of each key, an array of (page, text) in the order in which they were taken.

    In the order given, a page is taken if its text has ``least`` characters, is in no taken text and holds none, and
    with the taken ones has at most ``most`` characters (the first always fits).  ``order`` should tell all pages of a key
    apart.  Null texts aren't taken; null keys are a key.  A key without a page to take has no row.
    """
    left = pages.select(F.col(key).alias("k"), F.struct(*order).alias("o"), F.col(page).alias("page"), F.col(text).alias("text")).where(F.length("text") >= least)
    left = settled(left)  # the first round reads it twice
    one = f"struct<page: {left.schema['page'].dataType.simpleString()}, text: string>"
    none = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast(f"array<{one}>").alias("kept"))
    shape = f"struct<total: bigint, kept: array<{one}>>"

    def take(acc, x):
        clash = F.exists(acc["kept"], lambda k: k["text"].contains(x["text"]) | x["text"].contains(k["text"]))
        over = (F.size(acc["kept"]) > 0) & (acc["total"] + F.length(x["text"]) > most)
        more = F.struct((acc["total"] + F.length(x["text"])).alias("total"), F.concat(acc["kept"], F.array(F.struct(x["page"].alias("page"), x["text"].alias("text")))).alias("kept"))
        return F.when(clash | over, acc).otherwise(more.cast(shape))

    state = None
    while True:
        ranked = left.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("o"))).where(F.col("n") <= size)
        turns = ranked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "page", "text"))).alias("turns"), F.max("o").alias("upto"))
        if state is None:
            state = turns.select("k", "upto", F.aggregate("turns", none.cast(shape), take).alias("acc"))
        else:
            before = state.select(F.col("k").alias("k_"), "acc", F.col("upto").alias("was"))
            state = before.join(turns, F.col("k_").eqNullSafe(F.col("k")), "left").select(F.col("k_").alias("k"), F.coalesce("upto", "was").alias("upto"), F.when(F.col("turns").isNull(), F.col("acc")).otherwise(F.aggregate("turns", F.col("acc"), take)).alias("acc"))
        state = settled(state)
        done = state.select(F.col("k").alias("k_"), "acc", "upto")
        room = left.join(done, F.col("k").eqNullSafe(F.col("k_"))).where(F.col("o") > F.col("upto")).where(F.length("text") <= most - F.col("acc.total"))
        left = settled(room.where(~F.exists("acc.kept", lambda x: x["text"].contains(F.col("text")) | F.col("text").contains(x["text"]))).select("k", "o", "page", "text"))
        if left.isEmpty():
            return state.select(F.col("k").alias(key), "acc.kept")


def keep_pages(pages: DataFrame, key: str, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """(key, page, place): pages of (key, page, text, score, is_menu) best first, until ``most`` characters
    are kept: one that does not fit is skipped (the first always fits), and so is one that a kept text
    contains or that contains one.  Ties go by page."""
    kept = chosen_pages(pages.where("is_menu"), key, "page", "text", [(-F.col("score")).alias("s"), F.col("page").alias("p")], least, most)
    return kept.select(key, F.posexplode(F.transform("kept", lambda x: x["page"])).alias("place", "page")).select(key, "page", F.col("place").cast("long").alias("place"))


def finished(pages: DataFrame, landing: DataFrame, key: str, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """(key, status, best_url, score, urls, text, content_hash, products, categories) of each key's crawl.

    ``pages`` has key, place (their order), url, text, score, prices, sections and is_menu; ``landing`` has key and
    landing, the address asked for.  The first page of each url counts.  ``status`` is ``ok``, ``too_little_text`` or
    ``no_menu``, by the page of the best score (the first of equals).  Kept are menu pages, best first, of one ordering platform at
    most: that of the strongest page with a menu's worth of prices.  Beside a strong page, a weak landing page
    without prices and sections goes.  ``urls`` are those kept; ``text`` is all of them under their addresses, or the best page's if
    it is alone.  Where status isn't ok there are no urls, and text is the best page's.  Null texts count as empty.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("place").alias("p"))
    first = pages.groupBy(F.col(key).alias("k"), "url").agg(F.min_by(F.struct("place", F.coalesce("text", F.lit("")).alias("text"), "score", "prices", "sections", "is_menu"), "place").alias("x")).select("k", "url", "x.*")
    first = first.withColumns({"host": ordering_host(F.col("url")), "o": order})
    platform = F.when(F.col("is_menu") & (F.col("prices") >= ORDERING_PRICES) & F.col("host").isNotNull(), F.struct(F.col("o.s"), (-F.col("prices")).alias("n"), F.col("place"), F.col("host")))
    tops = settled(first.groupBy("k").agg(F.min_by(F.struct("url", "text", "score", "is_menu"), "o").alias("best"), F.min(platform)["host"].alias("platform")))
    status = F.when(F.length("best.text") < least, "too_little_text").when(~F.col("best.is_menu"), "no_menu").otherwise("ok")
    tops = tops.join(landing.select(F.col(key).alias("l"), visit_key(F.col("landing")).alias("landing")), F.col("k").eqNullSafe(F.col("l")), "left").select("k", "best", "platform", "landing", status.alias("status"))
    mine = first.join(tops.where("status = 'ok'").select(F.col("k").alias("t"), F.col("best.score").alias("top"), "platform", "landing"), F.col("k").eqNullSafe(F.col("t")))
    weak = (F.col("top") >= STRONG) & visit_key(F.col("url")).eqNullSafe(F.col("landing")) & (F.col("score") < WEAK) & (F.col("prices") == 0) & (F.col("sections") < SECTIONS)
    other = F.coalesce(F.col("host") != F.col("platform"), F.lit(False))
    kept = chosen_pages(mine.where(F.col("is_menu") & ~other & ~weak), "k", "url", "text", [F.col("o")], least, most).withColumnRenamed("k", "c")
    rows = tops.join(kept, F.col("k").eqNullSafe(F.col("c")), "left").withColumn("kept", F.when(F.col("status") == "ok", F.coalesce("kept", F.array().cast(kept.schema["kept"].dataType))))
    text = F.when(F.size("kept") > 1, F.array_join(F.transform("kept", lambda x: F.concat(F.lit("[page: "), x["page"], F.lit("]\n"), x["text"])), "\n\n")).otherwise(F.col("best.text"))
    rows = rows.select("k", "status", "best", "kept", text.alias("text"))
    hashed = F.when(F.col("status") == "ok", page_set_hash(F.filter(F.transform("kept", lambda x: x["text"]), lambda t: t.rlike(r"\S"))))
    counts = structured_counts(F.col("text"))
    return rows.select(F.col("k").alias(key), "status", F.col("best.url").alias("best_url"), F.col("best.score").alias("score"), F.transform("kept", lambda x: x["page"]).alias("urls"), "text", hashed.alias("content_hash"), counts["products"].alias("products"), counts["categories"].alias("categories"))

"""Queries of the views: the venue table's filters, pins, ages, threads, whole orders, scores with the real words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.documents import FOOD_WORDS, GIFT_WORDS, SECTION_WORDS, detached_prices, menu_signals
from ..functions.search import rank_keys
from ..functions.views import ADMIN_MODES, admin_mode, admin_rows, in_city, like_ascii, menu_stale, relative_label, repairable
from ..operators.community import bad_replies, notifications, resolved_favourites
from ..operators.extract import internal_links
from ..operators.identity import upsert_dishes
from ..operators.locate import filter_pages
from ..operators.ranks import ranked
from ..operators.rollups import pins
from ..sources.tables import table
from . import stepwise_sql
from .registry import query
from .stand_ins import DISHES_SQL, PLACE_SQL, all_dishes, with_place

Spark, Frame = SparkSession, DataFrame
_NOW = "TIMESTAMP '1998-06-01 12:00:00'"
_ALL_DISHES = DISHES_SQL.replace(" WHERE l_quantity >= 48)", ")")

_VENUES = f"""v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_name END AS name, c_mktsegment || ' Street 5, Town ' || c_custkey % 30 || ', FL' AS address, c_custkey % 11 = 0 AS archived,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN '' ELSE 'Area ' || c_custkey % 5 END AS area, CASE WHEN c_custkey % 3 = 0 THEN 'Metro ' || c_custkey % 2 END AS metro, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 = 1 END AS refresh_enabled,
  c_custkey % 5 <> 0 AS consumer, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://x' END AS website_url, c_custkey % 3 = 1 AS has_menu_text, CASE WHEN c_custkey % 10 < 4 THEN c_custkey % 10 END AS crawl_failures,
  CASE WHEN c_custkey % 8 < 5 THEN c_custkey % 8 END AS dish_count, CASE WHEN c_custkey % 13 > 1 THEN {_NOW} - INTERVAL 1 HOUR * CAST(c_custkey * 97 % 2000 AS INTEGER) END AS menu_fetched_at, c_custkey % 17 = 0 AS flagged FROM customer)"""


def venues(spark: Spark, sf: str) -> Frame:
    """The venue table's rows, from customers."""
    k = F.col("c_custkey")
    s = k.cast("string")
    text = lambda name, n: F.concat(F.lit(name), (k % n).cast("string"))
    return table(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 9 != 0, F.col("c_name")).alias("name"), F.concat("c_mktsegment", F.lit(" Street 5, Town "), (k % 30).cast("string"), F.lit(", FL")).alias("address"), (k % 11 == 0).alias("archived"),
        F.when(k % 7 == 1, "").when(k % 7 != 0, text("Area ", 5)).alias("area"), F.when(k % 3 == 0, text("Metro ", 2)).alias("metro"), F.when(k % 4 != 0, k % 4 == 1).alias("refresh_enabled"), (k % 5 != 0).alias("consumer"),
        F.when(k % 6 == 1, "").when(k % 6 != 0, "https://x").alias("website_url"), (k % 3 == 1).alias("has_menu_text"), F.when(k % 10 < 4, k % 10).alias("crawl_failures"), F.when(k % 8 < 5, k % 8).alias("dish_count"),
        F.when(k % 13 > 1, F.expr(f"{_NOW} - make_interval(0, 0, 0, 0, cast(c_custkey * 97 % 2000 as int))")).alias("menu_fetched_at"), (k % 17 == 0).alias("flagged"), s.alias("label"),
    )


@query(f"""WITH {_VENUES}, m AS (SELECT unnest({list(ADMIN_MODES) + ["all"]!r}) AS mode)
SELECT mode, count(*) AS n, sum(id) AS ids FROM m, v WHERE NOT archived AND CASE mode WHEN 'refresh_on' THEN coalesce(refresh_enabled, false) WHEN 'refresh_paused' THEN NOT coalesce(refresh_enabled, false)
  WHEN 'needs_menu' THEN consumer AND coalesce(website_url, '') <> '' AND NOT has_menu_text WHEN 'scrape_failing' THEN consumer AND coalesce(website_url, '') <> '' AND NOT has_menu_text AND coalesce(crawl_failures, 0) > 0
  WHEN 'ready_to_classify' THEN has_menu_text AND coalesce(dish_count, 0) = 0 WHEN 'classified' THEN coalesce(dish_count, 0) > 0 WHEN 'stale' THEN coalesce(menu_fetched_at < {_NOW} - INTERVAL 30 DAY, false)
  WHEN 'excluded' THEN NOT consumer WHEN 'no_website' THEN coalesce(website_url, '') = '' WHEN 'quality' THEN flagged ELSE true END GROUP BY mode
UNION ALL SELECT 'archived', count(*), sum(id) FROM v WHERE archived AND coalesce(nullif(area, ''), 'Unknown') = 'Unknown'
UNION ALL SELECT 'metro', count(*), sum(id) FROM v WHERE NOT archived AND coalesce(metro, nullif(area, ''), 'Unknown') = 'Metro 1'
UNION ALL SELECT 'search', count(*), sum(id) FROM v WHERE NOT archived AND (contains(lower(coalesce(name, '')), 'town 7') OR contains(lower(address), 'town 7'))""")
def q_admin_modes(spark: Spark, sf: str) -> Frame:
    """How many venues each filter of the venue table shows, and of an area, a metro and a search."""
    rows, now = venues(spark, sf), F.expr(_NOW)
    parts = {**{m: admin_rows() & admin_mode(m, now) for m in (*ADMIN_MODES, "all")}, "archived": admin_rows(True, "Unknown"), "metro": admin_rows(False, "metro:Metro 1"), "search": admin_rows(search=" TOWN 7 ")}
    shown = rows.select("id", F.explode(F.filter(F.array(*[F.when(c, m) for m, c in parts.items()]), lambda x: x.isNotNull())).alias("mode"))
    return shown.groupBy("mode").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {_VENUES} SELECT id, contains(lower(address), ', town 7,') AS town, contains(lower(address), ', machinery,') AS street FROM v""")
def q_in_city(spark: Spark, sf: str) -> Frame:
    """Whether an address is in a city."""
    return venues(spark, sf).select("id", in_city(F.col("address"), F.lit("Town 7")).alias("town"), in_city(F.col("address"), F.lit("Machinery")).alias("street"))


@query(f"""WITH {_VENUES}, a AS (SELECT id, menu_fetched_at, epoch_us({_NOW}) - epoch_us(menu_fetched_at) AS us FROM v), d AS (SELECT *, us / 86400000000.0::DOUBLE AS age FROM a)
SELECT id, coalesce(age > 30, false) AS stale, CASE WHEN age IS NULL THEN NULL WHEN age < 1 THEN 'today' WHEN age < 2 THEN 'yesterday' WHEN age < 30 THEN CAST(floor(age) AS INTEGER) || ' days ago' WHEN age < 60 THEN '1 month ago' ELSE CAST(floor(age / 30) AS INTEGER) || ' months ago' END AS label FROM d""")
def q_menu_ages(spark: Spark, sf: str) -> Frame:
    """Whether a menu is stale, and how long ago it was captured."""
    at, now = F.col("menu_fetched_at"), F.expr(_NOW)
    return venues(spark, sf).select("id", menu_stale(at, now).alias("stale"), relative_label(at, now).alias("label"))


@query(r"""SELECT p_partkey, (p_size % 4 > 1 AND p_size % 3 = 0) AS repair, regexp_matches(p_type, '(?s)^.*[pP][rR][oO].*$') OR p_size % 5 = 0 AS social FROM part""")
def q_repairable(spark: Spark, sf: str) -> Frame:
    """P20, P25: findings to repair, and texts like a pattern."""
    size = F.col("p_size")
    flags = F.array(F.lit("stale"), F.when(size % 4 == 2, "Weak MENU score (0.31)").when(size % 4 == 3, "website exists but no menu scraped").otherwise("weak score"))
    review = F.when(size % 3 == 1, "verified").when(size % 3 == 2, "known_issue").when(size % 6 == 0, "")
    said = F.when(size % 5 == 0, "It is a SOCIAL\nprofile page, PRO").otherwise(F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", repairable(flags, review).alias("repair"), like_ascii(said, "%Pro%").alias("social"))


@query(f"""WITH {_ALL_DISHES}, p AS (SELECT d.*, l_orderkey * 100 + l_linenumber AS place, {PLACE_SQL.format(k="restaurant_id")} FROM dishes d WHERE verdict <> 'not_vegan'),
s AS (SELECT *, CASE WHEN restaurant_id % 10 = 0 THEN NULL ELSE lat END AS spot FROM p)
SELECT restaurant_id, arg_min(name, (place, l_extendedprice)) AS restaurant_name, arg_min(verdict, (place, l_extendedprice)) AS verdict, any_value(lat) AS lat, count(*) AS count FROM s WHERE spot IS NOT NULL GROUP BY restaurant_id""")
def q_pins(spark: Spark, sf: str) -> Frame:
    """A pin for each venue with shown dishes."""
    rows = with_place(all_dishes(spark, sf).where("verdict <> 'not_vegan'"), "restaurant_id")
    rows = rows.withColumns({"place": F.struct(F.col("l_orderkey") * 100 + F.col("l_linenumber"), "l_extendedprice"), "restaurant_name": F.col("name"), "lat": F.when(F.col("restaurant_id") % 10 != 0, F.col("lat"))})
    return pins(rows, context=("restaurant_name", "verdict", "lat")).select("restaurant_id", "restaurant_name", "verdict", "lat", "count")


_ORDER = "CASE verdict WHEN 'vegan' THEN 0 WHEN 'likely_vegan' THEN 1 WHEN 'vegan_adaptable' THEN 2 WHEN 'not_vegan' THEN 4 ELSE 3 END"


@query(f"""WITH {_ALL_DISHES}, d AS (SELECT *, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id, {_ORDER} AS tier, CASE WHEN serving_role = 'side' THEN 1 ELSE 0 END AS role, CASE WHEN contains(name, 'red') THEN 12 ELSE 1 END AS score,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey % 6 END AS rating FROM dishes),
r AS (SELECT id, l_extendedprice, row_number() OVER (ORDER BY tier, score DESC, role, rating DESC NULLS LAST, confidence DESC NULLS LAST, name NULLS LAST, id, l_extendedprice, l_quantity, created_at) AS searching,
  row_number() OVER (ORDER BY role, tier, p_retailprice NULLS LAST, name NULLS LAST, id, l_extendedprice, l_quantity, created_at) AS browsing FROM d)
SELECT id, l_extendedprice, searching, browsing FROM r""")
def q_rank_dishes(spark: Spark, sf: str) -> Frame:
    """The place of every dish among all, while searching and while browsing by price."""
    rows = all_dishes(spark, sf).withColumns({
        "id": F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"), "score": F.when(F.col("name").contains("red"), 12).otherwise(1), "rating": F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey") % 6), "price_value": F.col("p_retailprice"),
    }).select("id", "verdict", "serving_role", "score", "rating", "confidence", "name", "price_value", "l_extendedprice", "l_quantity", "created_at")
    last = [F.col("l_extendedprice"), F.col("l_quantity"), F.col("created_at")]
    first = ranked(rows, [*rank_keys("recommended", True), *last], out="searching")
    return ranked(first, [*rank_keys("price", False), *last], out="browsing").select("id", "l_extendedprice", F.col("searching").cast("long").alias("searching"), F.col("browsing").cast("long").alias("browsing"))


_COMMENTS = """c AS (SELECT conv_id * 100 + turn AS id, CASE WHEN turn > 0 AND conv_id % 5 <> 0 THEN conv_id * 100 + turn - 1 WHEN turn > 0 THEN conv_id * 100 + 99 END AS parent_id, CASE WHEN turn % 4 = 3 THEN -1 ELSE conv_id % 50 END AS place_id, 'u' || (conv_id + turn) % 20 AS user_id,
  CASE WHEN turn % 3 = 1 THEN ['u' || conv_id % 20, 'u3'] ELSE [] END AS mentioned, turn AS created_at FROM conversations)"""


def comments(spark: Spark, sf: str) -> Frame:
    """Comments from conversations: some replies lost their parent, some stand at another place."""
    c, t = F.col("conv_id"), F.col("turn")
    user = lambda n: F.concat(F.lit("u"), (n % 20).cast("string"))
    return table(spark, sf, "conversations").select(
        (c * 100 + t).alias("id"), F.when((t > 0) & (c % 5 != 0), c * 100 + t - 1).when(t > 0, c * 100 + 99).alias("parent_id"), F.when(t % 4 == 3, -1).otherwise(c % 50).alias("place_id"), user(c + t).alias("user_id"),
        F.when(t % 3 == 1, F.array(user(c), F.lit("u3"))).otherwise(F.array().cast("array<string>")).alias("mentioned"), t.alias("created_at"),
    )


@query(f"WITH {_COMMENTS} SELECT a.id, a.parent_id FROM c a LEFT JOIN c b ON b.id = a.parent_id WHERE a.parent_id IS NOT NULL AND (b.id IS NULL OR b.place_id <> a.place_id)")
def q_bad_replies(spark: Spark, sf: str) -> Frame:
    """Replies without their parent at the same place."""
    return bad_replies(comments(spark, sf)).select("id", "parent_id")


@query(f"""WITH {_COMMENTS}, r AS (SELECT a.id FROM c a JOIN c b ON b.id = a.parent_id WHERE b.user_id = 'u3' AND a.user_id <> 'u3')
SELECT id, 'reply' AS kind FROM r UNION ALL SELECT id, 'mention' FROM c WHERE user_id <> 'u3' AND list_contains(mentioned, 'u3') AND id NOT IN (SELECT id FROM r)""")
def q_notifications(spark: Spark, sf: str) -> Frame:
    """Replies to a user and mentions of them."""
    return notifications(comments(spark, sf), "u3").select("id", "kind")


@query("""WITH d AS (SELECT p_partkey % 100 AS place_id, replace(p_name, ' ', '-') AS dish_key, min(p_partkey) AS id FROM part GROUP BY 1, 2)
SELECT o_orderkey, coalesce(d.id, CASE WHEN o_custkey % 2 = 0 THEN o_custkey END) AS dish_id FROM orders LEFT JOIN d ON d.place_id = o_custkey % 120 AND d.dish_key = CASE WHEN o_orderkey % 3 = 0 THEN 'red-widget' WHEN o_orderkey % 3 = 1 THEN 'cold-ring' ELSE 'none' END""")
def q_favourites(spark: Spark, sf: str) -> Frame:
    """The dish of each favourite, by place and key, else by its local id."""
    parts = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("place_id"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("dish_key"), F.col("p_partkey").alias("id"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wished = table(spark, sf, "orders").select("o_orderkey", (c % 120).alias("place_id"), F.when(k % 3 == 0, "red-widget").when(k % 3 == 1, "cold-ring").otherwise("none").alias("dish_key"), F.when(c % 2 == 0, c).alias("local_id"))
    return resolved_favourites(wished, parts).select("o_orderkey", "dish_id")


@query("""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (doc_id + i - 1) % 7 < doc_id % 5 THEN ' $' || ((i - 1) % 40) || '.50' ELSE x END) AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM l), b AS (SELECT *, regexp_full_match(x, '[ \t\r\f\v]*\\$?[ \t\r\f\v]?[0-9]{1,3}(\\.[0-9]{2})?[ \t\r\f\v]*') AS bare FROM i),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, bare ORDER BY i) AS g FROM b), r AS (SELECT doc_id, bare, g, count(*) AS n FROM g GROUP BY doc_id, bare, g)
SELECT doc_id, max(CASE WHEN bare THEN n ELSE 0 END) > 2 AS detached FROM r GROUP BY doc_id""")
def q_detached_prices(spark: Spark, sf: str) -> Frame:
    """Texts with more than two lines in a row that hold a price alone."""
    i = F.col("doc_id")
    lines = F.transform(F.split("text", "\n"), lambda x, n: F.when((i + n) % 7 < i % 5, F.concat(F.lit(" $"), (n % 40).cast("string"), F.lit(".50"))).otherwise(x))
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", detached_prices(F.array_join(lines, "\n")).alias("detached"))


@query("""WITH l AS (SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
a AS (SELECT page_id, i, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS address FROM l WHERE rtrim(regexp_extract(url, '^(https?://[^/?#]+)', 1) || href, '/') <> rtrim(regexp_replace(url, '#.*$', ''), '/'))
SELECT page_id, address FROM a GROUP BY page_id, address""")
def q_internal_links(spark: Spark, sf: str) -> Frame:
    """The pages of the same site that each page leads to."""
    return internal_links(table(spark, sf, "pages"), keep=("page_id",)).select("page_id", "address")


@query(rf"""WITH t AS (SELECT doc_id, lower(text) AS low, text FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Grilled cheesecake . . . 9' || chr(10) || 'Soup - $4.50 gift cards' || chr(10) || 'onionion tart' ELSE '' END AS text FROM documents WHERE text IS NOT NULL)),
s AS (SELECT doc_id, {stepwise_sql.counted(FOOD_WORDS)} AS food, {" + ".join(f"contains(low, '{w}')::INT" for w in SECTION_WORDS)} AS sections, {stepwise_sql.counted(GIFT_WORDS)} AS gifts FROM t)
SELECT doc_id, CAST(food AS INTEGER) AS food, sections, CAST(gifts AS INTEGER) AS gifts FROM s""")
def q_menu_words(spark: Spark, sf: str) -> Frame:
    """The counts of all menu words in each text."""
    more = F.when(F.col("doc_id") % 4 == 0, "\nGrilled cheesecake . . . 9\nSoup - $4.50 gift cards\nonionion tart").otherwise("")
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.concat("text", more).alias("text")).withColumn("low", F.lower("text"))
    x = menu_signals(F.col("text"), low=F.col("low"))
    return docs.select("doc_id", *[x[k].alias(k) for k in ("food", "sections", "gifts")])


@query(f"""WITH c AS (SELECT s_suppkey, {PLACE_SQL.format(k="s_suppkey")}, 500.0 * (s_suppkey % 8) AS radius FROM supplier),
n AS (SELECT *, CASE WHEN radius <= 1000 THEN 0 ELSE CAST(ceil(radius / 1000) AS BIGINT) END AS n FROM c),
g AS (SELECT s_suppkey, lat AS lat0, lng AS lng0, radius, lat + i * (1000 / 111320.0::DOUBLE) AS lat, lng + j * (1000 / (111320.0::DOUBLE * cos(radians(lat)))) AS lng FROM n, range(-4, 5) a(i), range(-4, 5) b(j) WHERE i BETWEEN -n AND n AND j BETWEEN -n AND n),
h AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2) AS a FROM g)
SELECT s_suppkey, count(*) AS cells, count(*) * 2 AS base_calls, round(least(count(*) * 2, 1500) * 0.035::DOUBLE, 2) AS cost FROM h WHERE 6371008.8::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)) <= radius + 1000 GROUP BY s_suppkey""")
def q_sweep_cells(spark: Spark, sf: str) -> Frame:
    """The cells, calls and cost of a sweep around each supplier."""
    circles = with_place(table(spark, sf, "supplier"), "s_suppkey").withColumn("radius", F.lit(500.0) * (F.col("s_suppkey") % 8))
    return geo.estimates(circles, "s_suppkey").select("s_suppkey", "cells", "base_calls", "cost")


def dish_rows(spark: Spark, sf: str) -> Frame:
    """Dishes with few names, prices, descriptions and calories, from parts."""
    size, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf, "part").select((k % 40).alias("restaurant_id"), k.alias("id"), F.when(k % 2 == 0, F.upper("p_type")).otherwise(F.col("p_type")).alias("name"), F.when(size % 3 != 0, F.concat(F.lit("$"), (size % 2 + 8).cast("string"))).alias("price"),
        F.when(size % 4 == 1, "hot").when(size % 4 == 2, "HOT!").when(size % 4 == 3, "mild").alias("raw_description"), F.when(k % 5 == 0, "90 cal").when(k % 5 == 1, "80 cal").alias("calories"), (size % 7).cast("long").alias("latest_cls"))


@query(stepwise_sql.UPSERT_DISHES)
def q_upsert_dishes(spark: Spark, sf: str) -> Frame:
    """What happens to each captured dish, a third of the parts, against the others."""
    rows = dish_rows(spark, sf)
    return upsert_dishes(rows.where("id % 3 <> 0"), rows.where("id % 3 = 0"))


_SLUGS = ("eemenu", "jaxmenu", "dinner-menu", "dpmenu", "about", "menus")


@query(f"""
WITH p AS (SELECT o_orderkey, o_custkey AS r, list_extract({list(_SLUGS)!r}, 1 + CAST(o_orderkey % 6 AS INTEGER)) AS slug, 'https://d.example/x' || o_orderkey % 2 AS parent, o_orderkey % 4 AS own, o_orderkey % 5 AS city FROM orders),
u AS (SELECT *, parent || '/' || slug || CASE WHEN o_orderkey % 9 = 0 THEN '#structured-menu' ELSE '' END AS url, parent || '/' || slug AS base, slug IN ('eemenu', 'jaxmenu', 'dpmenu') AS sibling FROM p),
b AS (SELECT r, parent, base, max(own * 2) AS a, max(city) AS b FROM u WHERE sibling AND r % 7 <> 0 GROUP BY r, parent, base),
m AS (SELECT r, parent, max(a) AS ma, max(b) AS mb, count(*) AS n FROM b GROUP BY r, parent),
g AS (SELECT b.r, b.base FROM b JOIN m ON m.r = b.r AND m.parent = b.parent WHERE n > 1 AND CASE WHEN ma >= 2 THEN a * 2 < ma WHEN mb >= 2 THEN b * 2 < mb ELSE false END)
SELECT o_orderkey, url FROM u WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.r = u.r AND g.base = u.base)""")
def q_filter_pages(spark: Spark, sf: str) -> Frame:
    """the pages of each record without sibling menus of other places."""
    k, r = F.col("o_orderkey"), F.col("o_custkey")
    slug = F.get(F.array(*[F.lit(x) for x in _SLUGS]), (k % 6).cast("int"))
    url = F.concat(F.lit("https://d.example/x"), (k % 2).cast("string"), F.lit("/"), slug, F.when(k % 9 == 0, "#structured-menu").otherwise(""))
    text = F.concat(F.lit("Menu. "), F.repeat(F.lit("Corrine Dr. 3201! "), (k % 4).cast("int")), F.lit("and "), F.repeat(F.lit("Winter  Park, "), (k % 5).cast("int")))
    pages = table(spark, sf, "orders").select("o_orderkey", r.alias("restaurant_id"), url.alias("url"), text.alias("text"), F.when(r % 7 != 0, "3201 Corrine Dr, Winter Park, FL 32803, USA").alias("address"))
    return filter_pages(pages).select("o_orderkey", "url")

"""Rules of sites and runs, and column functions, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import menu_signals
from ..functions.scoring import clamp, soft_agreement, veganish
from ..functions.text import calorie_label, catalogue_price, evidence_split, holds_all, json_unescaped, listed_addresses, menu_hash, names_overlap, price_level_rank, price_level_symbol, server_error_page, shared_items, sibling_slug, single_section_url, valid_username
from ..operators import site_rules
from ..operators.community import mention_counts, new_lines, notes_by_place, pdf_date, stale, structured_counts
from ..operators.locate import SECTION_WORDS
from ..operators.updates import audit_rows, dismiss, pending, update, update_by
from ..sources.tables import table
from .registry import query

Spark, Frame = SparkSession, DataFrame

#: White space of web pages, as RE2 writes it.
_WHITE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_ODD = "chr(160) || ' ' || chr(10) || chr(9) || chr(10) || chr(8195) || 'x' || chr(160) || chr(8232) || 'two  words' || chr(160)"


def _odd_lines(c: F.Column) -> F.Column:
    """A text with lines that hold other white space than spaces alone."""
    return F.concat(c, F.lit("\xa0 \n\t\n x\xa0 two  words\xa0"))


@query(rf"""SELECT doc_id, CAST(len(l) AS INTEGER) AS lines, CAST(len(list_filter(l, lambda x: length(x) BETWEEN 3 AND 80)) AS INTEGER) AS short_lines FROM (
  SELECT doc_id, list_filter(list_transform(string_split_regex(text || {_ODD}, '\r\n|[\n\r\x0B\f\x{{1C}}-\x{{1E}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: regexp_replace(x, '^{_WHITE}+|{_WHITE}+$', '', 'g')), lambda x: x <> '') AS l FROM documents)""")
def q_menu_lines(spark: Spark, sf: str) -> Frame:
    """Lines at any line end, stripped of any white space."""
    signals = menu_signals(_odd_lines(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", signals["lines"].alias("lines"), signals["short_lines"].alias("short_lines"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text || {_ODD}, '{_WHITE}+', ' ', 'g'))) AS digest FROM documents")
def q_menu_hash(spark: Spark, sf: str) -> Frame:
    """a digest that no white space changes."""
    return table(spark, sf, "documents").select("doc_id", menu_hash(_odd_lines(F.col("text"))).alias("digest"))


_PAGES_SQL = """p AS (SELECT page_id % 40 AS restaurant_id, page_id, 'https://www.site' || page_id % 40 || '.example/menu/' || page_id % 7
  || CASE WHEN page_id % 40 < 20 AND page_id % 3 = 0 THEN '/brunch' WHEN page_id % 40 < 20 AND page_id % 3 = 1 THEN '/Dinner/' WHEN page_id % 5 = 0 THEN '/#top' ELSE '' END AS url FROM pages)"""


def _site_pages(spark: Spark, sf: str) -> Frame:
    i = F.col("page_id")
    tail = F.when((i % 40 < 20) & (i % 3 == 0), "/brunch").when((i % 40 < 20) & (i % 3 == 1), "/Dinner/").when(i % 5 == 0, "/#top").otherwise("")
    url = F.concat(F.lit("https://www.site"), (i % 40).cast("string"), F.lit(".example/menu/"), (i % 7).cast("string"), tail)
    return table(spark, sf, "pages").select((i % 40).alias("restaurant_id"), "page_id", url.alias("url"))


@query(f"""WITH {_PAGES_SQL}, w AS (SELECT i - 1 AS i, ['dinner', 'lunch', 'brunch', 'breakfast', 'happy-hour', 'wine', 'dessert', 'desserts', 'drinks'][i] AS word FROM range(1, 10) t(i)),
b AS (SELECT restaurant_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS base, min(page_id) AS o FROM p GROUP BY ALL),
k AS (SELECT *, CASE WHEN lower(regexp_extract(base, '([^/]*)$', 1)) IN (SELECT word FROM w) THEN 1 ELSE 2 END AS kind FROM b),
m AS (SELECT k.restaurant_id, o, w.i, base, CASE WHEN kind = 1 THEN regexp_replace(base, '/[^/]*$', '') ELSE base END || '/' || word AS url FROM k, w
  WHERE kind = (SELECT min(x.kind) FROM k x WHERE x.restaurant_id = k.restaurant_id)),
f AS (SELECT restaurant_id, url, min((o, i)) AS seat FROM m WHERE url <> base AND NOT EXISTS (SELECT 1 FROM p WHERE p.restaurant_id = m.restaurant_id
  AND regexp_replace(regexp_replace(p.url, '#.*$', ''), '/+$', '') = m.url) GROUP BY ALL)
SELECT restaurant_id, url, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY restaurant_id ORDER BY seat, url) AS place FROM f) WHERE place <= 12""")
def q_daypart_probes(spark: Spark, sf: str) -> Frame:
    """Pages of other parts of the day that a record does not have yet."""
    return site_rules.daypart_probes(_site_pages(spark, sf), "restaurant_id", "url", "page_id")


@query("""WITH u AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '/a/' || page_id % 9 || 'Town-menu/' WHEN page_id % 4 = 1 THEN '/dinner-menu' WHEN page_id % 4 = 2 THEN '/x/lakemenus' ELSE '/menu' END AS path FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/a' WHEN 2 THEN '/x' END AS parent, CASE page_id % 4 WHEN 0 THEN page_id % 9 || 'town' WHEN 2 THEN 'lake' END AS prefix FROM u""")
def q_sibling_slugs(spark: Spark, sf: str) -> Frame:
    """words before "menu" that tell places apart."""
    i = F.col("page_id")
    path = F.when(i % 4 == 0, F.concat(F.lit("/a/"), (i % 9).cast("string"), F.lit("Town-menu/"))).when(i % 4 == 1, "/dinner-menu").when(i % 4 == 2, "/x/lakemenus").otherwise("/menu")
    got = sibling_slug(F.concat(F.lit("https://x.example"), path, F.lit("#top")), SECTION_WORDS)
    return table(spark, sf, "pages").select("page_id", got["parent"].alias("parent"), got["prefix"].alias("prefix"))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def q_enrichment_targets(spark: Spark, sf: str) -> Frame:
    """Restaurants that lack something."""
    k = F.col("c_custkey")
    some = lambda n: F.when(k % n != 0, F.col("c_acctbal"))
    rows = table(spark, sf, "customer").select(k.alias("id"), some(3).alias("enriched_at"), some(5).alias("user_rating_count"), some(7).alias("hours_enriched_at"))
    return site_rules.enrichment_targets(rows).select("id")


@query("SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'stale_days' WHEN n_chars % 1200 = 0 OR n_chars % 1200 > 1000 THEN 'restaurant_ids' END AS error FROM documents")
def q_request_checks(spark: Spark, sf: str) -> Frame:
    """Requests of 1 to 1,000 ids and a positive age."""
    n = F.col("n_chars") % 1200
    ids = F.when(n == 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(1).cast("long"), n.cast("long")))
    return table(spark, sf, "documents").select("doc_id", site_rules.request_errors(ids, F.col("n_chars") % 4).alias("error"))


@query("SELECT doc_id, lang, n_chars FROM documents")
def q_fields(spark: Spark, sf: str) -> Frame:
    """The listed fields that a table has."""
    return site_rules.whitelisted(table(spark, sf, "documents"), ("doc_id", "name", "lang", "n_chars", "verdict"))


@query("SELECT least(100, count(*)) AS n, least(100, count(*)) AS ids FROM documents")
def q_random_rows(spark: Spark, sf: str) -> Frame:
    """A random sample without repeats."""
    return site_rules.random_rows(table(spark, sf, "documents"), 100, 7).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END, l_partkey) AS restaurant_id FROM lineitem")
def q_stamped(spark: Spark, sf: str) -> Frame:
    """Shard rows without their key."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey")).alias("restaurant_id"), "l_partkey")
    return site_rules.stamped(rows, "restaurant_id", F.col("l_partkey")).drop("l_partkey")


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '$' || p_size || ' - $' || p_partkey WHEN 1 THEN '$' || p_partkey WHEN 2 THEN '$7' WHEN 3 THEN 'ask us' ELSE '' END AS price FROM part WHERE p_size <> p_partkey""")
def q_catalogue_prices(spark: Spark, sf: str) -> Frame:
    """Price texts of catalogue objects."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    text = (
        F.when(F.col("p_size") % 5 == 0, F.concat(F.lit('{"low_formatted":"$'), size, F.lit('","high_formatted":"$'), key, F.lit('"}'))).when(F.col("p_size") % 5 == 1, F.concat(F.lit('{"low_formatted":"$'), key, F.lit('"}')))
        .when(F.col("p_size") % 5 == 2, F.lit('{"low_formatted":null,"regular_formatted":" $7 ","formatted":"$8"}')).when(F.col("p_size") % 5 == 3, F.lit(" ask us\xa0"))
    )
    return table(spark, sf, "part").where("p_size <> p_partkey").select("p_partkey", catalogue_price(text).alias("price"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ',' || p_name WHEN p_size % 3 = 1 THEN p_name ELSE '' END AS urls FROM part")
def q_listed_addresses(spark: Spark, sf: str) -> Frame:
    """Stripped, distinct texts of a list, in order."""
    size = F.col("p_size") % 3
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.when(size == 0, F.concat(F.lit('[" '), F.col("p_brand"), F.lit('", "", null, '), quoted(F.col("p_name")), F.lit(","), quoted(F.col("p_brand")), F.lit("]"))).when(size == 1, F.concat(F.lit("["), quoted(F.col("p_name")), F.lit("]"))).otherwise("{")
    return table(spark, sf, "part").select("p_partkey", F.array_join(listed_addresses(text), ",").alias("urls"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' "é" ' || chr(10) || '/' ELSE p_name || ' "q \\x' END AS text FROM part""")
def q_json_unescaped(spark: Spark, sf: str) -> Frame:
    """JSON string contents, also broken ones."""
    good, bad = F.concat("p_name", F.lit(r' \"é\" \n\/')), F.concat("p_name", F.lit(r' \"q \x'))
    return table(spark, sf, "part").select("p_partkey", json_unescaped(F.when(F.col("p_size") % 2 == 0, good).otherwise(bad)).alias("text"))


@query("""WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ')[1:6] AS a, string_split(lower(text), ' ')[4:9] AS b FROM conversations)
SELECT conv_id, turn, CAST(len(list_distinct(list_intersect(a, b))) AS INTEGER) AS shared, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS inside FROM w""")
def q_array_sets(spark: Spark, sf: str) -> Frame:
    """Shared items and subsets of token arrays."""
    w = F.split(F.lower("text"), " ", -1)
    a, b = F.slice(w, 1, 6), F.slice(w, 4, 6)
    return table(spark, sf, "conversations").select("conv_id", "turn", shared_items(a, b).alias("shared"), holds_all(a, b).alias("inside"))


@query("""SELECT c_custkey, regexp_matches(n, '^[A-Za-z0-9_]{3,20}$') AND lower(n) <> 'admin' AS valid FROM
  (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '#', '_') WHEN c_custkey % 3 = 1 THEN c_name WHEN c_custkey % 6 = 2 THEN 'Admin' ELSE 'ab' || c_custkey END AS n FROM customer)""")
def q_usernames(spark: Spark, sf: str) -> Frame:
    """User names and reserved ones."""
    k = F.col("c_custkey")
    n = F.when(k % 3 == 0, F.replace("c_name", F.lit("#"), F.lit("_"))).when(k % 3 == 1, F.col("c_name")).when(k % 6 == 2, "Admin").otherwise(F.concat(F.lit("ab"), k.cast("string")))
    return table(spark, sf, "customer").select("c_custkey", valid_username(n, ("admin",)).alias("valid"))


@query("""SELECT page_id, length(t) < 1500 AND regexp_matches(t, '(?i)internal server error|bad gateway|service unavailable|encountered an internal error') AS failed,
  regexp_matches(u, '(^|[^a-z])(breakfast|lunch|dinner|brunch|sandwiches|salads|soups|wraps|desserts|deserts|burgers|appetizers|starters|sides|beverages|drinks|specials)([^a-z]|$)') AS section FROM
  (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Oops: Bad Gateway' WHEN page_id % 3 = 1 THEN html || 'bad gateway' ELSE html END AS t, CASE WHEN page_id % 2 = 0 THEN '/menu/lunch-' || page_id ELSE '/menu/brunches' END AS u FROM pages)""")
def q_page_kinds(spark: Spark, sf: str) -> Frame:
    """Pages of one section, pages of server errors."""
    i = F.col("page_id")
    t = F.when(i % 3 == 0, "Oops: Bad Gateway").when(i % 3 == 1, F.concat("html", F.lit("bad gateway"))).otherwise(F.col("html"))
    u = F.concat(F.lit("https://dinner.example"), F.when(i % 2 == 0, F.concat(F.lit("/menu/lunch-"), i.cast("string"))).otherwise("/menu/brunches"))
    return table(spark, sf, "pages").select("page_id", server_error_page(t).alias("failed"), single_section_url(u).alias("section"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_size || ' cal' WHEN 1 THEN p_size || ' Cals' END AS label, CASE WHEN p_size % 4 < 3 THEN CAST(p_size % 4 + 1 AS INTEGER) END AS rank,
  CASE WHEN p_size % 4 < 3 THEN repeat('$', p_size % 4 + 1) END AS symbol FROM part""")
def q_labels(spark: Spark, sf: str) -> Frame:
    """calorie labels, price levels."""
    size = F.col("p_size")
    calories = F.when(size % 3 == 0, size.cast("string")).when(size % 3 == 1, F.concat(size.cast("string"), F.lit(" Cals"))).otherwise(" ")
    level = F.when(size % 4 == 0, "PRICE_LEVEL_INEXPENSIVE").when(size % 4 == 1, "PRICE_LEVEL_MODERATE").when(size % 4 == 2, "PRICE_LEVEL_EXPENSIVE").otherwise("PRICE_LEVEL_FREE")
    return table(spark, sf, "part").select("p_partkey", calorie_label(calories).alias("label"), price_level_rank(level).alias("rank"), price_level_symbol(level).alias("symbol"))


@query("""SELECT p_partkey, p_name AS reasoning, CASE WHEN p_size % 2 = 0 THEN p_brand END AS evidence FROM part""")
def q_evidence(spark: Spark, sf: str) -> Frame:
    """F16: reasoning and evidence in one text."""
    got = evidence_split(F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(' | evidence: "'), "p_brand", F.lit('"'))).otherwise(F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", got["reasoning"].alias("reasoning"), got["evidence"].alias("evidence"))


@query("""SELECT event_id, greatest(0.0, least(1.0, CASE WHEN user_id % 4 = 0 THEN 0.0 WHEN user_id % 4 = 1 THEN value / 100 ELSE value - 50 END)) AS confidence, user_id % 3 < 2 AS veganish,
  user_id % 2 = 0 AS soft FROM events""")
def q_confidences(spark: Spark, sf: str) -> Frame:
    """Clamped confidences, soft agreement."""
    u, v = F.col("user_id"), F.col("value")
    text = F.when(u % 4 == 0, "high").when(u % 4 == 1, (v / 100).cast("string")).otherwise((v - 50).cast("string"))
    verdict = F.when(u % 3 == 0, "vegan").when(u % 3 == 1, "vegan_adaptable").otherwise("unclear")
    return table(spark, sf, "events").select("event_id", clamp(text).alias("confidence"), veganish(verdict).alias("veganish"), soft_agreement(F.lit("vegan"), F.when(u % 2 == 0, "likely_vegan").otherwise("not_vegan")).alias("soft"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderkey % 4 <> 0 AND date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') > 550 AS old FROM orders""")
def q_pdf_dates(spark: Spark, sf: str) -> Frame:
    """Days of PDF date texts, and whether they are too old."""
    text = F.when(F.col("o_orderkey") % 4 == 0, "D:2000").otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z")))
    day = pdf_date(text)
    return table(spark, sf, "orders").select("o_orderkey", day.alias("day"), stale(day, F.lit(None).cast("date"), F.lit("2000-01-01").cast("date")).alias("old"))


@query("""SELECT user_id AS place_id, event_type AS dish_key, count(*) AS n FROM events GROUP BY ALL""")
def q_mention_counts(spark: Spark, sf: str) -> Frame:
    """Mentions of dishes by place."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("place_id"), F.array(F.struct(F.col("event_type").alias("dish_key"))).alias("mentions"))
    return mention_counts(rows)


@query("""SELECT user_id AS place_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts DESC, event_id DESC) AS notes, max(ts) AS newest FROM events GROUP BY user_id""")
def q_notes(spark: Spark, sf: str) -> Frame:
    """The notes of each place, newest first."""
    rows = table(spark, sf, "events").select(F.col("user_id").alias("place_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.col("event_type").alias("body"))
    return notes_by_place(rows).select("place_id", F.array_join(F.transform("notes", lambda n: n.id.cast("string")), ",").alias("notes"), "newest")


@query("""SELECT doc_id, CAST(greatest(n_chars % 50, 7) AS INTEGER) AS products, CAST(n_chars % 9 AS INTEGER) AS categories FROM documents""")
def q_structured_counts(spark: Spark, sf: str) -> Frame:
    """The largest counts that a text's marks state."""
    mark = F.concat(F.lit("[structured-menu products="), (F.col("n_chars") % 50).cast("string"), F.lit(" categories="), (F.col("n_chars") % 9).cast("string"), F.lit("]\n[structured-menu products=7]"))
    got = structured_counts(F.concat("text", mark))
    return table(spark, sf, "documents").select("doc_id", got["products"].alias("products"), got["categories"].alias("categories"))


@query("""SELECT s_suppkey, s_nationkey % 3 = 0 AS archived, CASE WHEN s_nationkey % 3 = 0 THEN 'closed' ELSE s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS score FROM supplier""")
def q_updates(spark: Spark, sf: str) -> Frame:
    """Flags by condition, columns by key."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", F.lit(False).alias("archived"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    after = update(rows, F.col("s_nationkey") % 3 == 0, archived=F.lit(True), name=F.lit("closed"))
    delta = rows.where("s_suppkey % 4 = 0").select("s_suppkey", (F.col("score") + 1).alias("score"))
    return update_by(after, delta, "s_suppkey", ("score",)).select("s_suppkey", "archived", "name", "score")


@query("""SELECT event_id AS id, coalesce(CASE WHEN user_id % 2 = 0 THEN event_type END, 'unknown') AS provider, 'spot_check' AS check_type, '' AS rule, 'flagged' AS status, '' AS detail FROM events""")
def q_audit_rows(spark: Spark, sf: str) -> Frame:
    """Audit entries with their defaults."""
    return audit_rows(table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("provider")))


@query("""SELECT doc_id AS dish_id, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE 'old' END AS status FROM documents WHERE doc_id % 2 = 0""")
def q_dismissals(spark: Spark, sf: str) -> Frame:
    """Dismissals of current findings; stale ones are not taken."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("dish_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("fingerprint"))
    old = docs.where("dish_id % 2 = 0").withColumn("status", F.lit("old"))
    new = docs.where("dish_id % 3 = 0").select("dish_id", F.when(F.col("dish_id") % 2 == 0, F.col("fingerprint")).otherwise("stale").alias("fingerprint"), F.lit("new").alias("status"))
    return dismiss(old, new, ["dish_id"], docs).select("dish_id", "status")


@query("""WITH c AS (SELECT l_partkey, max((l_orderkey, l_linenumber)) AS m FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS id FROM part LEFT JOIN c ON p_partkey = l_partkey LEFT JOIN lineitem l ON l.l_partkey = p_partkey AND (l_orderkey, l_linenumber) = m WHERE m IS NULL OR l_linenumber % 2 = 0 GROUP BY p_partkey""")
def q_pending(spark: Spark, sf: str) -> Frame:
    """Dishes without a classification, or whose latest one lacks attributes."""
    dishes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    cls = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("dish_id"), F.struct("l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_linenumber") % 2 == 1, F.col("l_shipdate")).alias("attributes_enriched_at"))
    return pending(dishes, cls)


@query("""SELECT conv_id, turn, array_to_string(list_filter(list_transform(range(1, len(b) + 1), lambda i: CASE WHEN NOT list_contains(a, b[i]) OR (i > 1 AND NOT list_contains(a, b[i - 1])) OR (i < len(b) AND NOT list_contains(a, b[i + 1])) THEN b[i] END), lambda x: x IS NOT NULL), ' ') AS lines
  FROM (SELECT conv_id, turn, string_split(text, ' ')[1:5] AS a, string_split(text, ' ')[1:12] AS b FROM conversations)""")
def q_new_lines(spark: Spark, sf: str) -> Frame:
    """Lines that came in, with their neighbours."""
    w = F.split("text", " ", -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(new_lines(F.slice(w, 1, 5), F.slice(w, 1, 12)), " ").alias("lines"))


@query("""WITH n AS (SELECT p_partkey, lower(p_name) AS a, lower(CASE WHEN p_size % 2 = 0 THEN 'The ' || p_name || ' house' ELSE p_brand || ' widgets' END) AS b FROM part),
w AS (SELECT p_partkey, a, b, unnest(string_split_regex(a, '[^a-z0-9]+')) AS x FROM n)
SELECT p_partkey, bool_or(contains(a, b) OR contains(b, a) OR (length(x) > 3 AND list_contains(string_split_regex(b, '[^a-z0-9]+'), x))) AS same FROM w GROUP BY p_partkey""")
def q_names_overlap(spark: Spark, sf: str) -> Frame:
    """Names that hold each other or share a long word."""
    other = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("The "), "p_name", F.lit(" house"))).otherwise(F.concat("p_brand", F.lit(" widgets")))
    return table(spark, sf, "part").select("p_partkey", names_overlap(F.col("p_name"), other).alias("same"))

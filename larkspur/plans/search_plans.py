"""Search, facets, prices, geography and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.documents import menu_score, menu_signals
from ..functions.search import interleave, parse_query, relevance
from ..functions.text import alcohol_status, audit_calories, audit_price, dish_key, finding_fingerprint, first_price, json_list, lost_decimal, menu_hash, normal_search, preview, price_key, pretty_type, url_host, url_normal
from ..operators.extract import links
from ..operators.ranks import ranked
from ..operators.rollups import findings, first_owner, with_reviews
from ..sources.tables import table
from .registry import query
from .stand_ins import DISHES_SQL, PLACE_SQL, dishes, with_place

Spark, Frame = SparkSession, DataFrame


@query("SELECT p_type AS category, count(*) AS n FROM part WHERE p_retailprice <= 950 AND p_size BETWEEN 5 AND 40 GROUP BY p_type")
def q_facets(spark: Spark, sf: str) -> Frame:
    """Counts by category under some of the filters."""
    return table(spark, sf, "part").where("p_retailprice <= 950 AND p_size BETWEEN 5 AND 40").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS format, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2') GROUP BY p_brand ORDER BY n DESC, format")
def q_formats(spark: Spark, sf: str) -> Frame:
    """Histogram without the fallback values, most first."""
    return table(spark, sf, "part").where("p_brand NOT IN ('Brand#1', 'Brand#2')").groupBy(F.col("p_brand").alias("format")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "format")


@query(f"""WITH {DISHES_SQL} SELECT restaurant_id, l_orderkey, l_linenumber, name FROM dishes
WHERE verdict IN ('vegan', 'likely_vegan', 'vegan_adaptable') AND CASE WHEN category IN ('drink', 'dessert') THEN category ELSE 'food' END = 'food' AND coalesce(serving_role, 'main') <> 'side'
  AND p_retailprice IS NOT NULL AND p_retailprice <= 1000 AND contains(name, 'ring')""")
def q_filter(spark: Spark, sf: str, rows=dishes) -> Frame:
    """The conjunction of search filters."""
    kind = F.when(F.col("category").isin("drink", "dessert"), F.col("category")).otherwise("food")
    role = ~F.col("serving_role").eqNullSafe("side")
    found = rows(spark, sf).where(F.col("verdict").isin("vegan", "likely_vegan", "vegan_adaptable") & (kind == "food") & role & F.col("p_retailprice").isNotNull() & (F.col("p_retailprice") <= 1000) & F.col("name").contains("ring"))
    return found.select("restaurant_id", "l_orderkey", "l_linenumber", "name")


@query("""SELECT p_partkey, p_name FROM part WHERE (contains(p_name, 'rings') OR contains(p_name, 'ring')) AND contains(p_name, 'red') AND p_type IN ('ECONOMY', 'PROMO', 'STANDARD')""")
def q_intent_match(spark: Spark, sf: str) -> Frame:
    """A parsed query against names; flags of the query are predicates."""
    from ..functions.search import matches

    intent = parse_query("Vegan-friendly red rings")
    kind = F.when(F.col("p_type").isin("ECONOMY", "PROMO", "STANDARD"), "vegan").otherwise("not_vegan")
    none = F.lit(None).cast("string")
    ok = matches(intent, normal_search(F.col("p_name")), kind, none, {}, none, F.array().cast("array<string>"))
    return table(spark, sf, "part").where(ok).select("p_partkey", "p_name")


@query("""SELECT p_partkey, CAST(CASE WHEN p_name = 'red widget' THEN 100 WHEN starts_with(p_name, 'red widget') THEN 70 WHEN contains(p_name, 'red widget') THEN 50 ELSE 0 END
  + CASE WHEN contains(p_name, 'red') THEN 12 WHEN contains(lower(p_type), 'red') THEN 9 WHEN contains(lower(p_brand), 'red') THEN 5 ELSE 1 END
  + CASE WHEN contains(p_name, 'widget') THEN 12 WHEN contains(lower(p_type), 'widget') THEN 9 WHEN contains(lower(p_brand), 'widget') THEN 5 ELSE 1 END AS INTEGER) AS score FROM part""")
def q_relevance(spark: Spark, sf: str) -> Frame:
    """points by exact, prefix and contained query, and by term."""
    none = F.lit(None).cast("string")
    score = relevance(parse_query("Red Widget"), normal_search(F.col("p_name")), F.lower("p_type"), F.lower("p_brand"), none, none)
    return table(spark, sf, "part").select("p_partkey", score.cast("int").alias("score"))


_RANKED = """WITH r AS (SELECT p_partkey AS id, p_name AS name, p_size % 5 AS tier, p_size % 2 AS role, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 6 END AS rating, p_retailprice AS price_value,
  CASE WHEN contains(p_name, 'red') THEN 12 ELSE 1 END AS score FROM part)
SELECT id, CAST(row_number() OVER (PARTITION BY price_value > 950 ORDER BY {keys}) AS BIGINT) AS place FROM r"""


def _ranked(spark: Spark, sf: str, keys: list) -> Frame:
    size = F.col("p_size")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (size % 5).alias("tier"), (size % 2).alias("role"), F.when(size % 9 != 0, size % 6).alias("rating"), F.col("p_retailprice").alias("price_value"), F.when(F.col("p_name").contains("red"), 12).otherwise(1).alias("score"))
    return ranked(rows.withColumn("dear", F.col("price_value") > 950), keys, ("dear",), "place").select("id", "place")


@query(_RANKED.format(keys="tier, score DESC, role, rating DESC NULLS LAST, name, id"))
def q_rank_search(spark: Spark, sf: str) -> Frame:
    """Ranking while searching."""
    return _ranked(spark, sf, [F.col("tier"), F.desc("score"), F.col("role"), F.col("rating").desc_nulls_last(), F.col("name"), F.col("id")])


@query(_RANKED.format(keys="role, tier, price_value NULLS LAST, name, id"))
def q_rank_browse(spark: Spark, sf: str) -> Frame:
    """Ranking while browsing, by price."""
    return _ranked(spark, sf, [F.col("role"), F.col("tier"), F.col("price_value").asc_nulls_last(), F.col("name"), F.col("id")])


@query(f"""WITH {DISHES_SQL}, t AS (SELECT *, CASE verdict WHEN 'vegan' THEN 0 WHEN 'likely_vegan' THEN 1 WHEN 'vegan_adaptable' THEN 2 WHEN 'not_vegan' THEN 4 ELSE 3 END AS tier, CASE WHEN serving_role = 'side' THEN 1 ELSE 0 END AS role,
  l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS id FROM dishes)
SELECT id, CAST(tier AS INTEGER) AS tier, CAST(role AS INTEGER) AS role, CAST(row_number() OVER (PARTITION BY restaurant_id, tier, role ORDER BY confidence DESC NULLS LAST, name, id, l_extendedprice, created_at, l_quantity) AS BIGINT) AS occ FROM t
QUALIFY count(*) OVER (PARTITION BY restaurant_id, id) = 1""")
def q_interleave(spark: Spark, sf: str, rows=dishes) -> Frame:
    """The turn of each row among those of its venue, tier and role."""
    found = rows(spark, sf).withColumns({"id": F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber"), "rating": F.lit(None).cast("double")})
    same = F.count("*").over(Window.partitionBy("restaurant_id", "id"))
    return interleave(found.withColumn("same", same)).where("same = 1").select("id", "tier", "role", "occ")


@query("""SELECT p_partkey, CAST(regexp_extract('$' || p_size || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ' / $' || p_partkey, '[0-9]{1,3}(?:\\.[0-9]{1,2})?') AS DOUBLE) AS first_price,
  list_min(list_transform(regexp_extract_all('$' || p_size || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ' / $' || p_partkey, '[0-9]{1,4}(?:\\.[0-9]{1,2})?'), lambda x: CASE WHEN x::DOUBLE > 0 THEN x::DOUBLE END)) AS base_price,
  list_max(list_transform(regexp_extract_all('$' || p_size || '.' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || ' / $' || p_partkey, '[0-9]{1,4}(?:\\.[0-9]{1,2})?'), lambda x: x::DOUBLE)) AS top FROM part""")
def q_price_parse(spark: Spark, sf: str) -> Frame:
    """first, smallest and largest number of a price text."""
    text = F.concat(F.lit("$"), F.col("p_size").cast("string"), F.lit("."), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"), F.lit(" / $"), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", first_price(text).alias("first_price"), audit_price(text).alias("base_price"), audit_calories(text).alias("top"))


@query("""SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'marketprice' ELSE p_size || CASE WHEN p_size % 4 = 0 THEN '' ELSE '.5' END || '/' || p_partkey END AS key FROM part""")
def q_price_key(spark: Spark, sf: str) -> Frame:
    """prices that are written otherwise but equal have one key."""
    s = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 10 == 0, "Market Price").otherwise(F.concat(F.lit("$"), s, F.when(F.col("p_size") % 4 == 0, ".00").otherwise(".50"), F.lit(" / $"), F.col("p_partkey").cast("string"), F.lit(".0")))
    return table(spark, sf, "part").select("p_partkey", price_key(text).alias("key"))


@query("""SELECT p_partkey, CASE WHEN p_size >= 10 AND p_size < 100 THEN '$0.' || lpad(p_size::VARCHAR, 2, '0') END AS suggested FROM part WHERE p_size >= 10""")
def q_lost_decimal(spark: Spark, sf: str) -> Frame:
    """Cents that were read as whole units, with their correction."""
    text = F.concat(F.lit(" +."), F.lpad(F.col("p_size").cast("string"), 2, "0"))
    return table(spark, sf, "part").where("p_size >= 10").select("p_partkey", lost_decimal(text).alias("suggested"))


_A = PLACE_SQL.format(k="s_suppkey")


@query(f"""WITH s AS (SELECT s_suppkey, {_A} FROM supplier), d AS (SELECT *, radians(lat) AS p, radians(lng + 81.25) AS dl, radians(28.75) AS p0 FROM s),
h AS (SELECT *, pow(sin((p - p0) / 2), 2) + cos(p0) * cos(p) * pow(sin(dl / 2), 2) AS a FROM d)
SELECT s_suppkey, round(6371008.8 * 2 * atan2(sqrt(a), sqrt(1 - a)), 3) AS meters, round(3958.8 * 2 * asin(least(1.0, sqrt(a))), 3) AS miles FROM h WHERE 6371008.8 * 2 * atan2(sqrt(a), sqrt(1 - a)) <= 20000""")
def q_haversine(spark: Spark, sf: str) -> Frame:
    """Distances, inside an exact circle."""
    rows = with_place(table(spark, sf, "supplier"), "s_suppkey")
    here = (F.lit(28.75), F.lit(-81.25), F.col("lat"), F.col("lng"))
    return rows.where(geo.meters(*here) <= 20000).select("s_suppkey", F.round(geo.meters(*here), 3).alias("meters"), F.round(geo.miles(*here), 3).alias("miles"))


@query(f"""WITH s AS (SELECT s_suppkey, {_A} FROM supplier)
SELECT CASE WHEN s_suppkey = 7 THEN 'item:7' ELSE CAST(floor(lat / (360 / 1024.0 * 0.28)) AS BIGINT) || ':' || CAST(floor(lng / (360 / 1024.0 * 0.28)) AS BIGINT) END AS cell, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng, min(s_suppkey) AS first_id FROM s GROUP BY 1""")
def q_cluster(spark: Spark, sf: str) -> Frame:
    """Grid clusters, with the chosen item alone."""
    got = geo.grid_clusters(with_place(table(spark, sf, "supplier"), "s_suppkey"), 10, "s_suppkey", priority=7)
    return got.select("cell", "n", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "first_id")


@query(f"""WITH c AS (SELECT c_custkey, {PLACE_SQL.format(k="c_custkey")} FROM customer) SELECT c_custkey FROM c WHERE lat BETWEEN 28.6 - 0.05 AND 28.8 + 0.05 AND lng BETWEEN -81.4 - 0.05 AND -81.2 + 0.05""")
def q_viewport(spark: Spark, sf: str) -> Frame:
    """The padded viewport."""
    rows = with_place(table(spark, sf, "customer"), "c_custkey")
    return rows.where(geo.in_view(F.col("lat"), F.col("lng"), 28.6, -81.4, 28.8, -81.2, 13)).select("c_custkey")


@query("""WITH g AS (SELECT i, j, 28.5 + i * (1000 / 111320.0) AS lat, -81.4 + j * (1000 / (111320.0 * cos(radians(28.5)))) AS lng FROM range(-5, 6) a(i), range(-5, 6) b(j)),
h AS (SELECT *, pow(sin(radians(lat - 28.5) / 2), 2) + cos(radians(28.5)) * cos(radians(lat)) * pow(sin(radians(lng + 81.4) / 2), 2) AS a FROM g)
SELECT round(lat, 6) AS lat, round(lng, 6) AS lng FROM h WHERE 6371008.8 * 2 * atan2(sqrt(a), sqrt(1 - a)) <= 5800""")
def q_grid_cells(spark: Spark, sf: str) -> Frame:
    """The cells that cover a circle."""
    cells = geo.tile_centres(spark, 28.5, -81.4, 4800.0)
    return cells.select(F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_FOOD, _SECTIONS = ("the", "and", "ing"), ("tion", "les ", "der ", "que")


@query("""WITH t AS (SELECT doc_id, lower(text) AS low, text FROM documents),
s AS (SELECT doc_id, len(regexp_extract_all(text, '(?:\\$\\s?[0-9]{1,3}(?:\\.[0-9]{2})?)|(?:\\b[0-9]{1,3}\\.[0-9]{2}\\b)')) AS prices,
  (length(low) - length(replace(low, 'the', ''))) // 3 + (length(low) - length(replace(low, 'and', ''))) // 3 + (length(low) - length(replace(low, 'ing', ''))) // 3 AS food,
  contains(low, 'tion')::INT + contains(low, 'les ')::INT + contains(low, 'der ')::INT + contains(low, 'que')::INT AS sections,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
c AS (SELECT doc_id, prices, food, sections, len(lines) AS n, len(list_filter(lines, lambda x: length(x) BETWEEN 3 AND 80)) AS short FROM s),
f AS (SELECT doc_id, least(prices / 8.0::DOUBLE, 1.0) AS p, least(food / 25.0::DOUBLE, 1.0) AS f, least(sections / 3.0::DOUBLE, 1.0) AS s, CASE WHEN n > 0 THEN short::DOUBLE / n ELSE 0.0 END AS t, prices FROM c)
SELECT doc_id, CAST(round(least(CASE WHEN prices = 0 THEN greatest(p * 0.4 + f * 0.25 + s * 0.2 + t * 0.15, f * 0.4 + s * 0.3 + t * 0.3) ELSE p * 0.4 + f * 0.25 + s * 0.2 + t * 0.15 END, 1.0), 6) AS DOUBLE) AS score FROM f""")
def q_menu_score(spark: Spark, sf: str) -> Frame:
    """How menu-like a text is, here with other words and six digits."""
    x = menu_signals(F.col("text"), _FOOD, _SECTIONS, low=F.col("low"))
    docs = table(spark, sf, "documents").withColumn("low", F.lower("text")).select("doc_id", F.regexp_count("text", F.lit(r"(?:\$\s?\d{1,3}(?:\.\d{2})?)|(?:\b\d{1,3}\.\d{2}\b)")).cast("int").alias("prices"), *[x[k].alias(k) for k in ("food", "sections", "lines", "short_lines")])
    return docs.select("doc_id", menu_score(F.col("prices"), F.col("food"), F.col("sections"), F.lit(0), F.col("lines"), F.col("short_lines"), digits=6).alias("score"))


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS digest FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY digest ORDER BY doc_id) AS owner FROM d QUALIFY first_value(doc_id) OVER (PARTITION BY digest ORDER BY doc_id) <> doc_id""")
def q_dup_content(spark: Spark, sf: str) -> Frame:
    """Rows with the content of an earlier one."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return first_owner(docs, "digest", ["doc_id"]).where("owner.doc_id <> doc_id").select("doc_id", F.col("owner.doc_id").alias("owner"))


@query("""SELECT doc_id, 'small' AS code, 'high' AS severity FROM documents WHERE n_chars < 1200 UNION ALL SELECT doc_id, 'huge', 'low' FROM documents WHERE n_chars > 10000
UNION ALL SELECT doc_id, 'marks', 'medium' FROM documents WHERE contains(text, '%%%') OR contains(text, '###')""")
def q_findings(spark: Spark, sf: str) -> Frame:
    """A row per broken rule, from one pass."""
    t = F.col("text")
    rules = [("small", "high", F.col("n_chars") < 1200), ("huge", "low", F.col("n_chars") > 10000), ("marks", "medium", t.contains("%%%") | t.contains("###"))]
    return findings(table(spark, sf, "documents"), rules, ["doc_id"])


@query("""WITH f AS (SELECT doc_id, left(sha256('small|n_chars|' || n_chars), 16) AS fingerprint FROM documents WHERE n_chars < 1200),
r AS (SELECT doc_id, left(sha256('small|n_chars|' || CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars + 1 END), 16) AS fp, CASE WHEN doc_id % 3 = 0 THEN 'verified' ELSE 'known_issue' END AS status FROM documents WHERE doc_id % 5 <> 0)
SELECT f.doc_id, f.fingerprint, r.status AS review_status FROM f LEFT JOIN r ON f.doc_id = r.doc_id AND f.fingerprint = r.fp""")
def q_review_validity(spark: Spark, sf: str) -> Frame:
    """A review holds while the fingerprint does."""
    docs = table(spark, sf, "documents")
    mark = lambda c: finding_fingerprint(F.lit("small"), F.lit("n_chars"), c)
    found = docs.where("n_chars < 1200").select("doc_id", mark(F.col("n_chars")).alias("fingerprint"))
    even = F.col("doc_id") % 2 == 0
    reviews = docs.where("doc_id % 5 <> 0").select("doc_id", mark(F.when(even, F.col("n_chars")).otherwise(F.col("n_chars") + 1)).alias("fingerprint"), F.when(F.col("doc_id") % 3 == 0, "verified").otherwise("known_issue").alias("status"))
    return with_reviews(found, reviews, ["doc_id"]).select("doc_id", "fingerprint", "review_status")


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS digest FROM documents")
def q_hash_pages(spark: Spark, sf: str) -> Frame:
    """digests that white space does not change."""
    return table(spark, sf, "documents").select("doc_id", menu_hash(F.col("text")).alias("digest"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 0 AS items FROM events")
def q_json_decode(spark: Spark, sf: str) -> Frame:
    """Fields of JSON text; the list decoder is total."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(json_list(F.col("props"))).alias("items"))


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', ''), '^https?://', ''), '^www\\.', '') AS normal FROM pages""")
def q_url_parts(spark: Spark, sf: str) -> Frame:
    """F34, F35, F36."""
    return table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"), url_normal(F.col("url")).alias("normal"))


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*?href=["'']([^"'']*)["'']', 1) AS h FROM pages)
SELECT page_id, CAST(unnest(range(0, len(h))) AS INTEGER) AS place, unnest(h) AS href FROM l""")
def q_links(spark: Spark, sf: str) -> Frame:
    """The raw links of each page, in order; see operators.extract.internal_links for L03."""
    return links(table(spark, sf, "pages"), keep=("page_id",))


@query("""SELECT doc_id, left(regexp_replace(regexp_replace(lower(left(text, 60)), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 200) AS key,
  CASE WHEN length(trim(regexp_replace(left(text, 300), '[ \\t\\n\\r\\f]+', ' ', 'g'))) > 96 THEN rtrim(left(trim(regexp_replace(left(text, 300), '[ \\t\\n\\r\\f]+', ' ', 'g')), 95)) || '…' ELSE trim(regexp_replace(left(text, 300), '[ \\t\\n\\r\\f]+', ' ', 'g')) END AS preview FROM documents""")
def q_keys_and_previews(spark: Spark, sf: str) -> Frame:
    """slugs and short forms of texts."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", dish_key(F.substring(t, 1, 60)).alias("key"), preview(F.substring(t, 1, 300)).alias("preview"))


@query("""WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS short FROM documents)
SELECT doc_id, left(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 200) AS key, CASE WHEN length(short) > 96 THEN rtrim(left(short, 95)) || '…' ELSE short END AS preview FROM d""")
def q_keys_and_previews_whole(spark: Spark, sf: str) -> Frame:
    """slugs and short forms of whole texts; the operators' own limits are the only ones."""
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", dish_key(t).alias("key"), preview(t).alias("preview"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'non_alcoholic' WHEN p_size % 4 = 1 THEN 'alcoholic' WHEN p_size % 4 = 2 THEN 'non_alcoholic' ELSE 'unclear' END AS status, array_to_string(list_transform(string_split(lower(p_type), '_'), lambda x: upper(x[1]) || x[2:]), ' ') AS label FROM part""")
def q_drink_labels(spark: Spark, sf: str) -> Frame:
    """zero-proof before alcohol before soft drinks."""
    s = F.col("p_size") % 4
    text = F.when(s == 0, "Virgin Margarita").when(s == 1, "House ROSÉ").when(s == 2, "Cold brew").otherwise("Alert ginger crumble")
    return table(spark, sf, "part").select("p_partkey", alcohol_status(text).alias("status"), pretty_type(F.lower("p_type")).alias("label"))

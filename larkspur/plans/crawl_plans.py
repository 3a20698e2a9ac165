"""Queries over what crawls and providers leave behind: states, merged dishes, fingerprints, script calls, ordering sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import menu_fingerprint
from ..operators.extract import best_sites
from ..operators.locate import sibling_drops
from ..operators.merging import merged_dishes
from ..operators.script_calls import script_call_items
from ..sources.tables import table
from ..streaming.providers import cooldowns, known_answers
from ..streaming.urls import filtered_batches
from . import stepwise_sql
from .registry import query

Spark, Frame = SparkSession, DataFrame


@query("""
WITH e AS (SELECT user_id % 30 AS provider, ts FROM events WHERE event_type IN ('error', 'view')),
g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 20 MINUTE THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY provider ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY provider ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT provider, min(ts) AS limited_at, max(ts) + INTERVAL 20 MINUTE AS ready_at FROM s GROUP BY provider, n""")
def q_cooldowns(spark: Spark, sf: str) -> Frame:
    """When each provider rests after limit errors."""
    said = F.when(F.col("event_type") == "error", "HTTP 429 Too Many Requests").when(F.col("event_type") == "view", "Quota exceeded").when(F.col("event_type") == "click", "error 4290")
    return cooldowns(table(spark, sf, "events").select((F.col("user_id") % 30).alias("provider"), "ts", said.alias("error")))


@query("""
WITH RECURSIVE e AS (SELECT user_id AS provider, ts, value > 100 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, value > 100) AS r FROM events),
k AS (SELECT provider, ts, r, ts AS since, v AS available, true AS asked FROM e WHERE r = 1
  UNION ALL SELECT e.provider, e.ts, e.r, CASE WHEN e.ts >= k.since + INTERVAL 300 SECOND THEN e.ts ELSE k.since END, CASE WHEN e.ts >= k.since + INTERVAL 300 SECOND THEN e.v ELSE k.available END, e.ts >= k.since + INTERVAL 300 SECOND
    FROM k JOIN e ON e.provider = k.provider AND e.r = k.r + 1)
SELECT provider, ts, asked, available FROM k""")
def q_known_answers(spark: Spark, sf: str) -> Frame:
    """Which requests for a provider's state are asked anew, and the answer in use."""
    return known_answers(table(spark, sf, "events").select(F.col("user_id").alias("provider"), "ts", (F.col("value") > 100).alias("available")))


def crawl_rows(spark: Spark, sf: str) -> Frame:
    """An address found for each order: (record, batch, place, url, address), by customer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = (c % 900 + 100).cast("string")
    streets, cities = F.array(F.lit("E Horatio Ave"), F.lit("Corrine Dr")), F.array(F.lit("Winter Park"), F.lit("Maitland"), F.lit("Orlando"))
    address = F.when(c % 7 != 0, F.concat(n, F.lit(" "), F.get(streets, (c % 2).cast("int")), F.lit(" #3, "), F.get(cities, (c % 3).cast("int")), F.lit(", FL 32751, USA")))
    words = F.array(*[F.lit(w) for w in ("winter-park", "maitland", "orlando", "winter-garden", "horatio", "corrine", "dinner", "locations/tampa", "locations/maitland", "77-oak-street", "park")], F.concat(n, F.lit("-horatio-ave")))
    shapes = F.array(*[F.lit(s) for s in ("https://a.example/{}", "https://a.example/{}/menu", "https://b.example/Menus-{}.pdf")])
    url = F.replace(F.get(shapes, (k % 3).cast("int")), F.lit("{}"), F.get(words, ((k * 7919 + c * 31) % 12).cast("int")))
    return table(spark, sf, "orders").select(c.alias("record"), (k % 3).cast("int").alias("batch"), k.alias("place"), url.alias("url"), address.alias("address"))


@query(stepwise_sql.LOCATION_BATCHES)
def q_location_batches(spark: Spark, sf: str) -> Frame:
    """The addresses that stay of each record's three batches."""
    return filtered_batches(crawl_rows(spark, sf))


@query(stepwise_sql.SIBLING_DROPS)
def q_sibling_drops(spark: Spark, sf: str) -> Frame:
    """Pages that differ from a record's own page in another place."""
    return sibling_drops(crawl_rows(spark, sf), "record")


@query("""
WITH d AS (SELECT p_partkey % 200 AS restaurant_id, p_partkey AS place, CASE WHEN p_size % 3 = 0 THEN upper(p_type) WHEN p_size % 3 = 1 THEN p_type || '!' ELSE lower(p_type) END AS name, '$' || (p_size % 2) || '.50' AS price,
    CASE WHEN p_size % 4 = 0 THEN 'So Good' WHEN p_size % 4 = 1 THEN 'so  good.' END AS raw_description, CASE WHEN p_size % 5 = 0 THEN '450 cal' END AS calories, (p_size % 10) / 10.0 AS confidence,
    [CASE p_size % 3 WHEN 0 THEN 'lunch' WHEN 1 THEN 'dinner' ELSE 'brunch' END, 'lunch'] AS meals, list_transform(range(p_size % 6), lambda i: 'i' || ((p_partkey + i) % 15)) AS parts FROM part),
k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS kn, coalesce(regexp_replace(lower(raw_description), '[^a-z0-9]', '', 'g'), '') AS kd, coalesce(calories, '') AS kc,
  CASE WHEN name = upper(name) THEN 0 ELSE 1 END AS q1, -length(name) AS q2 FROM d),
g AS (SELECT restaurant_id, kn, price, kd, kc, count(*) AS n, min(place) AS first, arg_max(place, {'s': length(coalesce(raw_description, '')), 'c': confidence, 'p': -place}) AS chosen, arg_max(name, {'a': q1, 'b': q2, 'p': -place}) AS spelling FROM k GROUP BY ALL),
m AS (SELECT restaurant_id, kn, price, kd, kc, tag, min({'p': place, 'i': i}) AS pos FROM (SELECT *, unnest(meals) AS tag, unnest(range(len(meals))) AS i FROM k) GROUP BY ALL),
mm AS (SELECT restaurant_id, kn, price, kd, kc, string_agg(tag, ',' ORDER BY pos) AS tags FROM m GROUP BY ALL),
x AS (SELECT restaurant_id, kn, price, kd, kc, tag, min({'p': place, 'i': i}) AS pos FROM (SELECT *, unnest(parts) AS tag, unnest(range(len(parts))) AS i FROM k) GROUP BY ALL),
xx AS (SELECT restaurant_id, kn, price, kd, kc, string_agg(tag, ',' ORDER BY pos) AS tags FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY restaurant_id, kn, price, kd, kc ORDER BY pos) <= 8) GROUP BY ALL)
SELECT restaurant_id, first AS place, CASE WHEN n > 1 THEN spelling ELSE cn END AS name, price, cd AS raw_description, CAST(cc AS DOUBLE) AS confidence, cp AS id, CASE WHEN n > 1 THEN mm.tags ELSE array_to_string(meals, ',') END AS meal_types,
  CASE WHEN n > 1 THEN coalesce(xx.tags, '') ELSE array_to_string(parts, ',') END AS key_ingredients
FROM g LEFT JOIN mm USING (restaurant_id, kn, price, kd, kc) LEFT JOIN xx USING (restaurant_id, kn, price, kd, kc) JOIN (SELECT place AS cp, name AS cn, raw_description AS cd, confidence AS cc, meals, parts FROM k) c ON cp = chosen""")
def q_merged_dishes(spark: Spark, sf: str) -> Frame:
    """Dishes of each owner without copies, with the best spelling and all tags."""
    size, k = F.col("p_size"), F.col("p_partkey")
    rows = table(spark, sf, "part").select(
        (k % 200).alias("restaurant_id"), k.alias("place"), k.alias("id"), F.when(size % 3 == 0, F.upper("p_type")).when(size % 3 == 1, F.concat("p_type", F.lit("!"))).otherwise(F.lower("p_type")).alias("name"),
        F.concat(F.lit("$"), (size % 2).cast("string"), F.lit(".50")).alias("price"), F.when(size % 4 == 0, "So Good").when(size % 4 == 1, "so  good.").alias("raw_description"), F.when(size % 5 == 0, "450 cal").alias("calories"), ((size % 10) / 10.0).alias("confidence"),
        F.array(F.when(size % 3 == 0, "lunch").when(size % 3 == 1, "dinner").otherwise("brunch"), F.lit("lunch")).alias("meal_types"),
        F.when(size % 6 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(size % 6 - 1, F.lit(0))), lambda i: F.concat(F.lit("i"), ((k + i) % 15).cast("string")))).alias("key_ingredients"),
    )
    out = merged_dishes(rows)
    return out.select("restaurant_id", "place", "id", "name", "price", "raw_description", "confidence", F.array_join("meal_types", ",").alias("meal_types"), F.array_join("key_ingredients", ",").alias("key_ingredients"))


_JSON = r"""'"' || list_aggregate(list_transform(string_split({0}, ''), lambda c: CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN unicode(c) = 10 THEN '\n' WHEN unicode(c) = 13 THEN '\r' WHEN unicode(c) = 9 THEN '\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c
  WHEN unicode(c) < 65536 THEN '\u' || printf('%04x', unicode(c)) ELSE '\u' || printf('%04x', 55296 + (unicode(c) - 65536) // 1024) || '\u' || printf('%04x', 56320 + (unicode(c) - 65536) % 1024) END), 'string_agg', '') || '"'"""


@query(f"""
WITH p AS (SELECT page_id, url, html, CASE WHEN page_id % 4 = 0 THEN NULL ELSE html || chr(9) || '😀 "q" \\' || chr(127) END AS content FROM pages)
SELECT page_id, sha256('{{"flags":["identical menu text as “' || page_id || '”","stale"],"sources":[[' || {_JSON.format("url")} || ',' || coalesce({_JSON.format("content")}, 'null') || '],[null,"é"]],"website_url":' ||
  CASE WHEN page_id % 3 = 0 THEN 'null' ELSE {_JSON.format("url")} END || '}}') AS fingerprint FROM p""".replace("“", "\\u201c").replace("”", "\\u201d").replace('"é"', '"\\u00e9"'))
def q_menu_fingerprints(spark: Spark, sf: str) -> Frame:
    """the fingerprint of a finding on each page's whole text, with quotes, control characters and characters of all planes."""
    i = F.col("page_id")
    content = F.when(i % 4 != 0, F.concat("html", F.lit('\t😀 "q" \\\x7f')))
    sources = F.array(F.array("url", content), F.array(F.lit(None).cast("string"), F.lit("é")))
    flags = F.array(F.lit("stale"), F.concat(F.lit("identical menu text as “"), i.cast("string"), F.lit("”")))
    return table(spark, sf, "pages").select("page_id", menu_fingerprint(F.when(i % 3 != 0, F.col("url")), sources, flags).alias("fingerprint"))


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[A-Za-z]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM w),
x AS (SELECT doc_id, k, CASE k % 3 WHEN 0 THEN word || ', "hot" (1)' WHEN 1 THEN word ELSE word || ' & co' END AS name, CASE WHEN k % 2 = 0 THEN 'n' || chr(241) || 'o; ' || word ELSE '' END AS description, printf('$%.2f', (k % 7) + 0.5) AS price FROM i WHERE k % 5 < 3),
f AS (SELECT doc_id, arg_min(name, k) AS name, arg_min(description, k) AS description, price, min(k) AS k FROM x GROUP BY doc_id, lower(name), lower(description), price)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS place, name, description, price FROM f""")
def q_script_calls(spark: Spark, sf: str) -> Frame:
    """Each document's words as calls of a script function, with quotes, brackets, escapes, nested and broken calls."""
    def call(word, k):
        name = F.when(k % 3 == 0, F.concat(F.lit('"'), word, F.lit(', \\"hot\\" (1)"'))).when(k % 3 == 1, F.concat(F.lit("'"), word, F.lit("'"))).otherwise(F.concat(F.lit('"'), word, F.lit(' &amp; co"')))
        text = F.when(k % 2 == 0, F.concat(F.lit('"n\\u00f1o; '), word, F.lit('"'))).otherwise('""')
        good = F.concat(F.lit("renderMerchandise("), k.cast("string"), F.lit(', [1, "a)"], '), name, F.lit(", "), ((k % 7) + 0.5).cast("string"), F.lit(", "), text, F.lit(", f(2, {a: 1})) ;\n"))
        broken = F.when(k % 5 == 3, F.lit('renderMerchandise(1, 2, "few", 3);')).otherwise('renderMerchandise(1, 2, "free", 0, "x"); myrenderMerchandise(1, 2, "own", 3, "x");')
        return F.when(k % 5 < 3, good).otherwise(broken)

    words = F.filter(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), lambda x: x != "")
    html = F.concat(F.lit("<script>"), F.array_join(F.transform(words, call), ""), F.lit("renderMerchandise('</script>"))
    return script_call_items(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", html.alias("html")), keep=("doc_id",))


_HOMES = ("https://www.claseazul-cape-coral.example/home", "http://thother.example/winter/park", "https://toast.example")
_SITES = ("claseazulcape", "Claseazulfortmyers", "other%20winterpark", "zzz", "")


@query(f"""
WITH r AS (SELECT c_custkey, c_custkey // 4 AS k, 'https://oo.viguest.com/?a=1&siteName=' || list_extract({list(_SITES)!r}, 1 + CAST(c_custkey * 7 % 5 AS INTEGER)) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '&x=' || c_custkey END AS candidate,
    list_extract({list(_HOMES)!r}, 1 + CAST(c_custkey // 4 % 3 AS INTEGER)) AS home FROM customer),
n AS (SELECT *, regexp_replace(replace(lower(regexp_extract(candidate, 'siteName=([^&]*)', 1)), '%20', ' '), '[^a-z0-9]', '', 'g') AS site, regexp_replace(regexp_replace(lower(home), '^https?://', ''), '[^a-z0-9]', '', 'g') AS own FROM r),
s AS (SELECT c_custkey, k, candidate, CASE WHEN site = '' THEN 0 ELSE 10 * (SELECT count(*) FROM (SELECT unnest(['cape', 'coral', 'fort', 'myers', 'orlando', 'winter', 'park', 'maitland', 'colonial', 'mills', 'downtown']) AS t) WHERE contains(own, t) AND contains(site, t))
  + coalesce((SELECT max(len) FROM (SELECT unnest(range(4, length(site) + 1)) AS len) WHERE len(list_filter(range(1, length(site) - len + 2), lambda i: contains(own, substr(site, i, len)))) > 0), 0) END AS score FROM n)
SELECT c_custkey, candidate, CAST(score AS INTEGER) AS site_score FROM s JOIN (SELECT k, max(score) AS top FROM s GROUP BY k) t ON t.k = s.k WHERE top = 0 OR score = top""")
def q_best_sites(spark: Spark, sf: str) -> Frame:
    """Of each home's ordering addresses those that match it best."""
    c = F.col("c_custkey")
    pick = lambda words, n: F.get(F.array(*[F.lit(w) for w in words]), n.cast("int"))
    candidate = F.concat(F.lit("https://oo.viguest.com/?a=1&siteName="), pick(_SITES, c * 7 % 5), F.when(c % 2 == 0, "").otherwise(F.concat(F.lit("&x="), c.cast("string"))))
    home = F.floor(c / 4).cast("long")
    rows = table(spark, sf, "customer").select("c_custkey", home.alias("k"), candidate.alias("candidate"), pick(_HOMES, home % 3).alias("home"))
    return best_sites(rows, "k", "candidate", "home").select("c_custkey", "candidate", "site_score")

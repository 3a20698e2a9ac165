"""Queries over pages and documents: menus as data, links, images, the pages that are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from ..operators.finish import finished
from ..operators.structured import state_text, structured_text
from ..operators.weblinks import EXTERNAL_LABEL_HINTS, EXTERNAL_URL_HINTS, MENU_HINTS, ORDERING_HOSTS, SKIP_HINTS, frontier, menu_images, menu_links, pdf_files, serialized_links, visit_key
from ..sources.tables import computed, table
from .registry import query

Spark, Frame = SparkSession, DataFrame

_WORDY = "regexp_replace(l, '[^A-Za-z0-9]+', ' ', 'g')"
_TIDY = "trim(regexp_replace({0}, '[^A-Za-z0-9]+', ' ', 'g'))"
#: The lines of a document that hold a letter or digit, with nothing else but single spaces.
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda l: trim({_WORDY})), lambda l: l <> '')"


def _lines(text="text"):
    tidy = F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")))
    return F.filter(tidy, lambda x: x != "")


@query(f"""
WITH d AS (SELECT doc_id, source, {_LINES} AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, source, unnest(l) AS name, unnest(range(len(l))) AS k FROM d),
x AS (SELECT doc_id, source, k, name || CASE WHEN k % 3 = 0 THEN ' — of ' || source ELSE '' END || CASE k % 4 WHEN 0 THEN ' ($' || (k % 7) || ')' WHEN 1 THEN ' (from $' || (k % 5) || ')' ELSE '' END AS line FROM i),
f AS (SELECT doc_id, any_value(source) AS source, line, min(k) AS k FROM x GROUP BY doc_id, line)
SELECT doc_id, 'json_ld' AS origin, CAST(count(*) AS INTEGER) AS items, sha256('== ' || any_value(source) || ' ==' || chr(10) || 'All:' || chr(10) || string_agg(line, chr(10) ORDER BY k)) AS text
FROM f GROUP BY doc_id HAVING count(*) >= 8""")
def q_ld_menus(spark: Spark, sf: str) -> Frame:
    """Each document's lines as the items of a JSON-LD menu, read back from the page as menu text."""
    item = lambda name, k: F.struct(
        F.lit("MenuItem").alias("@type"), name.alias("name"), F.when(k % 3 == 0, F.concat(F.lit("of "), "source")).when(k % 3 == 1, " , ").alias("description"),
        F.when(k % 4 == 0, F.struct((k % 7).cast("string").alias("price"))).when(k % 4 == 1, F.struct(F.concat(F.lit(" from $"), (k % 5).cast("string")).alias("price"))).alias("offers"),
    )
    menu = F.struct(F.lit("Menu").alias("@type"), F.col("source").alias("name"), F.struct(F.lit("MenuSection").alias("@type"), F.lit("All").alias("name"), F.transform(_lines(), item).alias("hasMenuItem")).alias("hasMenuSection"))
    page = F.concat(F.lit('<html><script type="application/ld+json">{"@graph": ['), F.to_json(menu), F.lit("]}</script><p>Menu</p></html>"))
    docs = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", page.alias("html"))
    return structured_text(docs, keep=("doc_id",)).select("doc_id", "origin", "items", F.sha2("text", 256).alias("text"))


@query(f"""
WITH d AS (SELECT doc_id, {_LINES} AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, unnest(l) AS name, unnest(range(len(l))) AS k FROM d),
s AS (SELECT doc_id, sum(length(name) + CASE WHEN k % 2 = 0 THEN 55 ELSE 27 END + length(CAST(k % 9 AS VARCHAR))) AS size FROM i GROUP BY doc_id),
x AS (SELECT doc_id, k, name || CASE WHEN k % 2 = 0 THEN ' — quite hot' ELSE '' END || ' ($' || (k % 9) || '.5)' AS line FROM i WHERE length(name) <= 120),
f AS (SELECT doc_id, line, min(k) AS k FROM x GROUP BY doc_id, line)
SELECT f.doc_id, CAST(count(*) AS INTEGER) AS items, sha256(string_agg(line, chr(10) ORDER BY k)) AS text FROM f JOIN s ON s.doc_id = f.doc_id AND s.size + 2 >= 2000
GROUP BY f.doc_id HAVING count(*) >= 8""")
def q_script_menus(spark: Spark, sf: str) -> Frame:
    """Each document's lines as name and price keys in a script, plain or escaped, read back as menu text."""
    one = lambda name, k: F.concat(F.lit('"itemName":"'), name, F.when(k % 2 == 0, '","description":"quite   hot').otherwise(""), F.lit('","price":"'), (k % 9).cast("string"), F.lit('.5",'))
    docs = computed(table(spark, sf, "documents").where("text IS NOT NULL"), body=F.array_join(F.transform(_lines(), one), ""))
    body = F.col("body")
    script = F.concat(F.lit("{"), F.when(F.col("doc_id") % 2 == 0, body).otherwise(F.replace(body, F.lit('"'), F.lit('\\"'))), F.lit("}"))
    # whether a script is long enough is asked of its plain form, so that both forms have one SQL
    sized = F.when(F.length(body) + 2 >= 2000, F.concat(F.lit("<script>"), script, F.lit("</script>")))
    docs = docs.select("doc_id", sized.alias("html"))
    return structured_text(docs, keep=("doc_id",)).where("origin = 'embedded'").select("doc_id", "items", F.sha2("text", 256).alias("text"))


@query(f"""
WITH d AS (SELECT doc_id, lang, {_LINES} AS l FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, lang, unnest(l) AS name, unnest(range(len(l))) AS k FROM d),
x AS (SELECT doc_id, k, lang || CASE WHEN k // 5 % 2 = 1 THEN ' > part ' || (k // 5) ELSE '' END AS category,
  name || CASE k % 4 WHEN 0 THEN ' — nice & hot' ELSE '' END || CASE k % 4 WHEN 1 THEN ' ($' || (k % 6) || '.25)' WHEN 2 THEN ' ($' || k || ')' ELSE '' END || CASE k % 4 WHEN 3 THEN ' [' || k || ' cal]' ELSE '' END AS line
  FROM i WHERE length(name) <= 160 AND lang IS NOT NULL),
c AS (SELECT *, lag(category) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM x)
SELECT doc_id, CAST(count(*) AS INTEGER) AS products, CAST(count(DISTINCT category) AS INTEGER) AS categories,
  sha256('[structured-menu products=' || count(*) || ' categories=' || count(DISTINCT category) || ']' || chr(10) ||
    string_agg(CASE WHEN category IS DISTINCT FROM before THEN '== ' || category || ' ==' || chr(10) ELSE '' END || line, chr(10) ORDER BY k)) AS text
FROM c GROUP BY doc_id HAVING count(*) >= 8""")
def q_state_menus(spark: Spark, sf: str) -> Frame:
    """Each document's lines as products of a client state with dayparts, branches and all ways to give a
    price, read back as menu text."""
    c = lambda x: x.cast("string")
    item = lambda name, k: F.struct(
        F.concat(F.lit("prod-"), c(k)).alias("id"), name.alias("displayName"), F.when(k % 4 == 0, "<b>nice</b> &amp; hot").alias("description"),
        F.when(k % 4 == 1, F.struct(F.concat(F.lit("$"), c(k % 6), F.lit(".25")).alias("formattedPrice"))).alias("price"), F.when(k % 4 == 2, F.struct(k.alias("price"))).alias("cost"),
        F.when(k % 4 == 3, F.struct(F.concat(c(k), F.lit(" cal")).alias("cal"))).alias("nutrition"),
    )
    items = F.transform(_lines(), item)
    steps = F.sequence(F.lit(0), F.greatest((F.size("items") - 1).cast("int") / 5, F.lit(0)).cast("int"))
    # groups of five, every other one in a branch of its own: {"en": [{"items": [...]}, {"x": {...}}, {"name": "part 1", "items": [...]}]}
    group = lambda g: F.struct(F.when(g % 2 == 1, F.concat(F.lit("part "), c(g))).alias("name"), F.slice("items", g * 5 + 1, F.lit(5)).alias("items"))
    state = F.to_json(F.struct(F.struct(F.create_map("lang", F.transform(steps, group)).alias("menus")).alias("data"), F.lit("x" * 100).alias("pad")))
    docs = table(spark, sf, "documents").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", items.alias("items"))
    docs = computed(docs, items=F.col("items")).select("doc_id", F.array(F.lit("junk"), state).alias("values"))
    out = state_text(docs, "values", ("doc_id",))
    return out.select("doc_id", "products", "categories", F.sha2("text", 256).alias("text"))


# -- links: every page's own links, each in one of several dresses -----------------------------------------------------

_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
_HREFS = """SELECT page_id, url, unnest(h) AS href, unnest(range(len(h))) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)"""
_N = "CAST(page_id * 10 + i AS VARCHAR)"


def _dressed(forms: dict[int, str], count: int):
    """The page's links as markup: link i of page p has form (p + i) % count, a template over {href} and {n}."""
    def one(href, i):
        n, out = (F.col("page_id") * 10 + i).cast("string"), F.lit("")
        for k, template in forms.items():
            text = F.replace(F.replace(F.lit(template), F.lit("{href}"), href), F.lit("{n}"), n)
            out = F.when((F.col("page_id") + i) % count == k, text).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), one), "\n")


_LINK_FORMS = {
    0: '<a href="/menu/{n}">No {n}</a>', 1: '<a class="x" href="https://www.toasttab.com/s{n}?x=1#/main">PICK  <b>UP</b></a>', 2: '<a href="https://press.example/opens-for-takeout-and-delivery-{n}">Story</a>', 3: '<a href="/gift-menu">Menu</a>',
    4: '<a href="{href}"><b>See our</b> food</a>', 5: '<a href="https://menus.example/carte{n}.PDF?a=1">Menu</a>', 6: '<a href="https://other.example/order/{n}/">go</a><a href="#x">menu</a><a>menu</a>', 7: '<a href="{href}">About creation</a>',
    8: '<a href="/Dinner#{n}">x</a>', 9: '<a href="https://toasttab.com.evil.example/{n}">x</a>', 10: '<a href="http://[">menu</a>',
}
_LINK_CASES = f"""CASE (page_id + i) % 11 WHEN 0 THEN {_ORIGIN} || '/menu/' || {_N} WHEN 1 THEN 'https://www.toasttab.com/s' || {_N} || '?x=1#/main' WHEN 2 THEN 'https://press.example/opens-for-takeout-and-delivery-' || {_N}
  WHEN 3 THEN {_ORIGIN} || '/gift-menu' WHEN 4 THEN {_ORIGIN} || href WHEN 5 THEN 'https://menus.example/carte' || {_N} || '.PDF?a=1' WHEN 6 THEN 'https://other.example/order/' || {_N} || '/' WHEN 7 THEN {_ORIGIN} || href
  WHEN 8 THEN {_ORIGIN} || '/Dinner#' || {_N} WHEN 9 THEN 'https://toasttab.com.evil.example/' || {_N} END"""


def _hint(words) -> str:
    return "(^|[^a-z])(" + "|".join(w.replace(".", "\\.") for w in words) + ")([^a-z]|$)"


@query(f"""
WITH l AS (SELECT page_id, url, i, {_LINK_CASES} AS address, CASE (page_id + i) % 11 WHEN 0 THEN 'No ' || {_N} WHEN 1 THEN 'PICK UP' WHEN 2 THEN 'Story' WHEN 3 THEN 'Menu' WHEN 4 THEN 'See our food' WHEN 5 THEN 'Menu' WHEN 6 THEN 'go' WHEN 7 THEN 'About creation' ELSE 'x' END AS label FROM ({_HREFS})),
a AS (SELECT *, lower(label || ' ' || address) AS blob, regexp_extract(lower(address), '^https?://([^/?#]*)', 1) AS host, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) AS own, rtrim(regexp_replace(address, '#.*$', ''), '/') AS key FROM l WHERE address IS NOT NULL),
b AS (SELECT *, replace(host, 'www.', '') = replace(own, 'www.', '') AS same, regexp_matches(blob, '{"|".join(h.replace(".", chr(92) + ".") for h in SKIP_HINTS)}') AS skip,
  (SELECT min(k) FROM (SELECT unnest({list(ORDERING_HOSTS)!r}) AS k) WHERE host = k OR ends_with(host, '.' || k)) AS known FROM a),
c AS (SELECT *, CASE WHEN same AND NOT skip AND regexp_matches(blob, '{_hint(MENU_HINTS)}') AND key <> rtrim(regexp_replace(url, '#.*$', ''), '/') THEN 'same'
  WHEN NOT same AND NOT skip AND (known IS NOT NULL OR regexp_matches(lower(label), '{_hint(EXTERNAL_LABEL_HINTS)}') OR regexp_matches(lower(regexp_extract(address, '^https?://[^/?#]*([^?#]*)', 1)), '{_hint(EXTERNAL_URL_HINTS)}')) AND NOT regexp_matches(lower(address), '^https?://[^?#]*\\.pdf([?#]|$)') THEN 'other' END AS kind FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind, key ORDER BY i) AS n FROM c WHERE kind IS NOT NULL),
e AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY i) - 1 AS place FROM d WHERE n = 1)
SELECT page_id, kind, CAST(place AS INTEGER) AS place, label, address, CASE WHEN kind = 'other' THEN known END AS host FROM e WHERE kind = 'other' OR place < 8""")
def q_menu_links(spark: Spark, sf: str) -> Frame:
    """The menu links of each page, to the same site and to others."""
    pages = table(spark, sf, "pages").select("page_id", "url", _dressed(_LINK_FORMS, 11).alias("html"))
    return menu_links(pages, keep=("page_id",))


_FILLER = "repeat('x', CAST(i % 4 * 260 AS INTEGER))"
_HREF_PIECE = f"""'"href":[0,"' || CASE WHEN (page_id + i) % 3 = 0 THEN replace(href, '/', chr(92) || '/') ELSE 'https:' || chr(92) || '/' || chr(92) || '/o.example' || href || '#f' END || '"]'"""
_LABEL_PIECE = f"""'"content":[ 0 , "Label ' || {_N} || '"]'"""
_PLAIN = "replace({0}, chr(92) || '/', '/')"


@query(f"""
WITH l AS ({_HREFS}),
p AS (SELECT page_id, i, url, CASE WHEN (page_id + i) % 3 = 0 THEN {_ORIGIN} || href ELSE 'https://o.example' || href || '#f' END AS address, CASE WHEN (page_id + i) % 3 = 0 THEN href ELSE 'https://o.example' || href || '#f' END AS written,
  length({_PLAIN.format("(" + _HREF_PIECE + ")")}) AS a, length({_LABEL_PIECE}) AS b, CAST(i % 4 * 260 AS INTEGER) AS f, 'Label ' || {_N} AS label FROM l),
q AS (SELECT *, coalesce(sum(a + 1 + b + f) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
w AS (SELECT x.page_id, x.i, string_agg(y.label, ' ' ORDER BY y.i) AS labels FROM q x JOIN q y ON x.page_id = y.page_id AND y.start + y.a + 1 >= x.start - 500 AND y.start + y.a + 1 + y.b <= x.start + x.a + 900 GROUP BY x.page_id, x.i),
r AS (SELECT q.*, labels, row_number() OVER (PARTITION BY q.page_id, rtrim(regexp_replace(address, '#.*$', ''), '/') ORDER BY q.i) AS n FROM q LEFT JOIN w ON w.page_id = q.page_id AND w.i = q.i)
SELECT page_id, CAST(i AS INTEGER) AS place, coalesce(labels, written) AS label, address FROM r WHERE n = 1""")
def q_serialized_links(spark: Spark, sf: str) -> Frame:
    """Links in serialized data with the labels near them."""
    def piece(href, i):
        n = (F.col("page_id") * 10 + i).cast("string")
        slash = lambda c: F.replace(c, F.lit("/"), F.lit("\\/"))
        to = F.when((F.col("page_id") + i) % 3 == 0, slash(href)).otherwise(slash(F.concat(F.lit("https://o.example"), href, F.lit("#f"))))
        return F.concat(F.lit('&quot;href&quot;:[0,"'), to, F.lit('"],"content":[ 0 , "Label '), n, F.lit('"]'), F.repeat(F.lit("x"), (i % 4 * 260).cast("int")))

    code = F.array_join(F.transform(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), piece), "")
    return serialized_links(table(spark, sf, "pages").select("page_id", "url", code.alias("html")), keep=("page_id",))


_PDF_FORMS = {
    0: '<a href="{href}/m{n}.pdf">x</a>', 1: "<script>view('https://cdn.example/f{n}.PDF?v=2#page=1')</script>", 2: '<embed src = "/files/same.pdf#a{n}">', 3: '<object data="gift{n}.pdf"></object>', 4: '<a href="{href}">a.pdf.html</a>',
}


@query(f"""
WITH l AS (SELECT *, (page_id + i) % 5 AS v FROM ({_HREFS})),
a AS (SELECT page_id, v <> 1 AS part, i, CASE v WHEN 0 THEN {_ORIGIN} || href || '/m' || {_N} || '.pdf' WHEN 1 THEN 'https://cdn.example/f' || {_N} || '.PDF?v=2#page=1' WHEN 2 THEN {_ORIGIN} || '/files/same.pdf#a' || {_N}
  WHEN 3 THEN regexp_extract(url, '^(https?://[^?#]*/)', 1) || 'gift' || {_N} || '.pdf' END AS address FROM l WHERE v <> 4),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY part, i) - 1 AS place, row_number() OVER (PARTITION BY page_id, split_part(address, '#', 1) ORDER BY part, i) AS n FROM a)
SELECT page_id, CAST(place AS INTEGER) AS place, address FROM b WHERE n = 1 AND NOT contains(lower(address), 'gift')""")
def q_pdf_files(spark: Spark, sf: str) -> Frame:
    """The PDF files that each page names, whole addresses before attributes."""
    return pdf_files(table(spark, sf, "pages").select("page_id", "url", _dressed(_PDF_FORMS, 5).alias("html")), keep=("page_id",))


_IMAGE_FORMS = {
    0: '<img src="/i/{n}.jpg" alt="Speisekarte">', 1: '<img data-src="/u/{n}.png">', 2: '<img src="/menu-logo{n}.png" alt="Menu">', 3: '<a href="{href}-menu.webp?w=1">Dinner</a>', 4: '<a href="{href}">menu</a><img alt="menu" src="/same.gif">', 5: '<img src="carte{n}.gif">',
}


@query(f"""
WITH l AS (SELECT *, (page_id + i) % 6 AS v FROM ({_HREFS.replace("SELECT page_id, url, regexp", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '/*([?#].*)?$', '') || '/Carte' ELSE url END AS url, regexp")})),
a AS (SELECT page_id, i, v, v = 3 AS file, v IN (0, 3, 4, 5) AS named, page_id % 2 = 0 AS page, CASE v WHEN 0 THEN {_ORIGIN} || '/i/' || {_N} || '.jpg' WHEN 1 THEN {_ORIGIN} || '/u/' || {_N} || '.png'
  WHEN 3 THEN {_ORIGIN} || href || '-menu.webp?w=1' WHEN 4 THEN {_ORIGIN} || '/same.gif' WHEN 5 THEN regexp_extract(url, '^(https?://[^?#]*/)', 1) || 'carte' || {_N} || '.gif' END AS address FROM l WHERE v <> 2),
b AS (SELECT *, row_number() OVER (PARTITION BY page_id, address ORDER BY file, i) AS n FROM a WHERE named OR page)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY named DESC, file, i) - 1 AS INTEGER) AS place, named, address FROM b WHERE n = 1""")
def q_menu_images(spark: Spark, sf: str) -> Frame:
    """The menu images of each page, named ones first; every other page's path says menu."""
    pages = table(spark, sf, "pages").withColumn("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.regexp_replace("url", "/*([?#].*)?$", ""), F.lit("/Carte"))).otherwise(F.col("url")))
    return menu_images(pages.select("page_id", "url", _dressed(_IMAGE_FORMS, 6).alias("html")), keep=("page_id",))


_KEY = "regexp_replace(rtrim(regexp_replace({0}, '#.*$', ''), '/'), '^(https?)://www[.]', '\\1://')"


@query(f"""
WITH k AS (SELECT regexp_extract(lower(u), '^https?://([^/?#]*)', 1) AS site, u AS key, min(url) AS url FROM (SELECT url, {_KEY.format("url")} AS u FROM pages) GROUP BY u),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY key) - 1 AS r, count(*) OVER (PARTITION BY site) AS n FROM k),
e AS (SELECT a.site, a.key AS src, a.r AS rank, t AS place, CASE WHEN t = 2 THEN regexp_extract(a.url, '^(https?://[^/?#]+)', 1) || '/none' || a.r ELSE b.url || '#t' || t END AS url
  FROM n a, (SELECT unnest(range(9)) AS t) JOIN n b ON b.site = a.site AND b.r = (a.r * 2 + 1 + t * 3) % a.n),
l AS (SELECT *, {_KEY.format("url")} AS key FROM e),
s AS (SELECT site, key AS landing, url AS home FROM n WHERE r = 0),
f AS (SELECT site, 1 + place AS visit, url, key FROM l WHERE rank = 0 AND place < 8
  UNION ALL SELECT site, 9, u, key FROM (SELECT *, {_KEY.format("u")} AS key FROM (SELECT site, home, regexp_extract(home, '^(https?://[^/?#]+)', 1) || '/menu' AS u FROM s)) m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.site = m.site AND rank = 0 AND place < 8 AND l.key = m.key)),
h AS (SELECT f.site, f.visit, k.url AS address, f.url, f.key FROM f JOIN k ON k.key = f.key WHERE visit <= 12),
seen AS (SELECT site, landing AS key FROM s UNION SELECT site, key FROM f),
g AS (SELECT l.site, l.url, l.key, h.visit, l.place, row_number() OVER (PARTITION BY l.site, l.key ORDER BY h.visit, l.place) AS n FROM h JOIN l ON l.src = h.key AND l.place < 8 WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.site = l.site AND seen.key = l.key)),
q AS (SELECT g.site, c.n + row_number() OVER (PARTITION BY g.site ORDER BY visit, place) AS visit, url, key FROM g JOIN (SELECT site, count(*) AS n FROM f GROUP BY site) c ON c.site = g.site WHERE g.n = 1)
SELECT site, 0 AS visit, 0 AS hop, home AS address, home AS url FROM s
UNION ALL SELECT site, CAST(visit AS INTEGER), 1, address, url FROM h
UNION ALL SELECT q.site, CAST(visit AS INTEGER), 2, k.url, q.url FROM q JOIN k ON k.key = q.key WHERE visit <= 12""")
def q_frontier(spark: Spark, sf: str) -> Frame:
    """Which pages of each site a crawl of two hops and twelve requests holds, over all pages."""
    key = visit_key(F.col("url"))
    site = F.regexp_extract(F.lower("key"), "^https?://([^/?#]*)", 1)
    nodes = table(spark, sf, "pages").groupBy(key.alias("key")).agg(F.min("url").alias("url")).withColumn("site", site)
    own = Window.partitionBy("site")
    nodes = nodes.withColumns({"r": F.row_number().over(own.orderBy("key")) - 1, "n": F.count("*").over(own)})
    ends = nodes.select("site", F.col("r").alias("to"), F.col("url").alias("target"))
    out = nodes.select("site", F.col("url").alias("page"), "r", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("place"), "n").withColumn("to", (F.col("r") * 2 + 1 + F.col("place") * 3) % F.col("n")).join(ends, ["site", "to"])
    origin = F.regexp_extract("page", "^(https?://[^/?#]+)", 1)
    address = F.when(F.col("place") == 2, F.concat(origin, F.lit("/none"), F.col("r").cast("string"))).otherwise(F.concat("target", F.lit("#t"), F.col("place").cast("string")))
    sites = nodes.where("r = 0").select("site", "url", F.lit(None).cast("string").alias("canonical"))
    return frontier(sites, nodes.select("url", F.col("url").alias("address")), out.select("page", "place", address.alias("address")))


@query("""
WITH RECURSIVE b AS (SELECT doc_id, doc_id // 8 AS site, doc_id % 8 AS k, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS before FROM documents),
p AS (SELECT site, doc_id AS place, CASE k WHEN 0 THEN 'https://www.s' || site || '.example/' WHEN 1 THEN 'https://www.toasttab.com/a' || site WHEN 2 THEN 'https://order.toasttab.com/b' || site WHEN 3 THEN 'https://www.doordash.com/store/' || site
    WHEN 7 THEN 'https://www.s' || site || '.example/p' || 6 ELSE 'https://www.s' || site || '.example/p' || k END AS url,
  CASE WHEN k = 5 THEN substr(before, length(before) // 2) WHEN k = 6 THEN before || 'x' ELSE text END AS text,
  (doc_id * 37 % 101) / 100.0 AS score, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 16 END AS prices, doc_id % 5 AS sections FROM b),
f AS (SELECT *, score >= 0.45 AS is_menu, regexp_extract(url, '(toasttab.com|doordash.com)', 1) AS host FROM p QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY place) = 1),
t AS (SELECT site, arg_min(url, (-score, place)) AS best_url, arg_min(text, (-score, place)) AS best_text, max(score) AS top,
  arg_min(host, (-score, -prices, place)) FILTER (WHERE is_menu AND prices >= 8 AND host <> '') AS platform FROM f GROUP BY site),
s AS (SELECT *, CASE WHEN length(best_text) < 200 THEN 'too_little_text' WHEN top < 0.45 THEN 'no_menu' ELSE 'ok' END AS status FROM t),
c AS (SELECT f.site, f.url, f.text, row_number() OVER (PARTITION BY f.site ORDER BY score DESC, place) AS r FROM f JOIN s ON f.site = s.site WHERE status = 'ok' AND is_menu AND length(text) >= 200
  AND NOT (host <> '' AND platform IS NOT NULL AND host <> platform) AND NOT (top >= 0.75 AND url = 'https://www.s' || f.site || '.example/' AND score < 0.6 AND prices = 0 AND sections < 2)),
k AS (SELECT site, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS total, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS texts FROM s
  UNION ALL SELECT k.site, k.next, CASE WHEN ok THEN total + length(k.text) ELSE total END, CASE WHEN ok THEN list_append(urls, k.url) ELSE urls END, CASE WHEN ok THEN list_append(texts, k.text) ELSE texts END
    FROM (SELECT k.*, c.r AS next, c.url, c.text, len(list_filter(texts, lambda x: contains(x, c.text) OR contains(c.text, x))) = 0 AND (len(texts) = 0 OR total + length(c.text) <= 50000) AS ok FROM k JOIN c ON c.site = k.site AND c.r = k.r + 1) k),
l AS (SELECT site, arg_max(urls, r) AS urls, arg_max(texts, r) AS texts FROM k GROUP BY site)
SELECT s.site, status, best_url, CAST(top AS DOUBLE) AS score, CASE WHEN status = 'ok' THEN array_to_string(urls, ' ') END AS urls,
  sha256(CASE WHEN len(urls) > 1 THEN array_to_string(list_transform(range(1, len(urls) + 1), lambda i: '[page: ' || urls[i] || ']' || chr(10) || texts[i]), chr(10) || chr(10)) ELSE best_text END) AS text
FROM s JOIN l ON l.site = s.site""")
def q_page_finish(spark: Spark, sf: str) -> Frame:
    """What is kept of crawls of eight pages each, over all documents."""
    site, k = F.floor(F.col("doc_id") / 8).cast("long"), F.col("doc_id") % 8
    docs = table(spark, sf, "documents").select("doc_id", site.alias("site"), k.alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("before", F.lag("text").over(Window.partitionBy("site").orderBy("doc_id")))
    home, n = F.concat(F.lit("https://www.s"), F.col("site").cast("string"), F.lit(".example/")), F.col("site").cast("string")
    url = F.when(F.col("k") == 0, home).when(F.col("k") == 1, F.concat(F.lit("https://www.toasttab.com/a"), n)).when(F.col("k") == 2, F.concat(F.lit("https://order.toasttab.com/b"), n)).when(F.col("k") == 3, F.concat(F.lit("https://www.doordash.com/store/"), n))
    url = url.otherwise(F.concat(home, F.lit("p"), F.when(F.col("k") == 7, "6").otherwise(F.col("k").cast("string"))))
    text = F.when(F.col("k") == 5, F.expr("substring(before, cast(length(before) / 2 as int))")).when(F.col("k") == 6, F.concat("before", F.lit("x"))).otherwise(F.col("text"))
    i = F.col("doc_id")
    pages = docs.select("site", i.alias("place"), url.alias("url"), text.alias("text"), ((i * 37 % 101) / 100.0).alias("score"), F.when(i % 3 == 0, 0).otherwise(i % 16).alias("prices"), (i % 5).alias("sections")).withColumn("is_menu", F.col("score") >= 0.45)
    sites = docs.where("k = 0").select("site", home.alias("landing"))
    out = finished(pages, sites, "site")
    return out.select("site", "status", "best_url", "score", F.array_join("urls", " ").alias("urls"), F.sha2("text", 256).alias("text"))

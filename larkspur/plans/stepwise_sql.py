"""SQL of queries whose operators go step by step: recursion over rows in order, all pairs, bit by bit texts.

It is written from the rules by plain means, and for the sizes of a test."""

from __future__ import annotations

from ..functions.documents import FOOD_WORDS, GIFT_WORDS, PRICE, SECTION_WORDS, TRAILING_PRICE
from ..operators.extract import HIDDEN_TAGS
from ..operators.locate import LOCATION_SEGMENTS, STREET_SUFFIXES
from ..operators.locate import SECTION_WORDS as PLACE_SECTIONS


def _shown() -> str:
    text = "html"
    for tag in HIDDEN_TAGS:
        text = f"regexp_replace({text}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', chr(1), 'g')"
    text = f"regexp_replace(regexp_replace({text}, '(?s)<!--.*?-->|<![^>]*>', chr(1), 'g'), '<[^>]*>', chr(1), 'g')"
    for coded, plain in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&#x27;", "''''"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{coded}', {plain})"
    return text


HTML_TEXT = f"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_shown()}, '[\\x01\\n]'), lambda x: regexp_replace(x, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages"""

HOURS = """SELECT s_suppkey, CAST(s_suppkey % 7 AS INTEGER) AS day, CAST(s_suppkey * 37 % 1440 AS INTEGER) AS minute,
  (s_suppkey % 7 < 6 AND (s_suppkey * 37 % 1440 BETWEEN 660 AND 899 OR s_suppkey * 37 % 1440 >= 1020)) OR ((s_suppkey + 6) % 7 < 6 AND s_suppkey * 37 % 1440 < 60 * (s_suppkey % 6 + 1)) AS open FROM supplier"""

CHUNKS = """WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text <> ''),
s AS (SELECT doc_id, i, length(x) + 1 AS n FROM l),
c AS (SELECT doc_id, i, n AS held, 0 AS place FROM s WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, CASE WHEN c.held + s.n > 2000 THEN s.n ELSE c.held + s.n END, CASE WHEN c.held + s.n > 2000 THEN c.place + 1 ELSE c.place END FROM c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i + 1)
SELECT doc_id, place, CAST(max(held) - 1 AS INTEGER) AS size FROM c GROUP BY doc_id, place"""


def _dishes(owners: int, name: str, price: str, described: str, calories: str) -> str:
    return f"""d AS (SELECT p_partkey % {owners} AS r, p_partkey AS id, {name} AS name, {price} AS price, {described} AS descr, {calories} AS cal, p_size % 7 AS last FROM part),
k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS kn, coalesce(substr(price, 2), '') AS kp, coalesce(regexp_replace(lower(descr), '[^a-z0-9]', '', 'g'), '') AS kd, coalesce(replace(cal, ' ', ''), '') AS kc FROM d)"""


_AGREES = "(s.d = '' OR t.kd = '' OR s.d = t.kd) AND (s.c = '' OR t.kc = '' OR s.c = t.kc)"

IDENTITY_GROUPS = f"""WITH RECURSIVE {_dishes(10, "p_name", "'$' || (p_size % 3)", "CASE WHEN p_size % 4 <> 0 THEN 'with ' || p_type END", "CASE WHEN p_size % 5 = 0 THEN '450 cal' END")},
o AS (SELECT r, kn, kp, kd, kc, min(id) AS first, row_number() OVER (PARTITION BY r, kn, kp ORDER BY min(id)) AS i FROM k GROUP BY r, kn, kp, kd, kc),
g AS (SELECT r, kn, kp, i, first AS seed, kd, kc, [{{'d': kd, 'c': kc, 'id': first}}] AS seeds FROM o WHERE i = 1
  UNION ALL SELECT t.r, t.kn, t.kp, t.i, coalesce(hit, t.first), t.kd, t.kc, CASE WHEN hit IS NULL THEN list_append(seeds, {{'d': t.kd, 'c': t.kc, 'id': t.first}}) ELSE seeds END
    FROM (SELECT t.*, g.seeds, list_filter(g.seeds, lambda s: {_AGREES})[1].id AS hit FROM g JOIN o t ON t.r = g.r AND t.kn = g.kn AND t.kp = g.kp AND t.i = g.i + 1) t),
m AS (SELECT k.r, k.id, seed, last, length(coalesce(descr, '')) AS n FROM k JOIN g ON g.r = k.r AND g.kn = k.kn AND g.kp = k.kp AND g.kd = k.kd AND g.kc = k.kc)
SELECT r AS restaurant_id, id, arg_max(id, (last, n, -id)) OVER (PARTITION BY seed) AS survivor FROM m"""

_PARTS = _dishes(40, "CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE p_type END", "CASE WHEN p_size % 3 <> 0 THEN '$' || (p_size % 2 + 8) END", "CASE p_size % 4 WHEN 1 THEN 'hot' WHEN 2 THEN 'HOT!' WHEN 3 THEN 'mild' END", "CASE p_partkey % 5 WHEN 0 THEN '90 cal' WHEN 1 THEN '80 cal' END")

UPSERT_DISHES = f"""WITH RECURSIVE {_PARTS},
b AS (SELECT r, kn, kp, list({{'d': kd, 'c': kc, 'id': first}} ORDER BY first) AS known FROM (SELECT r, kn, kp, kd, kc, min(id) AS first FROM k WHERE id % 3 <> 0 GROUP BY ALL) GROUP BY r, kn, kp),
o AS (SELECT r, kn, kp, kd, kc, min(id) AS first, row_number() OVER (PARTITION BY r, kn, kp ORDER BY min(id)) AS i FROM k WHERE id % 3 = 0 GROUP BY r, kn, kp, kd, kc),
g AS (SELECT DISTINCT o.r, o.kn, o.kp, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS kd, CAST(NULL AS VARCHAR) AS kc, CAST(NULL AS BIGINT) AS exact, CAST(NULL AS BIGINT) AS close, CAST(NULL AS BIGINT) AS first, coalesce(known, []) AS known FROM o LEFT JOIN b ON b.r = o.r AND b.kn = o.kn AND b.kp = o.kp
  UNION ALL SELECT t.r, t.kn, t.kp, t.i, t.kd, t.kc, exact, close, t.first, CASE WHEN close IS NULL THEN list_append(known, {{'d': t.kd, 'c': t.kc, 'id': t.first}}) ELSE known END
    FROM (SELECT t.*, g.known, list_filter(g.known, lambda s: s.d = t.kd AND s.c = t.kc)[1].id AS exact, list_filter(g.known, lambda s: {_AGREES})[1].id AS close FROM g JOIN o t ON t.r = g.r AND t.kn = g.kn AND t.kp = g.kp AND t.i = g.i + 1) t)
SELECT k.id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN close IS NOT NULL THEN 'compatible' WHEN k.id = g.first THEN 'insert' ELSE 'exact' END AS action, coalesce(exact, close, g.first) AS target
FROM k JOIN g ON g.r = k.r AND g.kn = k.kn AND g.kp = k.kp AND g.kd = k.kd AND g.kc = k.kc WHERE k.id % 3 = 0"""


def counted(words) -> str:
    """Occurrences of words as substrings of ``low``, word by word."""
    return " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)


KEEP_PAGES = rf"""WITH RECURSIVE t AS (SELECT source, doc_id, text, lower(text) AS low, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, len(regexp_extract_all(text, '{PRICE}')) + len(regexp_extract_all(text, '{TRAILING_PRICE}')) AS prices, {counted(FOOD_WORDS)} AS food, {" + ".join(f"contains(low, '{w}')::INT" for w in SECTION_WORDS)} AS sections, {counted(GIFT_WORDS)} AS gifts FROM t),
f AS (SELECT *, least(prices / 8.0::DOUBLE, 1.0) AS p, least(food / 25.0::DOUBLE, 1.0) AS f, least(sections / 3.0::DOUBLE, 1.0) AS s, CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: length(x) BETWEEN 3 AND 80))::DOUBLE / len(l) ELSE 0.0 END AS r FROM c),
g AS (SELECT *, CASE WHEN prices = 0 THEN greatest(p * 0.40::DOUBLE + f * 0.25::DOUBLE + s * 0.20::DOUBLE + r * 0.15::DOUBLE, f * 0.40::DOUBLE + s * 0.30::DOUBLE + r * 0.30::DOUBLE) ELSE p * 0.40::DOUBLE + f * 0.25::DOUBLE + s * 0.20::DOUBLE + r * 0.15::DOUBLE END AS x FROM f),
h AS (SELECT source, doc_id, text, round(least(CASE WHEN gifts >= 3 AND food < 10 THEN least(x, 0.25) ELSE x END, 1.0), 3) AS score FROM g),
o AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS i FROM h WHERE score >= 0.1 AND length(text) >= 200),
k AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS pages, CAST([] AS VARCHAR[]) AS texts FROM o
  UNION ALL SELECT q.source, q.i, CASE WHEN ok THEN total + length(q.text) ELSE total END, CASE WHEN ok THEN list_append(pages, q.doc_id) ELSE pages END, CASE WHEN ok THEN list_append(texts, q.text) ELSE texts END
    FROM (SELECT o.*, k.total, k.pages, k.texts, len(list_filter(texts, lambda x: contains(x, o.text) OR contains(o.text, x))) = 0 AND (len(texts) = 0 OR total + length(o.text) <= 50000) AS ok FROM k JOIN o ON o.source IS NOT DISTINCT FROM k.source AND o.i = k.i + 1) q),
z AS (SELECT source, arg_max(pages, i) AS pages FROM k GROUP BY source)
SELECT source, unnest(pages) AS page, unnest(range(len(pages))) AS place FROM z"""

# -- the location filter: addresses with their tokens, what each says, and all pairs of a record's ----------------------------

_FOUND = """o AS (SELECT o_custkey AS record, CAST(o_orderkey % 3 AS INTEGER) AS batch, o_orderkey AS place, CAST(o_custkey % 900 + 100 AS VARCHAR) AS n, o_custkey % 7 <> 0 AS known,
  replace(list_extract(['https://a.example/{}', 'https://a.example/{}/menu', 'https://b.example/Menus-{}.pdf'], 1 + CAST(o_orderkey % 3 AS INTEGER)), '{}',
    list_extract(['winter-park', 'maitland', 'orlando', 'winter-garden', 'horatio', 'corrine', 'dinner', 'locations/tampa', 'locations/maitland', '77-oak-street', 'park', CAST(o_custkey % 900 + 100 AS VARCHAR) || '-horatio-ave'], 1 + CAST((o_orderkey * 7919 + o_custkey * 31) % 12 AS INTEGER))) AS url,
  [['horatio'], ['corrine']][1 + CAST(o_custkey % 2 AS INTEGER)] AS street, [['winter', 'park'], ['maitland'], ['orlando']][1 + CAST(o_custkey % 3 AS INTEGER)] AS city FROM orders)"""
_TOKENS = "r AS (SELECT *, regexp_extract(url, '^https://([^/]*)', 1) AS host, list_filter(regexp_split_to_array(lower(regexp_replace(url, '^https://[^/]*', '')), '[^0-9a-z]+'), lambda x: x <> '') AS t FROM o)"
_SUFFIXES, _SEGMENTS, _SECTIONS = (repr(list(words)) for words in (STREET_SUFFIXES, LOCATION_SEGMENTS, PLACE_SECTIONS))
_SAID = f"""f AS (SELECT *, list_contains(t, n) OR (len(list_filter(street, lambda w: NOT list_contains(t, w))) = 0 AND len(list_filter(range(1, len(t) + 1), lambda i: list_contains(street, t[i]) AND len(list_intersect(t[i + 1:i + 2], {_SUFFIXES})) > 0)) > 0) AS strong,
  len(list_filter(range(1, len(t) + 1), lambda i: (list_contains({_SEGMENTS}, t[i]) AND i < len(t)) OR (regexp_full_match(t[i], '[1-9][0-9]{{0,4}}') AND NOT coalesce(regexp_full_match(t[i + 1], '[0-9]+'), false) AND len(list_intersect(t[i + 1:i + 5], {_SUFFIXES})) > 0))) > 0 AS specific,
  len(list_filter(city, lambda w: NOT list_contains(t, w))) = 0 OR list_contains(t, array_to_string(city, '')) AS near FROM r)"""


def _names(span: str, row: str) -> str:
    words = f"list_sort(list_distinct({span}))"
    return f"({words} = list_sort({row}.city) OR {words} = list_sort({row}.street) OR (len({words}) = 1 AND {span}[1] IN (array_to_string({row}.city, ''), {row}.n)))"


def _siblings(seen: str, found: str) -> str:
    """(record, url) of ``found`` that differ from one of ``seen`` in another place."""
    head = "coalesce(list_filter(range(1, least(len(a.t), len(b.t)) + 1), lambda i: a.t[i] <> b.t[i])[1] - 1, least(len(a.t), len(b.t)))"
    tail = "least(coalesce(list_filter(range(1, m + 1), lambda i: ta[len(ta) + 1 - i] <> tb[len(tb) + 1 - i])[1] - 1, m), m - h)"
    return f"""SELECT DISTINCT record, url FROM (SELECT record, url, tb, ta, n, city, street, h, {tail} AS e FROM
    (SELECT b.record, b.url, a.t AS ta, b.t AS tb, b.n, b.city, b.street, least(len(a.t), len(b.t)) AS m, {head} AS h FROM {seen} a JOIN {found} b ON a.record = b.record AND a.host = b.host AND a.url <> b.url WHERE b.known)) q
  WHERE len(ta) - h - e BETWEEN 1 AND 4 AND len(tb) - h - e BETWEEN 1 AND 4 AND {_names("ta[h + 1:len(ta) - e]", "q")} AND NOT {_names("tb[h + 1:len(tb) - e]", "q")} AND len(list_intersect(tb[h + 1:len(tb) - e], {_SECTIONS})) = 0"""


def _batch(k: int) -> str:
    """The batch k: what was seen, what goes as a sibling, which records are anchored, what is kept."""
    seen = " UNION ALL ".join(f"SELECT record, host, url, t FROM k{j}" for j in range(k))
    anchored = " UNION ALL ".join(f"SELECT record FROM k{j} WHERE known AND strong" for j in range(k))
    return f"""b{k} AS (SELECT * FROM f WHERE batch = {k}), p{k} AS (SELECT DISTINCT record, host, url, t FROM b{k}{" UNION " + seen if k else ""}), g{k} AS ({_siblings(f"p{k}", f"b{k}")}),
s{k} AS (SELECT * FROM b{k} WHERE NOT EXISTS (SELECT 1 FROM g{k} WHERE g{k}.record = b{k}.record AND g{k}.url = b{k}.url)), a{k} AS (SELECT record FROM s{k} WHERE strong{" UNION " + anchored if k else ""}),
k{k} AS (SELECT * FROM s{k} WHERE NOT known OR NOT specific OR strong OR near OR record NOT IN (SELECT record FROM a{k}))"""


SIBLING_DROPS = f"WITH {_FOUND}, {_TOKENS} {_siblings('r', 'r')}"
LOCATION_BATCHES = f"WITH {_FOUND}, {_TOKENS}, {_SAID}, {_batch(0)}, {_batch(1)}, {_batch(2)} " + " UNION ALL ".join(f"SELECT record, batch, place, url FROM k{k}" for k in range(3))
_SUPPLIERS = """o AS (SELECT s_suppkey, CAST(s_suppkey % 900 + 100 AS VARCHAR) AS n, ['horatio'] AS street, ['winter', 'park'] AS city, unnest(list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.example/' || (s_suppkey % 900 + 100) || '-horatio-ave/menu' END, 'https://x.example/menu', 'https://x.example/locations/daytona',
  'https://x.example/' || (s_suppkey % 9 + 10) || '-main-street'], lambda x: x IS NOT NULL)) AS url FROM supplier)"""
URL_FILTER = f"WITH {_SUPPLIERS}, {_TOKENS}, {_SAID} SELECT s_suppkey, url FROM f WHERE NOT (specific AND NOT strong AND NOT near AND s_suppkey IN (SELECT s_suppkey FROM f WHERE strong))"

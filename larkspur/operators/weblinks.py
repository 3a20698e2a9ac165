"""Where a page leads: menu links, ordering hosts, links hidden in serialized data, PDF files, menu images, and the
order in which a site's pages are visited.

A page is read once into an ordered stream of elements (kind, label, address as written, address resolved);
what they mean is decided by columns, and quotas and firsts by windows over the page's elements.
"""

from __future__ import annotations

import html as html_lib
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import url_path

# --- fixed values: words and hosts of links ---------------------------------------------------------------
MENU_HINTS = (
    "menu", "menus", "food", "dinner", "lunch", "breakfast", "brunch", "dine", "eat", "order", "our-food", "carte",
    "appetizers", "starters", "entrees", "sandwiches", "salads", "soups", "sides", "bowls", "wraps", "paninis", "burgers", "pizza", "pizzas", "pasta", "tacos", "sushi",
    "desserts", "dessert", "deserts", "happy hour", "happy-hour", "beverages", "drinks", "specials",
)
EXTERNAL_URL_HINTS = ("menu", "menus", "order", "ordering")
EXTERNAL_LABEL_HINTS = ("menu", "menus", "order", "ordering", "order online", "pick up", "pickup", "delivery")
SKIP_HINTS = (
    "facebook.", "instagram.", "twitter.", "yelp.", "tel:", "mailto:", "maps.app.goo.gl", "google.com/maps", "forms.gle", "youtube.", "tiktok.",
    "gift", "voucher", "donate", "merch", "careers", "hiring",
)
ORDERING_HOSTS = (
    "toasttab.com", "toast.site", "square.site", "squareup.com", "clover.com", "cloveronline.com", "getsauce.com", "grubhub.com", "doordash.com", "ubereats.com", "chownow.com", "popmenu.com", "menufy.com",
    "slicelife.com", "activemenus.com", "mealkeyway.com", "viguest.com",
)
IMAGE_WORDS = ("menu", "carte", "speisekarte")
NOT_IMAGE_WORDS = ("logo", "icon", "sprite", "banner-home", "favicon")
IMAGE_FILE = r"(?i)\.(jpe?g|png|webp|gif)(\?|#|$)"
SERIALIZED_LABELS = ("content", "label", "name", "text")
LABEL_BEFORE, LABEL_AFTER = 500, 900
LOCATION_SUBDOMAINS = ("locations", "restaurants", "stores", "local")
MOST_FOLLOWED, MOST_FETCHED = 8, 12
# -----------------------------------------------------------------------------------------------------------


class _Elements(HTMLParser):
    """Anchors and images in order, each with its label."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, list[str], str]] = []
        self.open: list[list[str]] = []
        self.quiet = False

    def handle_starttag(self, tag, attrs):
        has = dict(attrs)
        if tag == "a":
            label: list[str] = []
            self.open.append(label)
            if has.get("href") is not None:
                self.out.append(("a", label, has["href"]))
        elif tag == "img":
            self.out.append(("img", [has.get("alt") or ""], has.get("src") or has.get("data-src") or ""))
        elif tag in ("script", "style"):
            self.quiet = True

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.open.pop()
        elif tag in ("script", "style"):
            self.quiet = False

    def handle_data(self, data):
        if data.strip() and not self.quiet:
            for label in self.open:
                label.append(data.strip())


def _resolved(base: str | None, address: str) -> str | None:
    try:
        return urljoin(base or "", address)
    except ValueError:  # no address at all, such as http://[
        return None


def elements(html: str | None, url: str | None) -> list[dict]:
    parser = _Elements()
    parser.feed(html or "")
    parser.close()
    return [{"kind": kind, "label": " ".join(label), "written": written.strip(), "address": _resolved(url, written.strip())} for kind, label, written in parser.out]


ELEMENT = "struct<kind: string, label: string, written: string, address: string>"


def page_elements(html: Column, url: Column) -> Column:
    """Pages are long and elements many, so rows go to Python by the hundred, not by the ten thousand."""
    return F.udf(elements, f"array<{ELEMENT}>", useArrow=False)(html, url)


def resolved(base: Column, address: Column) -> Column:
    """An address as seen from a page; null where it is none."""
    @F.pandas_udf("string")
    def joined(b: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else _resolved(x, y) for x, y in zip(b, a, strict=True)])

    return joined(base, address)


# -- predicates ----------------------------------------------------------------------------------------------


def hinted(text: Column, hints: tuple[str, ...]) -> Column:
    """Whether a lower-case text has one of the hints with no letter beside it."""
    return text.rlike("(?<![a-z])(?:" + "|".join(re.escape(h) for h in sorted(hints, key=len, reverse=True)) + ")(?![a-z])")


def skipped(text: Column) -> Column:
    return text.rlike("|".join(re.escape(h) for h in SKIP_HINTS))


def address_host(address: Column, port: bool = False) -> Column:
    """The host in lower case as it stands, with its port if asked for; empty if there is none."""
    host = F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    return host if port else F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")


def ordering_host(address: Column) -> Column:
    """The ordering platform that an address is on, else null."""
    known = "|".join(re.escape(h) for h in ORDERING_HOSTS)  # none ends with another
    return F.nullif(F.regexp_extract(address_host(address), rf"(?:^|\.)({known})\.?$", 1), F.lit(""))


def menu_link(label: Column, address: Column) -> Column:
    """Of the same site: a hint in label or address, and no skip word."""
    blob = F.lower(F.concat(label, F.lit(" "), address))
    return ~skipped(blob) & hinted(blob, MENU_HINTS)


def external_menu_link(label: Column, address: Column) -> Column:
    """Of another site: an ordering platform, or a label or path that says menu or order; no skip word."""
    blob = F.lower(F.concat(label, F.lit(" "), address))
    return ~skipped(blob) & (ordering_host(address).isNotNull() | hinted(F.lower(label), EXTERNAL_LABEL_HINTS) | hinted(F.lower(url_path(address)), EXTERNAL_URL_HINTS))


def pdf_address(address: Column) -> Column:
    return F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/?#]*)?)?([^?#;]*)", 1)).endswith(".pdf")


def without_fragment(address: Column) -> Column:
    return F.rtrim(F.regexp_replace(address, r"(?s)#.*$", ""), F.lit("/"))


def visit_key(address: Column) -> Column:
    """One key for an address with or without fragment, final slashes and a leading www."""
    return F.regexp_replace(without_fragment(address), r"^(?i)(https?)://www\.", "$1://")


# -- links of a page -----------------------------------------------------------------------------------------


def decoded_markup(markup: Column) -> Column:
    """Markup with HTML references and escaped slashes and ampersands decoded."""
    plain = F.udf(lambda x: None if x is None else html_lib.unescape(x), "string", useArrow=False)
    text = F.when(markup.contains("&"), plain(markup)).otherwise(markup)
    return F.replace(F.replace(text, F.lit("\\/"), F.lit("/")), F.lit("\\u0026"), F.lit("&"))


_HREF = r'(?i)"href"\s*:\s*\[\s*0\s*,\s*"([^"]+)"\s*\]'
_LABEL = r'(?i)"(?:' + "|".join(SERIALIZED_LABELS) + r')"\s*:\s*\[\s*0\s*,\s*"([^"]+)"\s*\]'


def serialized_links(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., place, label, address) of the links in serialized data (``"href":[0,"..."]``): its label is all
    label values that stand whole within 500 characters before it and 900 after it, else the address as
    written.  The first of equal addresses stays; fragments and final slashes tell none apart."""
    held = pages.where(F.col(html).contains("href")).select(*keep, F.col(url).alias("page_url"), decoded_markup(F.col(html)).alias("code"))
    pieces = held.withColumns({"hrefs": F.regexp_extract_all("code", F.lit(_HREF), F.lit(1)), "between": F.split("code", _HREF.replace('([^"]+)', '[^"]+'))}).where(F.size("hrefs") > 0)
    # a link ends after all that is between the links before it, those links, and itself
    whole = F.regexp_extract_all("code", F.lit("(" + _HREF.replace('([^"]+)', '[^"]+') + ")"), F.lit(1))
    spans = pieces.withColumn("wholes", whole)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x["between"]) + F.length(x["wholes"])).alias("at"), F.concat(acc["ends"], F.array(acc["at"] + F.length(x["between"]) + F.length(x["wholes"]))).alias("ends"))
    spans = spans.withColumn("ends", F.aggregate(F.slice(F.arrays_zip("between", "wholes"), F.lit(1), F.size("hrefs")), begin, step)["ends"])
    at = spans.select(*keep, "page_url", "code", F.posexplode(F.arrays_zip("hrefs", "wholes", "ends")).alias("place", "x"))
    start = F.col("x.ends") - F.length("x.wholes")
    low = F.greatest(F.lit(0), start - LABEL_BEFORE)
    window = F.substring("code", low + 1, F.col("x.ends") + LABEL_AFTER - low)
    labels = F.array_join(F.regexp_extract_all(window, F.lit(_LABEL), F.lit(1)), " ")
    href = F.trim(F.col("x.hrefs"))
    rows = at.select(*keep, "place", F.when(labels != "", labels).otherwise(href).alias("label"), resolved(F.col("page_url"), href).alias("address")).where("address IS NOT NULL")
    return _first_of(rows, keep, without_fragment(F.col("address")))


def _first_of(rows: DataFrame, keep: tuple[str, ...], key: Column) -> DataFrame:
    """The first row, by place, of each key of a page."""
    first = rows.withColumn("__key", key).withColumn("__n", F.row_number().over(Window.partitionBy(*keep, "__key").orderBy("place")))
    return first.where("__n = 1").drop("__key", "__n")


def menu_links(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = (), most: int = MOST_FOLLOWED) -> DataFrame:
    """(keep..., kind, place, label, address, host) of a page's menu links, anchors first and then those in
    serialized data.  ``same``: other pages of the same site, the first ``most``; ``other``: links to other
    sites that are no PDF, with the ordering platform where it is one.  The first of equal addresses stays.
    ``keep`` has to name the page."""
    anchors = pages.select(*keep, F.col(url).alias("page_url"), F.posexplode(page_elements(F.col(html), F.col(url))).alias("place", "e")).where("e.kind = 'a'")
    anchors = anchors.select(*keep, "page_url", F.lit(0).alias("part"), "place", "e.label", "e.written", "e.address")
    hidden = serialized_links(pages.withColumn("__url", F.col(url)), html, url, (*keep, "__url"))
    hidden = hidden.select(*keep, F.col("__url").alias("page_url"), F.lit(1).alias("part"), "place", "label", F.col("address").alias("written"), "address")
    both = anchors.unionByName(hidden).where("written <> '' AND NOT startswith(written, '#') AND address IS NOT NULL")
    bare = lambda c: F.replace(address_host(c, port=True), F.lit("www."), F.lit(""))
    address, label = F.col("address"), F.col("label")
    same = bare(address) == bare(F.col("page_url"))
    other = ~same & external_menu_link(label, address) & ~pdf_address(address)
    own = same & menu_link(label, address) & (without_fragment(address) != without_fragment(F.col("page_url")))
    found = both.withColumn("kind", F.when(own, "same").when(other, "other")).where("kind IS NOT NULL").withColumn("key", without_fragment(address))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy(*keep, "kind", "key").orderBy("part", "place"))).where("n = 1")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(*keep, "kind").orderBy("part", "place")) - 1).where((F.col("kind") == "other") | (F.col("place") < most))
    return ranked.select(*keep, "kind", "place", "label", "address", F.when(F.col("kind") == "other", ordering_host(address)).alias("host"))


def pdf_files(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., place, address) of the PDF files that a page names: whole addresses anywhere, then attributes,
    resolved.  The first of those that differ in the fragment alone stays; addresses with skip words go."""
    whole = F.regexp_extract_all(html, F.lit(r"""(?i)(https?://[^\s'"<>()]+\.pdf(?:[?#][^\s'"<>()]*)?)"""), F.lit(1))
    named = F.regexp_extract_all(html, F.lit(r"""(?i)(?:href|src|data)\s*=\s*["']([^"']+\.pdf(?:[?#][^"']*)?)["']"""), F.lit(1))
    rows = pages.where(F.lower(html).contains(".pdf")).select(*keep, F.col(url).alias("page_url"), F.posexplode(F.concat(whole, named)).alias("place", "written"))
    rows = rows.select(*keep, "place", resolved(F.col("page_url"), F.col("written")).alias("address")).where("address IS NOT NULL")
    return _first_of(rows, keep, F.substring_index("address", "#", 1)).where(~skipped(F.lower("address")))


def menu_images(pages: DataFrame, html: str = "html", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., place, named, address) of a page's menu images, those first whose text or file says menu; on a page whose
    path does, any image that is no logo or icon.  Links to image files count too, after the images."""
    rows = pages.select(*keep, F.col(url).alias("page_url"), F.posexplode(page_elements(F.col(html), F.col(url))).alias("place", "e"))
    rows = rows.where((F.col("e.kind") == "img") | F.col("e.written").rlike(IMAGE_FILE))
    any_of = lambda c, words: c.rlike("|".join(re.escape(w) for w in words))
    blob = F.lower(F.concat("e.label", F.lit(" "), "e.written"))
    rows = rows.select(*keep, "place", (F.col("e.kind") == "a").alias("file"), any_of(blob, IMAGE_WORDS).alias("named"), any_of(blob, NOT_IMAGE_WORDS).alias("other"), any_of(F.lower(url_path(F.col("page_url"))), IMAGE_WORDS).alias("page"), F.col("e.address").alias("address"))
    rows = rows.where("address IS NOT NULL AND NOT other AND (named OR page)")
    order = Window.partitionBy(*keep, "address").orderBy("file", "place")
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    place = F.row_number().over(Window.partitionBy(*keep).orderBy(F.desc("named"), "file", "place")) - 1
    return first.select(*keep, place.alias("place"), "named", "address")


def apex_menu(address: Column) -> Column:
    """The menu page of the site that a location's host belongs to, else null."""
    host, scheme = address_host(address), F.regexp_extract(address, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    labels = F.split(host, r"\.")
    apex = F.regexp_replace(F.array_join(F.slice(labels, F.lit(2), F.size(labels)), "."), r"^www\.", "")
    return F.when((F.size(labels) >= 3) & F.get(labels, F.lit(0)).isin(*LOCATION_SUBDOMAINS), F.concat(scheme, F.lit("://www."), apex, F.lit("/menu")))


_SEEN = "struct<seen: array<string>, queue: array<struct<next: string, key: string>>, held: array<struct<visit: int, address: string, url: string>>>"


_LINKS = "array<struct<next: string, key: string>>"


def _folded(state: DataFrame, requests: DataFrame, expand: bool) -> DataFrame:
    """(site, taken, acc): each site's requests that were answered, in order of visit: what is held, what is seen, and which
    links come next.  A site has few requests, as they are limited before."""
    turns = requests.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("visit", "next", "key", "final", "arrived", "links"))).alias("turns"))
    nothing = F.array().cast(_LINKS)

    def turn(acc, x):
        again = (x["arrived"] != x["key"]) & F.array_contains(acc["seen"], x["arrived"])
        seen = F.array_union(acc["seen"], F.array(x["arrived"]))
        links = F.coalesce(x["links"], nothing) if expand else nothing
        new = F.filter(links, lambda e, i: ~F.array_contains(seen, e["key"]) & (F.array_position(F.transform(links, lambda y: y["key"]), e["key"]) == i + 1))
        held = F.concat(acc["held"], F.array(F.struct(x["visit"].alias("visit"), x["final"].alias("address"), x["next"].alias("url"))))
        return F.when(again, acc).otherwise(F.struct(F.array_union(seen, F.transform(new, lambda e: e["key"])).alias("seen"), F.concat(acc["queue"], new).alias("queue"), held.alias("held")).cast(_SEEN))

    start = F.struct("seen", F.array().alias("queue"), F.array().alias("held")).cast(_SEEN)
    joined = state.select("site", "seen", "taken").join(turns, "site", "left")
    return joined.select("site", "taken", F.aggregate(F.coalesce("turns", F.array().cast(turns.schema["turns"].dataType)), start, turn).alias("acc"))


def frontier(sites: DataFrame, pages: DataFrame, links: DataFrame, site: str = "site", most: int = MOST_FETCHED, follow: int = MOST_FOLLOWED) -> DataFrame:
    """(site, visit, hop, address, url) of the pages that a crawl of each site holds: the landing page, then its first
    menu links, the conventional ``/menu``, the apex menu and their twins on the canonical origin, then the menu links of
    those that were found, never more than ``most`` requests after the landing page.

    ``sites`` has site, url (the landing page) and canonical (another origin, or null); ``pages`` has url and address, what a
    request for url ends at: the same, or where it was redirected; ``links`` has page (an address), place and
    address: menu links of the same site.  No address is asked for twice (see ``visit_key``); a request that ``pages`` doesn't answer, or
    that ends at a page asked for or held before, uses up one of ``most`` and holds nothing.  A site whose landing
    page isn't there has no rows.
    """
    known = pages.groupBy(visit_key(F.col("url")).alias("asked")).agg(F.min("address").alias("final")).withColumn("arrived", visit_key(F.col("final")))
    entry = F.struct(F.col("place"), F.struct(F.col("address").alias("next"), visit_key(F.col("address")).alias("key")).alias("link"))
    out = links.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("place"))).where(F.col("n") <= follow)
    out = out.groupBy(visit_key(F.col("page")).alias("from")).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["link"]).alias("links"))
    known = known.join(out, F.col("arrived") == F.col("from"), "left").drop("from")

    landed = sites.select(F.col(site).alias("site"), F.col("url").alias("landing"), "canonical", visit_key(F.col("url")).alias("landing_key")).join(known, F.col("landing_key") == F.col("asked"))
    plain = lambda c: F.struct(c.alias("next"), visit_key(c).alias("key"))
    origin = F.regexp_extract("final", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    own = F.coalesce("links", F.array().cast(_LINKS))
    usual = F.concat(origin, F.lit("/menu"))
    path = lambda c: F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    twin = lambda c: F.concat(F.regexp_replace(F.col("canonical"), "/+$", ""), F.when(path(c) != "", path(c)).otherwise("/"))
    twins = F.when(F.col("canonical").isNotNull(), F.concat(F.transform(own, lambda e: plain(twin(e["next"]))), F.array(plain(twin(usual))))).otherwise(F.array().cast(_LINKS))
    more = F.filter(F.concat(F.array(plain(usual)), F.array(plain(apex_menu(F.col("final")))), twins), lambda e: e["next"].isNotNull())
    base = F.array_union(F.array_distinct(F.array("landing_key", "arrived")), F.transform(own, lambda e: e["key"]))
    fresh = F.filter(more, lambda e, i: ~F.array_contains(base, e["key"]) & (F.array_position(F.transform(more, lambda y: y["key"]), e["key"]) == i + 1))
    begun = landed.select("site", "landing", F.col("final").alias("home"), F.concat(own, fresh).alias("queue"), F.array_union(base, F.transform(fresh, lambda e: e["key"])).alias("seen"))

    def asked(state: DataFrame) -> DataFrame:
        """The queue's next requests, as far as the limit goes, with what they end at."""
        turns = state.select("site", "before", F.posexplode("queue").alias("k", "x")).withColumn("visit", (F.col("k") + 1 + F.col("before")).cast("int"))
        return turns.where(F.col("visit") <= most).select("site", "visit", "x.next", "x.key").join(known, F.col("key") == F.col("asked"))

    begun = begun.withColumns({"before": F.lit(0), "taken": F.least(F.size("queue"), F.lit(most))})
    first = _folded(begun, asked(begun), True)
    second = first.select("site", "taken", F.col("taken").alias("before"), F.col("acc.queue").alias("queue"), F.col("acc.seen").alias("seen"))
    last = _folded(second, asked(second), False)
    rows = lambda df, hop: df.select("site", F.explode("acc.held").alias("h")).select("site", "h.visit", F.lit(hop).alias("hop"), "h.address", "h.url")
    home = begun.select("site", F.lit(0).alias("visit"), F.lit(0).alias("hop"), F.col("home").alias("address"), F.col("landing").alias("url"))
    return home.unionByName(rows(first, 1)).unionByName(rows(last, 2))

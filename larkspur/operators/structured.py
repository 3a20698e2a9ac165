"""Menus that pages carry as data: JSON-LD blocks, item and price keys in scripts, and client state.

Small readers list a page's entries (headings and items) in order; everything after that, lines, the first of
equal lines, the least number of items, is columns.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed, stripped
from ..sources.tables import computed

# --- fixed values: keys and limits of data menus ---------------------------------------------------------
MENU_TYPES = ("Menu", "hasMenu")
LEAST_ITEMS = 8
EMBEDDED_NAMES = ("menuItemName", "itemName", "item_name", "dishName", "productName")
EMBEDDED_PRICES = ("menuItemPrice", "defaultUnitPrice", "unitPrice", "basePrice", "price_amount", "price")
EMBEDDED_TEXTS = ("menuItemDesc", "itemDesc", "description", "desc")
EMBEDDED_REACH, EMBEDDED_NAME_MOST, SCRIPT_LEAST = 700, 120, 2000
STATE_NAMES = ("displayName", "menuItemName", "itemName", "item_name", "dishName", "productName", "name")
STATE_TEXTS = ("description", "longDescription", "itemDesc", "menuItemDesc")
STATE_PRICES = ("menuItemPrice", "defaultUnitPrice", "unitPrice", "basePrice")
STATE_LABELS = ("displayName", "name")
STATE_MEMBERS = ("products", "items")
STATE_BRANCHES = ("categories", "subCategories")
STATE_DAYPARTS = ("restaurant_menu", "restaurantMenu", "menus")
STATE_NAME_MOST, STATE_LEAST = 160, 100
# ----------------------------------------------------------------------------------------------------------
#: kind: menu, section, category or item.
ENTRY = "struct<kind: string, name: string, description: string, price: string, calories: string>"
_FIELDS = ("kind", "name", "description", "price", "calories")
_EMPTY = (None, "")


def _entry(kind: str, name, description=None, price=None, calories=None) -> dict:
    text = [None if v in _EMPTY else str(v) for v in (description, price, calories)]
    return dict(zip(_FIELDS, (kind, str(name), *text), strict=True))


class _Scripts(HTMLParser):
    """(type, body) of every script element."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, list[str]]] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        if tag == "script":
            self.inside = True
            self.out.append(((dict(attrs).get("type") or "").strip(), []))

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "script"

    def handle_data(self, data):
        if self.inside:
            self.out[-1][1].append(data)


def scripts(html: str | None) -> list[tuple[str, str]]:
    parser = _Scripts()
    parser.feed(html or "")
    parser.close()
    return [(kind, "".join(body)) for kind, body in parser.out]


class _Words(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []

    def handle_data(self, data):
        self.out.append(data)


def plain(value: str) -> str:
    """A text that may hold markup, without it and with single spaces."""
    if "<" in value or "&" in value:
        parser = _Words()
        parser.feed(value)
        parser.close()
        value = " ".join(parser.out)
    return " ".join(value.split())


def _preorder(value):
    """Every object in a JSON value, outer ones first."""
    stack = [value]
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack.extend(reversed(list(node.values())))
        elif isinstance(node, list):
            stack.extend(reversed(node))


def _members(node: dict, key: str) -> list[dict]:
    """The objects under a key: one, a list, or lists in a list."""
    value = node.get(key)
    items = value if isinstance(value, list) else [value]
    flat = [x for item in items for x in (item if isinstance(item, list) else (item,))]
    return [x for x in flat if isinstance(x, dict)]


def json_ld_entries(html: str | None) -> list[dict]:
    """The menus of a page's JSON-LD blocks; a block that is no JSON has none."""
    out = []
    for kind, body in scripts(html):
        if kind != "application/ld+json" or "@type" not in body:
            continue
        try:
            data = json.loads(body)
        except ValueError:
            continue
        for menu in _preorder(data):
            if menu.get("@type") not in MENU_TYPES:
                continue
            out += [_entry("menu", menu["name"])] if menu.get("name") else []
            for section in _members(menu, "hasMenuSection"):
                out += [_entry("section", section["name"])] if section.get("name") else []
                for item in _members(section, "hasMenuItem"):
                    offer = next(iter(_members(item, "offers")), {})
                    if isinstance(item.get("name"), str) and item["name"].strip():
                        out.append(_entry("item", item["name"], item.get("description") or None, offer.get("price")))
    return out


def _key(names: tuple[str, ...]) -> str:
    """One of the names as a quoted key, whose quotes may be escaped, up to its value."""
    return r'\\{0,2}"(?:' + "|".join(names) + r')\\{0,2}"\s*:\s*'


_NAME, _TEXT, _PRICE = (re.compile(p) for p in (_key(EMBEDDED_NAMES) + r'\\{0,2}"', _key(EMBEDDED_TEXTS) + r'\\{0,2}"', _key(EMBEDDED_PRICES) + r'\\{0,2}"?(\d{1,4}(?:\.\d{1,2})?)'))


def _quoted(body: str, start: int, end: int | None = None) -> tuple[str, int] | None:
    """(the string that starts here, where its closing quote ends); None if it is empty or open."""
    close = body.find('"', start + 1 + (body[start : start + 1] == "\\"), len(body) if end is None else end)
    if close < 0 or body[start : start + 1] == '"':
        return None
    value = body[start:close]
    bare = value.rstrip("\\")
    value = bare if len(value) - len(bare) <= 2 else value[:-2]
    try:
        return json.loads(f'"{value}"', strict=False), close + 1
    except ValueError:
        return value.replace('\\"', '"').replace("\\\\", "\\"), close + 1


def script_items(body: str) -> list[tuple[str, str | None, str]]:
    """(name, description, price) of a script: each name key with the first price key that follows within reach.
    What lies between the two is theirs: another name in it is passed over."""
    prices = [(m.start(), m.end(), m.group(1)) for m in _PRICE.finditer(body)]
    starts, out, free = [p[0] for p in prices], [], 0
    for m in _NAME.finditer(body):
        name = _quoted(body, m.end()) if m.start() >= free else None
        if name is None:
            continue
        k = bisect_left(starts, name[1])
        if k == len(prices) or starts[k] - name[1] > EMBEDDED_REACH:
            continue
        start, free, price = prices[k]
        told = _TEXT.search(body, name[1], start)
        text = _quoted(body, told.end(), start) if told else None
        if 0 < len(name[0].strip()) <= EMBEDDED_NAME_MOST:
            out.append((name[0].strip(), text[0] if text else None, price))
    return out


def embedded_entries(html: str | None) -> list[dict]:
    """The items of a page's long scripts that name prices."""
    return [_entry("item", *item) for _, body in scripts(html) if len(body) >= SCRIPT_LEAST and "rice" in body for item in script_items(body)]


def _first_text(node: dict, keys: tuple[str, ...]) -> str:
    return next((plain(v) for k in keys if isinstance(v := node.get(k), str) and v.strip()), "")


def _cost(node: dict):
    """What a product costs, by the first of the ways that sites have to say so."""
    either = lambda value, *keys: next((value[k] for k in keys if value.get(k)), value.get(keys[-1]))
    if node.get("formattedPrice") not in _EMPTY:
        return node["formattedPrice"]
    if isinstance(node.get("price"), dict):
        return either(node["price"], "formattedPrice", "value")
    costs = [node.get("price"), either(node["cost"], "formattedPrice", "price", "value") if isinstance(node.get("cost"), dict) else None]
    return next((v for v in (*costs, *(node.get(k) for k in STATE_PRICES)) if v not in _EMPTY), None)


def _calories(node: dict):
    facts = node.get("nutrition") if isinstance(node.get("nutrition"), dict) else {}
    value = next((v for v in (facts.get("cal") or facts.get("fdamessage"), node.get("calories")) if v not in _EMPTY), None)
    return None if value is None else " ".join(str(value).split())


def _state_members(value):
    """(path of labels, object) of what may be a product, in order.  A node with members or branches has a label,
    which its members and branches go under; the keys of a map of dayparts are labels; other nodes only wrap."""
    stack = [(value, ())]
    while stack:
        node, path = stack.pop()
        if isinstance(node, list):
            stack.extend((x, path) for x in reversed(node))
        if not isinstance(node, dict):
            continue
        members = next((node[k] for k in STATE_MEMBERS if isinstance(node.get(k), list)), None)
        holds = members is not None or any(isinstance(node.get(k), list) for k in STATE_BRANCHES)
        label = _first_text(node, STATE_LABELS) if holds else ""
        own = (*path, label) if label else path
        yield from ((own, x) for x in members or () if isinstance(x, dict))
        below = []
        for key, child in node.items():
            if key in STATE_DAYPARTS and isinstance(child, dict):
                below += [(x, (*path, str(part))) for part, x in child.items()]
            elif key not in STATE_MEMBERS:
                below.append((child, own if key in STATE_BRANCHES else path))
        stack.extend(reversed(below))


def state_products(values) -> list[tuple]:
    """(category, name, description, price, calories) of the products in JSON texts, the first of each id (or of each
    name and price): objects with a name, and with a text, a price, calories or a product's id."""
    out, seen = [], set()
    for value in values:
        try:
            state = json.loads(value)
        except (TypeError, ValueError):
            continue
        for path, node in _state_members(state):
            name, text, price, calories, own = _first_text(node, STATE_NAMES), _first_text(node, STATE_TEXTS), _cost(node), _calories(node), str(node.get("id") or "")
            if not name or len(name) > STATE_NAME_MOST or not (text or price not in _EMPTY or calories or own.lower().startswith("prod")):
                continue
            key = own or f"{name.casefold()}|{str(price).casefold()}"
            if key not in seen:
                seen.add(key)
                out.append((" > ".join(path), name, text, price, calories))
    return out


def state_entries(values) -> list[dict]:
    """The products of the longer ones of some JSON texts, each change of category as a heading."""
    out, at = [], ""
    for category, *item in state_products([v for v in values if isinstance(v, str) and len(v) >= STATE_LEAST] if values is not None else ()):
        if category and category != at:
            out.append(_entry("category", category))
            at = category
        out.append(_entry("item", *item))
    return out


def _read(reader):
    """Pages are long and entries many, so rows go to Python by the hundred, not by the ten thousand."""
    return F.udf(reader, f"array<{ENTRY}>", useArrow=False)


def menu_line(name: Column, description: Column, price: Column) -> Column:
    """``Name — description ($price)``; descriptions of fewer than three characters are left out."""
    told = F.btrim(squeezed(description), F.lit(" \"',\\"))
    cost = stripped(price)
    return F.concat(
        stripped(name), F.when(F.length(told) >= 3, F.concat(F.lit(" — "), told)).otherwise(""), F.when(price != "", F.concat(F.lit(" ("), F.when(cost.contains("$"), "").otherwise("$"), cost, F.lit(")"))).otherwise("")
    )


def _line(e: Column) -> Column:
    item = F.concat(menu_line(e["name"], e["description"], e["price"]), F.coalesce(F.concat(F.lit(" ["), e["calories"], F.lit("]")), F.lit("")))
    return F.when(e["kind"] == "item", item).when(e["kind"] == "section", F.concat(e["name"], F.lit(":"))).otherwise(F.concat(F.lit("== "), e["name"], F.lit(" ==")))


def _distinct_lines(rows: DataFrame, entries: str) -> DataFrame:
    """``lines`` of ``entries`` without items that repeat an earlier item's line, and ``n`` items.  Headings are told
    apart by their places, so that one look-up of strings finds all first lines."""
    marked = F.transform(entries, lambda e, i: F.concat(F.when(e["kind"] == "item", "i").otherwise(F.concat(F.lit("h"), i.cast("string"))), F.lit(":"), _line(e)))
    rows = computed(rows, marked=F.array_distinct(marked))
    return rows.withColumns({"lines": F.transform("marked", lambda m: F.regexp_replace(m, r"^(i|h\d+):", "")), "n": F.size(F.filter("marked", lambda m: m.startswith("i")))})


def structured_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = (), least: int = LEAST_ITEMS) -> DataFrame:
    """(keep..., origin, items, text) of the pages that carry a menu of ``least`` items or more as data: that of
    their JSON-LD (``json_ld``), else that of their scripts (``embedded``).  Null pages have none."""
    held = computed(pages.select(*keep, F.col(html).alias("page")), page=F.col("page"))
    marked = held.where(F.col("page").contains("<script"))
    ld = _distinct_lines(marked.withColumn("entries", _read(json_ld_entries)(F.when(F.col("page").contains("@type"), F.col("page")))), "entries")
    found = lambda origin: F.when(F.col("n") >= least, F.struct(F.lit(origin).alias("origin"), F.col("n").alias("items"), F.array_join("lines", "\n").alias("text")))
    ld = computed(ld, found=found("json_ld")).select(*keep, "page", "found")
    rest = F.when(F.col("found").isNull() & F.col("page").contains("rice"), F.col("page"))
    both = _distinct_lines(ld.withColumn("entries", _read(embedded_entries)(rest)), "entries")
    return computed(both, found=F.coalesce("found", found("embedded"))).where("found IS NOT NULL").select(*keep, "found.*")


def state_text(rows: DataFrame, values: str, keep: tuple[str, ...] = (), least: int = LEAST_ITEMS) -> DataFrame:
    """(keep..., products, categories, text) of the rows whose array of JSON texts holds ``least`` products or more."""
    read = rows.select(*keep, _read(state_entries)(F.col(values)).alias("entries"))
    of = lambda kind: F.filter("entries", lambda e: e["kind"] == kind)
    counted = read.select(*keep, "entries", F.size(of("item")).alias("products"), F.size(F.array_distinct(F.transform(of("category"), lambda e: e["name"]))).alias("categories")).where(F.col("products") >= least)
    head = F.format_string("[structured-menu products=%d categories=%d]", "products", "categories")
    return counted.select(*keep, "products", "categories", F.array_join(F.concat(F.array(head), F.transform("entries", _line)), "\n").alias("text"))

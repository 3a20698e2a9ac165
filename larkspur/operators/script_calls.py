"""Menu items that a page passes to a script function, one call for each."""

from __future__ import annotations

import html as html_lib
import re
from functools import cache, lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import computed

#: The function that ordering pages call for an item, and where its arguments have name, price and description.
CALL = "renderMerchandise"
NAME_AT, PRICE_AT, TEXT_AT = 2, 3, 4
#: Items that a task holds before it sends them on.
ITEMS = 10_000
#: Characters of an argument that a worker remembers, since short ones recur.
SHORT = 64
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_NAMED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}
_CLOSES, _QUOTES = {"(": ")", "[": "]", "{": "}"}, "'\"`"
#: Where something turns, outside quotes and inside each kind of them; an escaped character turns nothing.
_TURNS = {"": re.compile(r"[][(){},'\"`]")} | {q: re.compile(rf"\\[\s\S]|{q}") for q in _QUOTES}
_HALF = re.compile("[\ud800-\udfff]")
#: Brackets in brackets that the pattern of a whole call knows; calls with deeper ones are read step by step.
DEPTH = 2


@cache
def call_pattern(function: str) -> re.Pattern:
    """The opening of a call and, where the call closes and nests no deeper than ``DEPTH``, the rest of it with the arguments
    that an item has, an empty group ``end`` where it closes, and ``ends`` if a semicolon follows.  No part of it can match
    in two ways, so that it says what ``call_arguments`` says."""
    opens, quoted, inner = re.escape("".join(_CLOSES)), "|".join(rf"{q}[^{q}\\]*+(?:\\[\s\S][^{q}\\]*+)*+{q}" for q in _QUOTES), ""

    def until(stops: str) -> str:
        plain = rf"[^{opens}{_QUOTES}{stops}]*+"
        return rf"{plain}(?:(?:{quoted}{inner}){plain})*+"

    for _ in range(DEPTH):
        inner = "|" + "|".join(re.escape(a) + until(re.escape(z)) + re.escape(z) for a, z in _CLOSES.items())
    argument = until(",)")
    rest = rf"(?:,{argument})*+"
    for i in range(TEXT_AT, -1, -1):
        kept = {NAME_AT: "name", PRICE_AT: "price", TEXT_AT: "text"}.get(i)
        own = f"(?P<{kept}>{argument})" if kept else argument
        rest = f"(?:,{own}{rest})?" if i else own + rest
    opening = rf"{re.escape(function)}\("  # the name first: it is searched for as it is
    return re.compile(rf"{opening}(?<![\w$]{opening})(?:{rest}\)(?P<end>)(?:\s{{0,199}}+(?P<ends>;))?)?")


def call_arguments(script: str, start: int) -> tuple[list[str], int] | None:
    """(arguments, where the call ends) of the call whose opening bracket is before ``start``; None if it never
    closes.  Commas and brackets in quotes or in inner brackets part nothing."""
    args, begin, inside, quote, at = [], start, [], "", start
    while m := _TURNS[quote].search(script, at):
        c, at = m[0], m.end()
        if quote or c in _QUOTES:
            quote = "" if c == quote else quote if quote else c
        elif c in _CLOSES:
            inside.append(_CLOSES[c])
        elif inside and c == inside[-1]:
            inside.pop()
        elif not inside and c in ",)":
            args.append(script[begin : m.start()].strip())
            begin = at
            if c == ")":
                return args, at
    return None


def script_text(argument: str) -> str:
    """What a quoted argument says, or a bare one as it is, with HTML references decoded."""
    if len(argument) >= 2 and argument[0] in "'\"`" and argument[-1] == argument[0]:
        argument = argument[1:-1]
        if "\\" in argument:
            argument = _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _NAMED.get(m[3], m[3]), argument)
        if _HALF.search(argument):
            argument = argument.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # pairs of escapes are one character
    return html_lib.unescape(argument).strip()


def said(argument: str) -> tuple[str, str]:
    """What an argument says, and the form in which items are compared."""
    text = script_text(argument.strip())
    return text, " ".join(text.split()).casefold()


@lru_cache(maxsize=50_000)
def _said_in_short(argument: str) -> tuple[str, str]:
    return said(argument)


@lru_cache(maxsize=10_000)
def _short_price(argument: str) -> str:
    return script_price(argument)


def script_price(argument: str) -> str:
    """A positive amount as ``$0.00``, else empty."""
    try:
        amount = float(argument.strip().strip("'\"` "))
    except ValueError:
        return ""
    return f"${amount:.2f}" if 0 < amount < float("inf") else ""


def calls(page: str, function: str = CALL):
    """(name, price, text) as written, of the calls in a page that end with a semicolon and have so many arguments.  A call
    that never closes is passed over."""
    pattern, at = call_pattern(function), 0
    while at is not None:
        start, at = at, None
        for m in pattern.finditer(page, start):
            name, price, text, end, ends = m.groups()
            if end is not None:
                if ends and text is not None:
                    yield name, price, text
            elif call := call_arguments(page, m.end()):
                args, at = call
                if len(args) > TEXT_AT and re.match(r"\s*;", page[at : at + 200]):
                    yield args[NAME_AT], args[PRICE_AT], args[TEXT_AT]
                break


def call_items(page: str | None, function: str = CALL) -> list[tuple[str, str, str]]:
    """(name, description, price) of the ``calls`` in a page, the first of each; calls without a name or without a price
    have none."""
    out = {}
    for name, price, text in dict.fromkeys(calls(page or "", function)):
        price = _short_price(price) if len(price) <= SHORT else script_price(price)
        if price:
            name, name_key = _said_in_short(name) if len(name) <= SHORT else said(name)
            text, text_key = _said_in_short(text) if len(text) <= SHORT else said(text)
            if name:
                out.setdefault((name_key, text_key, price), (name, text, price))
    return list(out.values())


def script_call_items(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., place, name, description, price) of the items that pages pass to ``renderMerchandise``.  Pages go to
    Python once, in Arrow batches, and items come back as columns, so that no item's row carries its page."""
    import pyarrow as pa

    rows = computed(pages.select(*keep, F.col(html).alias("page_")), page_=F.col("page_")).where(F.col("page_").contains(CALL))
    names = [*keep, "place", "name", "description", "price"]

    def read(batches):
        for batch in batches:
            at, places, items = [], [], []
            for row, page in enumerate(batch.column(len(keep))):
                found = call_items(page.as_py())
                at += [row] * len(found)
                places += range(len(found))
                items += found
                if len(items) >= ITEMS or row == len(batch) - 1:
                    own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
                    columns = [pa.array([item[i] for item in items], pa.string()) for i in range(3)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(places, pa.int32()), *columns], names)
                    at, places, items = [], [], []

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(read, f"{kinds}{', ' if keep else ''}place int, name string, description string, price string")

"""Canonical JSON as a column: sorted keys, no spaces, ASCII alone; and fingerprints of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short escapes of JSON; other control characters have a number.
SHORT_ESCAPES = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}


def _unit(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))


def _escaped(char: Column) -> Column:
    n = F.ascii(char)  # the code point of a character of any plane
    pair = F.concat(_unit(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), _unit(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(F.lit(0x3FF))))
    out = F.when(n.between(32, 126), char).when(n < 0x10000, _unit(n)).otherwise(pair)
    for code, short in SHORT_ESCAPES.items():
        out = F.when(n == code, F.lit(short)).otherwise(out)
    return out


def json_text(c: Column) -> Column:
    """A text as a JSON string in ASCII; null: ``null``.  Texts without anything to escape are only quoted."""
    odd = c.rlike(r'[^\x20-\x7E]|["\\]')
    runs = F.regexp_extract_all(c, F.lit(r'(?s)([\x20-\x7E&&[^"\\]]+|.)'), F.lit(1))  # plain runs whole, all else by character
    slow = F.array_join(F.transform(runs, lambda r: F.when(F.length(r) > 1, r).otherwise(_escaped(r))), "")
    return F.coalesce(F.concat(F.lit('"'), F.when(odd, slow).otherwise(c), F.lit('"')), F.lit("null"))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """A column of texts, whole numbers, booleans, and arrays, structs and maps of these, as JSON with sorted keys.
    Nulls are ``null``, also in structs.  Numbers with fractions have no one spelling and are refused."""
    if isinstance(kind, T.StringType):
        return json_text(c)
    if isinstance(kind, T.IntegralType | T.BooleanType):
        return F.coalesce(c.cast("string"), F.lit("null"))
    if isinstance(kind, T.ArrayType):
        inner = F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ",")
        return F.coalesce(F.concat(F.lit("["), inner, F.lit("]")), F.lit("null"))
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(":"), canonical_json(c[f.name], f.dataType)) for f in fields]
        return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        inner = F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))), ",")
        return F.coalesce(F.concat(F.lit("{"), inner, F.lit("}")), F.lit("null"))
    raise TypeError(f"no canonical JSON for {kind.simpleString()}")


_SOURCES = T.ArrayType(T.ArrayType(T.StringType()))


def menu_fingerprint(website_url: Column, sources: Column, flags: Column) -> Column:
    """hex SHA-256 of a menu finding: its website, the url and content of each source in order, and its flags in
    the order of their bytes.  ``sources``: an array of [url, content]."""
    ordered = F.array_sort(flags)
    parts = [F.lit('{"flags":'), canonical_json(ordered, T.ArrayType(T.StringType())), F.lit(',"sources":'), canonical_json(sources, _SOURCES), F.lit(',"website_url":'), json_text(website_url), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)

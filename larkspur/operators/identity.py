"""Entity resolution: identity keys, greedy compatible groups, survivors and re-pointed references."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import price_key


def canonical(text: str | None) -> str:
    """Letters and digits of the compatibility form, case folded."""
    if not text:
        return ""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def canonical_text(c: Column) -> Column:
    """``canonical`` as a column: an ASCII fast path in the JVM, and Arrow batches for the rest."""
    @F.pandas_udf(T.StringType())
    def folded(s: pd.Series) -> pd.Series:
        return s.map(canonical)

    plain = F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "").when(~c.rlike(r"[^\x00-\x7F]"), plain).otherwise(folded(c))


def identity_columns(rows: DataFrame) -> DataFrame:
    """``k_name, k_price, k_desc, k_cal`` of name, price, raw_description and calories."""
    return rows.withColumns({"k_name": canonical_text(F.col("name")), "k_price": price_key(F.col("price")), "k_desc": canonical_text(F.col("raw_description")), "k_cal": canonical_text(F.col("calories"))})


_CASED = r"\p{IsUppercase}\p{IsLowercase}\p{Lt}"


def display_quality(name: Column) -> Column:
    """struct; the greater, the easier a spelling is to read: not all in capitals, in title case, no symbol after a
    space, short."""
    letters = F.regexp_replace(name, r"\P{L}", "")
    capitals = (letters == F.upper(letters)) & (letters != F.lower(letters))
    title = name.rlike("[A-Za-z]") & ~name.rlike(rf"(?<=[{_CASED}])[\p{{IsUppercase}}\p{{Lt}}]|(?<![{_CASED}])\p{{IsLowercase}}")
    awkward = name.rlike(r"\s+[Ⓥⓥ]$")
    return F.struct((~capitals).alias("plain"), title.alias("title"), (~awkward).alias("neat"), (-F.length(name)).alias("short"))


def preferred_name(first: Column, second: Column) -> Column:
    """The second spelling if it is easier to read."""
    return F.when(display_quality(second) > display_quality(first), second).otherwise(first)


def compatible(a: tuple, b: tuple) -> bool:
    """Equal name and price; a missing description or calorie text agrees with any."""
    return a[:2] == b[:2] and all(not x or not y or x == y for x, y in zip(a[2:], b[2:], strict=True))


class _Known:
    """(description, calories) keys in the order in which they became known, and the first one that a key agrees with.
    A missing part agrees with any, so the first key is kept of each part alone and of all."""

    def __init__(self):
        self.first: dict[tuple, int] = {}
        self.keys: list = []

    def add(self, d: str, c: str, value) -> None:
        for pattern in ((d, c), (d, None), (None, c), (None, None)):
            self.first.setdefault(pattern, len(self.keys))
        self.keys.append(value)

    def exact(self, d: str, c: str):
        at = self.first.get((d, c))
        return None if at is None else self.keys[at]

    def agreeing(self, d: str, c: str):
        found = [self.first[p] for p in {(x, y) for x in ((d, "") if d else (None,)) for y in ((c, "") if c else (None,))} if p in self.first]
        return self.keys[min(found)] if found else None


_KEYS = ("k_name", "k_price", "k_desc", "k_cal")


def _same(a: DataFrame, b: DataFrame, columns) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & a[c].eqNullSafe(b[c])
    return on


def compatible_groups(rows: DataFrame, owner: str = "restaurant_id", id_col: str = "id", latest: str = "latest_cls") -> DataFrame:
    """(owner, id, survivor): rows of an owner with equal name and price keys join the first group, in id
    order, whose first row they are compatible with (compatibility is not transitive).  The survivor is
    the row with the largest (latest classification, description length, -id).  Rows of one key go where the first of them
    goes, so only distinct keys of an owner, name and price are looked through; copies are counted before."""
    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds, out = _Known(), []
        for d, c, first in pdf.sort_values("first")[["k_desc", "k_cal", "first"]].itertuples(index=False):
            seed = seeds.agreeing(d, c)
            if seed is None:
                seeds.add(d, c, first)
            out.append((d, c, first if seed is None else seed))
        return pd.DataFrame({owner: [pdf[owner].iloc[0]] * len(out), "k_name": pdf["k_name"].iloc[0], "k_price": pdf["k_price"].iloc[0], "k_desc": [x[0] for x in out], "k_cal": [x[1] for x in out], "seed": [x[2] for x in out]})

    keyed = identity_columns(rows).select(owner, id_col, F.coalesce(F.length("raw_description"), F.lit(0)).alias("size"), F.coalesce(latest, F.lit(-1)).alias("last"), *_KEYS)
    kind = keyed.schema[owner].dataType.simpleString()
    distinct = keyed.groupBy(owner, *_KEYS).agg(F.min(id_col).alias("first"))
    seeds = distinct.groupBy(owner, "k_name", "k_price").applyInPandas(group, f"{owner} {kind}, k_name string, k_price string, k_desc string, k_cal string, seed long")
    placed = keyed.join(seeds, _same(keyed, seeds, (owner, *_KEYS))).select(keyed[owner], id_col, "size", "last", "seed")
    best = placed.groupBy("seed").agg(F.max_by(id_col, F.struct("last", "size", -F.col(id_col))).alias("survivor"))
    return placed.join(best, "seed").select(owner, F.col(id_col).cast("long").alias(id_col), F.col("survivor").cast("long").alias("survivor"))


def exact_groups(rows: DataFrame, owner: str = "restaurant_id", id_col: str = "id") -> DataFrame:
    """(owner, id, survivor, survivor_name): rows of an owner with equal identity keys are one dish.  The first one with the
    spelling that is easiest to read survives; an aggregate finds it, so copies never meet."""
    keyed = identity_columns(rows)
    keys = [owner, "k_name", "k_price", "k_desc", "k_cal"]
    best = F.struct(display_quality(F.coalesce("name", F.lit(""))).alias("q"), (-F.col(id_col)).alias("early"))
    first = keyed.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.max_by(F.struct(F.col(id_col).alias("survivor"), F.col("name").alias("survivor_name")), best).alias("s"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_"))
    return keyed.join(first, on).select(owner, id_col, "s.survivor", "s.survivor_name")


def repoint(rows: DataFrame, fk: str, mapping: DataFrame, id_col: str = "id") -> DataFrame:
    """``rows`` with references to merged rows set to the survivor."""
    m = mapping.select(F.col(id_col).alias("__old"), F.col("survivor").alias("__new"))
    return rows.join(m, F.col(fk) == F.col("__old"), "left").withColumn(fk, F.coalesce("__new", fk)).drop("__old", "__new")


def upsert_dishes(base: DataFrame, delta: DataFrame, owner: str = "restaurant_id") -> DataFrame:
    """(delta id, action, target id) for each captured dish, in id order: an exact identity of the base,
    else the first compatible one, else an insert.  What was inserted counts for the dishes after it.  As above, only distinct
    keys are looked through; the first dish of a new key is inserted, and others of that key are exact to it."""
    def match(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        known, out = _Known(), []
        for d, c, first in old.sort_values("first")[["k_desc", "k_cal", "first"]].itertuples(index=False):
            known.add(d, c, first)
        for d, c, first in new.sort_values("first")[["k_desc", "k_cal", "first"]].itertuples(index=False):
            exact, close = known.exact(d, c), known.agreeing(d, c)
            if close is None:
                known.add(d, c, first)
            out.append((d, c, "exact" if exact is not None else "compatible" if close is not None else "insert", exact if exact is not None else close if close is not None else first))
        one = new.iloc[0] if len(new) else None
        return pd.DataFrame([(one[owner], one["k_name"], one["k_price"], *x) for x in out], columns=[owner, "k_name", "k_price", "k_desc", "k_cal", "action", "target"])

    keyed = [identity_columns(x).select(owner, "id", *_KEYS) for x in (base, delta)]
    kind = keyed[1].schema[owner].dataType.simpleString()
    sides = [x.groupBy(owner, *_KEYS).agg(F.min("id").alias("first")).groupBy(owner, "k_name", "k_price") for x in keyed]
    told = sides[0].cogroup(sides[1]).applyInPandas(match, f"{owner} {kind}, k_name string, k_price string, k_desc string, k_cal string, action string, target long")
    rows = keyed[1].join(told, _same(keyed[1], told, (owner, *_KEYS)))
    new = (F.col("action") == "insert") & (F.col("id") != F.col("target"))
    return rows.select(F.col("id").cast("long").alias("id"), F.when(new, "exact").otherwise(F.col("action")).alias("action"), "target")

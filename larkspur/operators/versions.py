"""Versioned facts: latest rows, merges, snapshots, change logs and votes.

Merges are pure functions from (base, delta) to the next state: plain Parquet has no row-level writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by ``order`` (a unique tail makes it one row).  A partially
    aggregated max_by over the whole row: no sort, and a hot key costs one row a task."""
    whole = F.struct(*rows.columns)
    held = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max_by(whole, F.struct(*order)).alias("__row"))
    return held.select("__row.*")


def latest_by_id(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """The row with the largest id of each key; not the same as the latest by time."""
    return latest(rows, keys, [id_col])


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first arrival of each key."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min_by(whole, F.struct(*order)).alias("__row")).select("__row.*")


def merge(base: DataFrame, delta: DataFrame, keys: list[str], keep_old_if_null: tuple[str, ...] = ()) -> DataFrame:
    """Upsert: a row of ``delta`` replaces that of its key; columns in ``keep_old_if_null`` take the old
    value where the new one is null; rows of either side alone stay.  Columns are those of ``base``."""
    b, d = base.alias("b"), delta.withColumn("__new", F.lit(True)).alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    joined = b.join(d, on, "full_outer")
    new = F.coalesce(F.col("d.__new"), F.lit(False))

    def value(c: str) -> Column:
        if c not in delta.columns:
            return F.col(f"b.{c}").alias(c)
        if c in keep_old_if_null:
            return F.coalesce(f"d.{c}", f"b.{c}").alias(c)
        return F.when(new, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    return joined.select(*map(value, base.columns))


def insert_ignore(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``delta`` whose key is new, the first of each key."""
    return first_per_key(delta, keys, order).join(base.select(*keys).distinct(), keys, "left_anti")


def replace_snapshot(pages: DataFrame, kept: DataFrame, owner: str, url: str, protected_url: str) -> tuple[DataFrame, DataFrame]:
    """(next pages, removed ids): pages of the owners in ``kept`` that ``kept`` lacks go, but for the
    protected url; pages without a url stay.  References to removed ids are to be set null."""
    owners = kept.select(owner).distinct()
    stale = pages.join(owners, owner, "left_semi").where(F.col(url).isNotNull() & (F.col(url) != protected_url)).join(kept.select(owner, url), [owner, url], "left_anti").select("id")
    return pages.join(stale, "id", "left_anti"), stale


def null_dangling(rows: DataFrame, fk: str, removed: DataFrame) -> DataFrame:
    """``rows`` with foreign keys to removed ids set to null."""
    gone = removed.select(F.col("id").alias("__gone")).distinct()
    joined = rows.join(gone, F.col(fk) == F.col("__gone"), "left")
    return joined.withColumn(fk, F.when(F.col("__gone").isNull(), F.col(fk))).drop("__gone")


def cascade_delete(tables: dict[str, DataFrame], keys: dict[str, str], doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: rows left}, counts of removed rows): each table loses the rows whose key column is in
    ``doomed`` (id)."""
    left, counts = {}, None
    for name, rows in tables.items():
        ids = doomed.select(F.col("id").alias(keys[name]))
        left[name] = rows.join(ids, keys[name], "left_anti")
        n = rows.join(ids, keys[name], "left_semi").agg(F.count("*").alias("removed")).withColumn("table", F.lit(name))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def live_votes(events: DataFrame, keys: list[str], order: list[str], vote: str = "vote", client: str = "client_id") -> DataFrame:
    """One live vote for each (target, client): the last action wins, and a null vote withdraws.  Events
    without a client all count."""
    known = latest(events.where(F.col(client).isNotNull()), [*keys, client], order)
    return known.unionByName(events.where(F.col(client).isNull())).where(F.col(vote).isNotNull())


def active_corrections(rows: DataFrame, name: str = "dish_name", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """``active`` is true for the last correction of each name, case-blind."""
    w = Window.partitionBy(F.lower(name)).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("active", F.row_number().over(w) == 1)


def consecutive_failures(events: DataFrame, key: str, order: list[str], failed: Column, succeeded: Column) -> DataFrame:
    """(key, failures): failures after the last success; keys without one count all."""
    at = F.struct(*order)
    last = events.groupBy(key).agg(F.max(F.when(succeeded, at)).alias("__last"))
    joined = events.join(last, key)
    return joined.groupBy(key).agg(F.count_if(failed & (F.col("__last").isNull() | (at > F.col("__last")))).alias("failures"))


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Changes between two snapshots of (keys, price, verdict): added, removed, else price_changed before
    verdict_changed; unchanged rows have none."""
    b, a = before.alias("b"), after.alias("a")
    joined = b.join(a, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in keys], "full_outer")
    had, has = F.col(f"b.{keys[0]}").isNotNull(), F.col(f"a.{keys[0]}").isNotNull()
    differ = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    kind = F.when(~had, "added").when(~has, "removed").when(differ("price"), "price_changed").when(differ("verdict"), "verdict_changed")
    return joined.select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], kind.alias("change_type"), F.col("b.price").alias("old_price"), F.col("a.price").alias("new_price"), F.col("b.verdict").alias("old_verdict"), F.col("a.verdict").alias("new_verdict")).where("change_type IS NOT NULL")


def classify_mode(prior_hash: Column, new_hash: Column, prior_dishes: Column, least: int = 5) -> Column:
    """skip an unchanged menu, take a delta against enough known dishes, else go in full."""
    return F.when(prior_hash.eqNullSafe(new_hash) & new_hash.isNotNull(), "skip").when(prior_hash.isNotNull() & (prior_dishes >= least), "delta").otherwise("full")


def trusted_removals(removed: Column, prior: Column) -> Column:
    """A delta that removes more than max(3, 60 %) of the known dishes is not believed."""
    return removed <= F.greatest(F.lit(3.0), prior * 0.6)

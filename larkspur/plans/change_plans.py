"""Change capture, merges, votes, feeds and community data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rollups import feed, priority_union, unread
from ..operators.versions import active_corrections, cascade_delete, classify_mode, consecutive_failures, insert_ignore, live_votes, merge, null_dangling, snapshot_diff
from ..sources.tables import manifest, table
from .registry import query

Spark, Frame = SparkSession, DataFrame


@query("""WITH y AS (SELECT l_partkey, year(l_shipdate) AS y, max(CAST(l_extendedprice AS DECIMAL(18,2))) AS price, max(l_returnflag) AS verdict FROM lineitem GROUP BY ALL),
b AS (SELECT * FROM y WHERE y = 1997), a AS (SELECT * FROM y WHERE y = 1998)
SELECT coalesce(b.l_partkey, a.l_partkey) AS l_partkey, CASE WHEN b.l_partkey IS NULL THEN 'added' WHEN a.l_partkey IS NULL THEN 'removed' WHEN a.price <> b.price THEN 'price_changed' ELSE 'verdict_changed' END AS change_type,
  b.price AS old_price, a.price AS new_price, b.verdict AS old_verdict, a.verdict AS new_verdict FROM b FULL JOIN a ON a.l_partkey = b.l_partkey
WHERE a.l_partkey IS NULL OR b.l_partkey IS NULL OR a.price <> b.price OR a.verdict <> b.verdict""")
def q_full_diff(spark: Spark, sf: str) -> Frame:
    """Changes between two snapshots."""
    lines = table(spark, sf, "lineitem").withColumn("y", F.year("l_shipdate")).where("y IN (1997, 1998)")
    per = lambda y: lines.where(F.col("y") == y).groupBy("l_partkey").agg(F.max(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"), F.max("l_returnflag").alias("verdict"))
    return snapshot_diff(per(1997), per(1998), ["l_partkey"])


@query("SELECT sha256(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1 HAVING min(doc_id) >= 100")
def q_versions(spark: Spark, sf: str) -> Frame:
    """Contents that are new against the known ones, the first of each."""
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return insert_ignore(docs.where("doc_id < 100"), docs.where("doc_id >= 100"), ["digest"], ["doc_id"]).select("digest", "doc_id")


@query("""WITH b AS (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0), d AS (SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_acctbal + 1 END AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 1)
SELECT coalesce(b.s_suppkey, d.s_suppkey) AS s_suppkey, coalesce(d.s_name, b.s_name) AS s_name, coalesce(d.s_acctbal, b.s_acctbal) AS s_acctbal FROM b FULL JOIN d ON b.s_suppkey = d.s_suppkey""")
def q_merge(spark: Spark, sf: str) -> Frame:
    """Upsert in which a null keeps the old value."""
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    delta = rows.where("s_suppkey % 4 <> 1").select("s_suppkey", F.upper("s_name").alias("s_name"), F.when(F.col("s_suppkey") % 2 != 0, F.col("s_acctbal") + 1).alias("s_acctbal"))
    return merge(rows.where("s_suppkey % 3 <> 0"), delta, ["s_suppkey"], keep_old_if_null=("s_acctbal",))


@query("SELECT event_id, lower(event_type) AS name, row_number() OVER (PARTITION BY lower(event_type), user_id ORDER BY ts DESC, event_id DESC) = 1 AS active FROM events")
def q_scd2(spark: Spark, sf: str) -> Frame:
    """The last correction of a name is the active one, case-blind."""
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"), F.col("event_id").alias("id"), F.concat_ws("#", F.upper("event_type"), F.col("user_id").cast("string")).alias("dish_name"))
    return active_corrections(rows).select("event_id", F.lower(F.substring_index("dish_name", "#", 1)).alias("name"), "active")


@query("""WITH v AS (SELECT event_id, ts, user_id % 50 AS target, CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id END AS client, CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'up' WHEN 'error' THEN 'down' ELSE NULL END AS vote FROM events),
l AS (SELECT * FROM v WHERE client IS NOT NULL QUALIFY row_number() OVER (PARTITION BY target, client ORDER BY ts DESC, event_id DESC) = 1 UNION ALL SELECT * FROM v WHERE client IS NULL)
SELECT target, count(*) FILTER (vote = 'up') AS up, count(*) FILTER (vote = 'down') AS down FROM l WHERE vote IS NOT NULL GROUP BY target""")
def q_votes(spark: Spark, sf: str) -> Frame:
    """One live vote for each target and client; the last action wins."""
    u, kind = F.col("user_id"), F.col("event_type")
    votes = table(spark, sf, "events").select("event_id", "ts", (u % 50).alias("target"), F.when(u % 7 != 0, u).alias("client_id"), F.when(kind.isin("click", "view"), "up").when(kind == "error", "down").alias("vote"))
    return live_votes(votes, ["target"], ["ts", "event_id"]).groupBy("target").agg(F.count_if(F.col("vote") == "up").alias("up"), F.count_if(F.col("vote") == "down").alias("down"))


@query("""WITH l AS (SELECT user_id, max((ts, event_id)) FILTER (event_type = 'purchase') AS last FROM events GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (event_type = 'error' AND (last IS NULL OR (ts, event_id) > last)) AS failures FROM events e JOIN l USING (user_id) GROUP BY e.user_id""")
def q_failures(spark: Spark, sf: str) -> Frame:
    """Failures since the last success."""
    kind = F.col("event_type")
    return consecutive_failures(table(spark, sf, "events"), "user_id", ["ts", "event_id"], kind == "error", kind == "purchase")


@query("""SELECT a.conv_id, a.turn, a.role, b.role AS parent_role, sha256(coalesce(b.text, '')) AS parent FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1""")
def q_thread_parent(spark: Spark, sf: str) -> Frame:
    """Each comment with its parent."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    parents = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.col("text").alias("t"))
    return rows.join(parents, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "parent_role", F.sha2(F.coalesce("t", F.lit("")), 256).alias("parent"))


@query("""WITH s AS (SELECT user_id, max(ts) AS seen_at FROM events WHERE event_type = 'view' AND user_id % 3 <> 0 GROUP BY user_id)
SELECT e.user_id, count(*) FILTER (seen_at IS NULL OR ts > seen_at) AS unread FROM events e LEFT JOIN s USING (user_id) GROUP BY e.user_id""")
def q_unread(spark: Spark, sf: str) -> Frame:
    """Events after a user's watermark."""
    e = table(spark, sf, "events")
    seen = e.where("event_type = 'view' AND user_id % 3 <> 0").groupBy("user_id").agg(F.max("ts").alias("seen_at"))
    return unread(e, seen, "user_id")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS recent,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) > 3 AS over_limit FROM events""")
def q_rate_limit(spark: Spark, sf: str) -> Frame:
    """Actions in the window before each; over the limit or not."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-24 * 3_600_000_000, 0)
    n = F.count("*").over(w)
    return e.select("event_id", n.alias("recent"), (n > 3).alias("over_limit"))


@query("""SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS ts, o_orderstatus AS status, NULL::DOUBLE AS value FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01'
UNION ALL SELECT 'event', event_id, ts, NULL, value FROM events WHERE event_type = 'purchase'""")
def q_activity_union(spark: Spark, sf: str, orders_where: str = "o_orderdate >= TIMESTAMP_NTZ '2001-01-01 00:00:00'") -> Frame:
    """Unlike events as one feed.  The bound of the order dates stands for no rule of the
    reference; q_activity_union_whole has none."""
    orders = table(spark, sf, "orders").where(orders_where).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"))
    buys = table(spark, sf, "events").where("event_type = 'purchase'").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "ts", "value")
    return feed([orders, buys])


@query("""WITH u AS (SELECT user_id, 'reply' AS kind, max(event_id) AS event_id, 0 AS p FROM events WHERE event_type = 'click' GROUP BY user_id UNION ALL SELECT user_id, 'mention', max(event_id), 1 FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, kind, event_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p) = 1""")
def q_priority_dedup(spark: Spark, sf: str) -> Frame:
    """A reply beats a mention."""
    e = table(spark, sf, "events")
    part = lambda kind, name: e.where(F.col("event_type") == kind).groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("user_id", F.lit(name).alias("kind"), "event_id")
    return priority_union([part("click", "reply"), part("signup", "mention")], ["user_id"]).select("user_id", "kind", "event_id")


@query("""WITH d AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0) SELECT 'customer' AS "table", count(*) AS removed FROM customer WHERE c_custkey IN (SELECT id FROM d)
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey IN (SELECT id FROM d)""")
def q_cascade(spark: Spark, sf: str) -> Frame:
    """A cascade with the counts of removed rows."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    doomed = customers.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return cascade_delete({"customer": customers, "orders": orders}, {"customer": "c_custkey", "orders": "o_custkey"}, doomed)[1].select("table", "removed")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 = 3 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def q_null_dangling(spark: Spark, sf: str) -> Frame:
    """References to removed rows become null."""
    gone = table(spark, sf, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("id"))
    return null_dangling(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone)


@query("""WITH h AS (SELECT source, max(CASE WHEN doc_id % 2 = 0 THEN doc_id END) AS a, max(doc_id) AS b, count(*) AS n FROM documents GROUP BY source)
SELECT source, CASE WHEN a IS NOT NULL AND a = b THEN 'skip' WHEN a IS NOT NULL AND n >= 5 THEN 'delta' ELSE 'full' END AS mode FROM h""")
def q_classify_mode(spark: Spark, sf: str) -> Frame:
    """Skip, delta or full."""
    d = F.col("doc_id")
    per = table(spark, sf, "documents").groupBy("source").agg(F.max(F.when(d % 2 == 0, d)).alias("a"), F.max(d).alias("b"), F.count("*").alias("n"))
    return per.select("source", classify_mode(F.col("a"), F.col("b"), F.col("n")).alias("mode"))


@query('SELECT count(*) AS "rows", count(DISTINCT o_custkey) AS keys FROM orders')
def q_manifest(spark: Spark, sf: str) -> Frame:
    """Rows and keys of what is published."""
    return manifest(table(spark, sf, "orders"), "o_custkey").select("rows", "keys")

"""Latest rows, venue counts and scores, directories, joins and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import consumer_venue, soft_agreement, strict_vegan, tier
from ..operators.rollups import census, count_map, ordered_text, run_guards, venue_counts, venue_scores
from ..operators.versions import first_per_key, latest, latest_by_id
from ..sources.tables import table
from .registry import query
from .stand_ins import DISHES_SQL, dishes

Spark, Frame = SparkSession, DataFrame


@query("SELECT user_id, event_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def q_latest_event(spark: Spark, sf: str) -> Frame:
    """The latest row of each key by (time, id)."""
    return latest(table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def q_latest_by_id(spark: Spark, sf: str) -> Frame:
    """The latest row by id alone."""
    return latest_by_id(table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def q_first_seen(spark: Spark, sf: str) -> Frame:
    """The first arrival of each key."""
    return first_per_key(table(spark, sf, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


_COUNTS = f"""WITH {DISHES_SQL}, f AS (SELECT *, (category IS NULL OR category = 'food') AS food, coalesce(category = 'dessert' AND primary_type = 'bakery', false) AS product,
  coalesce(serving_role = 'side', false) AS is_side, (verdict = 'vegan' OR (verdict = 'likely_vegan' AND confidence >= 0.75)) AS strict FROM dishes),
c AS (SELECT restaurant_id, count(*) AS total, count(*) FILTER ((food OR product) AND NOT (is_side AND NOT product)) AS meals, count(*) FILTER ((food OR product) AND is_side AND NOT product) AS sides,
  count(*) FILTER ((food OR product) AND NOT (is_side AND NOT product) AND strict) AS vegan_meals, count(*) FILTER ((food OR product) AND is_side AND NOT product AND strict) AS vegan_sides,
  CAST(coalesce(sum(CASE WHEN (food OR product) AND NOT (is_side AND NOT product) AND strict THEN
    CASE WHEN protein_level = 'high' THEN 10 WHEN lower(name) LIKE '%vegan%' THEN 9 WHEN protein_level = 'moderate' THEN 6 ELSE 1 END END), 0) AS BIGINT) AS substance_tenths
  FROM f GROUP BY restaurant_id)"""


@query(f"{_COUNTS} SELECT * FROM c")
def q_counts(spark: Spark, sf: str, rows=dishes) -> Frame:
    """Headline counts and substance points of each venue."""
    return venue_counts(rows(spark, sf))


_SCORE = """, s AS (SELECT c.*, s_name, s_nationkey % 5 = 0 AS dessert, s_suppkey % 3 = 0 AS plant, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 3.0 + s_suppkey % 20 / 10.0 END AS rating,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_suppkey % 400 END AS n FROM c JOIN supplier ON s_suppkey = restaurant_id),
x AS (SELECT restaurant_id, s_name, 5.0 * least(1.0, ln(1 + vegan_meals + 0.25 * vegan_sides) / ln(13.0)) AS a,
  CASE WHEN vegan_meals <= 0 THEN 0.0 WHEN dessert THEN 3.0 * least(1.0, vegan_meals / 5.0) ELSE 3.0 * least(1.0, (substance_tenths / 10.0 + CASE WHEN plant THEN 1 ELSE 0 END) / 3.0) END AS b,
  CASE WHEN rating IS NULL THEN 1.0 ELSE 2.0 * least(1.0, greatest(0.0, ((CASE WHEN n IS NULL THEN rating ELSE (n * rating + 100.0) / (n + 25.0) END) - 3.0) / 2.0)) END AS r, dessert FROM s)
SELECT restaurant_id, s_name, CAST(round(a + b + r, 4) AS DOUBLE) AS score, CAST(round(a, 4) AS DOUBLE) AS selection, CAST(round(b, 4) AS DOUBLE) AS substance, CAST(round(r, 4) AS DOUBLE) AS reputation,
  CASE WHEN dessert THEN 'treat_variety' ELSE 'protein' END AS basis FROM x"""


@query(_COUNTS + _SCORE)
def q_score(spark: Spark, sf: str, rows=dishes, branches: int = 1) -> Frame:
    """The composite score and its parts."""
    k = F.col("s_suppkey")
    venues = table(spark, sf, "supplier").select(
        k, "s_name", (F.col("s_nationkey") % 5 == 0).alias("is_dessert_venue"), (k % 3 == 0).alias("plant_protein"),
        F.when(k % 7 != 0, F.lit(3.0) + k % 20 / 10.0).alias("rating"), F.when(k % 11 != 0, k % 400).alias("user_rating_count"),
    )
    counts = venue_counts(rows(spark, sf)).withColumn("s_suppkey", F.expr(f"restaurant_id div {branches}"))
    scored = venue_scores(counts.join(venues, "s_suppkey"), digits=4)
    return scored.select("restaurant_id", "s_name", "score", "selection", "substance", "reputation", "basis")


@query(f"WITH {DISHES_SQL} SELECT restaurant_id, l_orderkey, l_linenumber, verdict, confidence FROM dishes WHERE verdict = 'vegan' OR (verdict = 'likely_vegan' AND confidence >= 0.75)")
def q_strict(spark: Spark, sf: str, rows=dishes) -> Frame:
    """Strictly vegan rows."""
    return rows(spark, sf).where(strict_vegan(F.col("verdict"), F.col("confidence"))).select("restaurant_id", "l_orderkey", "l_linenumber", "verdict", "confidence")


@query("""SELECT c_custkey, nullif(lower(c_mktsegment), 'building') AS primary_type FROM customer
WHERE NOT coalesce(nullif(lower(c_mktsegment), 'building') IN ('store', 'pharmacy', 'household'), false) OR lower(c_mktsegment) = 'household'""")
def q_null_gate(spark: Spark, sf: str) -> Frame:
    """The consumer gate, null-safe."""
    kind = F.nullif(F.lower("c_mktsegment"), F.lit("building"))
    no = F.lit(False)
    return table(spark, sf, "customer").select("c_custkey", kind.alias("primary_type")).where(consumer_venue(no, no, F.col("primary_type")))


@query("SELECT source, max(doc_id) AS last_doc, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS n FROM documents WHERE lang IS NULL OR lang <> 'xx' GROUP BY source")
def q_source_rollup(spark: Spark, sf: str) -> Frame:
    """Sources by key; the null arm of the excluded value stays."""
    docs = table(spark, sf, "documents").where("lang IS NULL OR lang <> 'xx'")
    return docs.groupBy("source").agg(F.max("doc_id").alias("last_doc"), F.sum(F.length("text")).cast("long").alias("chars"), F.count("*").alias("n"))


@query("""SELECT conv_id, sha256(CASE WHEN count(*) = 1 THEN max(coalesce(text, '')) ELSE string_agg('[page: ' || role || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role, text) END) AS digest, count(*) AS n
FROM conversations GROUP BY conv_id""")
def q_combined_text(spark: Spark, sf: str) -> Frame:
    """The ordered combined text of a key."""
    rows = table(spark, sf, "conversations")
    whole = ordered_text(rows, "conv_id", ["turn", "role", "text"], F.col("text"), F.concat(F.lit("[page: "), F.col("role"), F.lit("]\n")))
    return whole.select("conv_id", F.sha2("text", 256).alias("digest"), "n")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def q_semi(spark: Spark, sf: str) -> Frame:
    """J08, J10, J11."""
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def q_anti(spark: Spark, sf: str) -> Frame:
    """J09, J12."""
    large = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@query("""SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS last_order,
  (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n_done FROM customer""")
def q_scalar_subq(spark: Spark, sf: str) -> Frame:
    """Correlated subqueries as one pre-aggregation and one join."""
    per = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_order"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    zero = F.lit(0).cast("long")
    return table(spark, sf, "customer").select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n", zero).alias("n_orders"), "last_order", F.coalesce("done", zero).alias("n_done"))


@query("""SELECT r_name AS metro, n_name AS area, count(*) AS suppliers, count(*) FILTER (s_acctbal > 0) AS positive, CAST(grouping(r_name, n_name) AS BIGINT) AS level
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def q_rollup(spark: Spark, sf: str) -> Frame:
    """Metro and area totals with the grand total."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    up = rows.rollup(F.col("r_name").alias("metro"), F.col("n_name").alias("area")).agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("positive"), F.grouping_id().cast("long").alias("level"))
    return up.select("metro", "area", "suppliers", "positive", "level")


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS passed,
  round(count(*) FILTER (event_type = 'purchase') * 1.0 / nullif(count(*) FILTER (event_type IN ('purchase', 'error')), 0), 3)::DOUBLE AS agreement FROM events GROUP BY user_id""")
def q_pivot_audit(spark: Spark, sf: str) -> Frame:
    """Counts by status side by side, and their ratio."""
    kind = F.col("event_type")
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(kind == "error").alias("failed"), F.count_if(kind == "purchase").alias("passed"))
    return per.withColumn("agreement", F.round(F.col("passed") / F.nullif(F.col("passed") + F.col("failed"), F.lit(0)), 3))


@query("""SELECT b.bucket, coalesce(n, 0) AS n FROM (VALUES ('http'), ('headless'), ('photo'), ('click'), ('view')) b(bucket)
LEFT JOIN (SELECT event_type AS bucket, count(*) AS n FROM events GROUP BY 1) USING (bucket)""")
def q_census(spark: Spark, sf: str) -> Frame:
    """Counts for fixed buckets, zero-filled."""
    return census(table(spark, sf, "events"), F.col("event_type"), ("http", "headless", "photo", "click", "view"))


@query(f"WITH {DISHES_SQL}, c AS (SELECT restaurant_id, verdict, count(*) AS n FROM dishes GROUP BY ALL) SELECT restaurant_id, string_agg(verdict || '=' || n, ',' ORDER BY verdict) AS by_verdict FROM c GROUP BY restaurant_id")
def q_count_map(spark: Spark, sf: str, rows=dishes) -> Frame:
    """Counts under keys known at run time, here as text."""
    maps = count_map(rows(spark, sf), "restaurant_id", "verdict", "m")
    return maps.select("restaurant_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ",").alias("by_verdict"))


@query("""SELECT l_suppkey, count(*) AS n, CAST(round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS vegan_rate, CAST(round(stddev_pop(l_discount), 6) AS DOUBLE) AS spread
FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 10""")
def q_runguards(spark: Spark, sf: str) -> Frame:
    """Rates and spread of runs with enough rows."""
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "A", "vegan").otherwise("not_vegan").alias("verdict"), "l_discount")
    return run_guards(rows, "l_suppkey", "verdict", "l_discount").select("l_suppkey", "n", F.round("vegan_rate", 6).alias("vegan_rate"), F.round("spread", 6).alias("spread"))


@query(f"""WITH {DISHES_SQL} SELECT CAST(CASE verdict WHEN 'vegan' THEN 0 WHEN 'likely_vegan' THEN 1 WHEN 'vegan_adaptable' THEN 2 WHEN 'not_vegan' THEN 4 ELSE 3 END AS INTEGER) AS vegan,
  CAST(CASE WHEN protein_level = 'high' THEN 0 WHEN protein_level = 'low' THEN 4 WHEN verdict = 'vegan' THEN 0 WHEN verdict IN ('likely_vegan', 'vegan_adaptable') THEN 1 ELSE 3 END AS INTEGER) AS vegetarian, count(*) AS n FROM dishes GROUP BY ALL""")
def q_tier(spark: Spark, sf: str, rows=dishes) -> Frame:
    """Suitability tiers by diet profile."""
    status = F.when(F.col("protein_level") == "high", "vegetarian").when(F.col("protein_level") == "low", "not_vegetarian")
    found = rows(spark, sf).select(tier("vegan", F.col("verdict")).alias("vegan"), tier("vegetarian", F.col("verdict"), status).alias("vegetarian"))
    return found.groupBy("vegan", "vegetarian").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.doc_id, CASE a.quality WHEN 1 THEN 'vegan' ELSE 'unclear' END AS x, CASE a.toxic WHEN 1 THEN 'not_vegan' ELSE 'likely_vegan' END AS y FROM labels a)
SELECT x, y, count(*) AS n, (x, y) IN (('vegan', 'likely_vegan'), ('unclear', 'likely_vegan'), ('unclear', 'not_vegan')) AS agree FROM p GROUP BY x, y""")
def q_agreement(spark: Spark, sf: str) -> Frame:
    """Agreement up to calibration."""
    x, y = F.when(F.col("quality") == 1, "vegan").otherwise("unclear"), F.when(F.col("toxic") == 1, "not_vegan").otherwise("likely_vegan")
    pairs = table(spark, sf, "labels").select(x.alias("x"), y.alias("y")).groupBy("x", "y").agg(F.count("*").alias("n"))
    return pairs.withColumn("agree", soft_agreement(F.col("x"), F.col("y")))


@query("SELECT count(*) AS n, count(*) FILTER (s_acctbal < 0) AS negative, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS balance FROM supplier")
def q_kpis(spark: Spark, sf: str) -> Frame:
    """Scalar figures of a table."""
    return table(spark, sf, "supplier").agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") < 0).alias("negative"), F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("decimal(28,2)").alias("balance"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS last_week FROM events GROUP BY event_type")
def q_deltas(spark: Spark, sf: str) -> Frame:
    """Totals and those of the last seven days."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-24 00:00:00'")).alias("last_week"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_repeated_ids(spark: Spark, sf: str) -> Frame:
    """Keys that are not unique."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey")
def q_locator(spark: Spark, sf: str) -> Frame:
    """The ids of each key, in order."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("ids"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def q_distinct(spark: Spark, sf: str) -> Frame:
    """U03."""
    return table(spark, sf, "part").select("p_brand", "p_type").distinct()


@query("SELECT user_id FROM events WHERE event_type = 'purchase' EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-20'")
def q_difference(spark: Spark, sf: str) -> Frame:
    """U04."""
    e = table(spark, sf, "events")
    return e.where("event_type = 'purchase'").select("user_id").subtract(e.where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-20 00:00:00'").select("user_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def q_topk(spark: Spark, sf: str) -> Frame:
    """The largest hundred."""
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT s_suppkey, n_name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY nullif(s_acctbal > 5000, false) DESC NULLS LAST, s_suppkey) AS BIGINT) AS place
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def q_nulls_last(spark: Spark, sf: str) -> Frame:
    """Nulls last in either direction."""
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("s_nationkey").orderBy(F.nullif(F.col("s_acctbal") > 5000, F.lit(False)).desc_nulls_last(), "s_suppkey")
    return rows.select("s_suppkey", "n_name", F.row_number().over(w).cast("long").alias("place"))

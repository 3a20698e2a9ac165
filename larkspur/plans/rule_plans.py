"""Validation rules, operational buckets, paging, boxes and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import token_cost
from ..operators.community import reattached_prices, usage_window, workload
from ..operators.validate import guarded, ocr_accepted, route_usable, validated
from ..sources.tables import table
from .registry import query

Spark, Frame = SparkSession, DataFrame

_NAMES = ("Vegan Pancakes", "Blueberry Waffles", "Cheese Empanada", "Margherita Pizza", "Chicken Bowl", "Scallion Pancake", "Side of rice", "Garden Salad")
_VERDICTS = ("vegan", "likely_vegan", "vegan_adaptable", "unclear", "not_vegan")


def _rows(spark: Spark, sf: str) -> Frame:
    k = F.col("p_partkey")
    names, verdicts = F.array(*map(F.lit, _NAMES)), F.array(*map(F.lit, _VERDICTS))
    none = lambda kind="string": F.lit(None).cast(kind)
    return table(spark, sf, "part").select(
        k.alias("id"), F.get(names, (k % 8).cast("int")).alias("name"), F.when(k % 3 == 0, "with oat milk").alias("description"), F.get(verdicts, (F.floor(k / 8) % 5).cast("int")).alias("verdict"),
        F.lit(0.5).alias("confidence"), none().alias("category"), none().alias("reasoning"), none().alias("serving_role"), none().alias("alcohol_status"), none().alias("dairy_status"),
        none().alias("gluten_status"), none().alias("nut_status"), none().alias("protein_level"), none("array<string>").alias("meal_types"), none("array<string>").alias("key_ingredients"), (k % 40 == 0).alias("fully_vegan_venue"),
    )


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 8 AS n, p_partkey % 3 = 0 AS oat, p_partkey % 40 = 0 AS venue, ['vegan', 'likely_vegan', 'vegan_adaptable', 'unclear', 'not_vegan'][CAST(p_partkey // 8 % 5 AS INTEGER) + 1] AS v FROM part),
a AS (SELECT *, CASE WHEN venue THEN 'vegan' WHEN n = 0 AND v IN ('likely_vegan', 'vegan_adaptable', 'unclear') THEN 'vegan' ELSE v END AS v1 FROM r),
b AS (SELECT *, CASE WHEN NOT venue AND v1 IN ('vegan', 'likely_vegan') AND n = 1 AND NOT oat THEN 'unclear' ELSE v1 END AS v2 FROM a),
c AS (SELECT *, CASE WHEN NOT venue AND v2 = 'vegan_adaptable' AND n IN (2, 3, 4) AND NOT oat THEN 'not_vegan' ELSE v2 END AS v3 FROM b)
SELECT id, v3 AS verdict, CASE WHEN n = 6 THEN 'side' ELSE 'unclear' END AS serving_role FROM c""")
def q_validated(spark: Spark, sf: str) -> Frame:
    """Ordered override rules."""
    return validated(_rows(spark, sf)).select("id", "verdict", "serving_role")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey // 8 % 5 IN (0, 1) AND p_partkey % 8 IN (2, 4) AND p_partkey % 3 <> 0 THEN 'unclear' ELSE ['vegan', 'likely_vegan', 'vegan_adaptable', 'unclear', 'not_vegan'][CAST(p_partkey // 8 % 5 AS INTEGER) + 1] END AS verdict,
  p_partkey // 8 % 5 IN (0, 1) AND p_partkey % 8 IN (2, 4) AND p_partkey % 3 <> 0 AS downgraded FROM part""")
def q_guardrail(spark: Spark, sf: str) -> Frame:
    """Vegan verdicts on animal ingredients."""
    return guarded(_rows(spark, sf)).select("id", "verdict", "downgraded")


@query("""SELECT CASE WHEN n_chars <= 5000 THEN '<2' WHEN n_chars <= 15000 THEN '2-5' WHEN n_chars <= 30000 THEN '4-8' ELSE '7-12+' END AS band, count(*) AS n,
  CAST(round(sum(CAST(round((n_chars / 4.0 * 0.14 + n_chars / 120.0 * 110.0 * 0.28) / 1000000, 6) AS DECIMAL(18,6))), 6) AS DECIMAL(28,6)) AS cost FROM documents GROUP BY 1""")
def q_workload(spark: Spark, sf: str) -> Frame:
    """Minutes and list price of classifying texts."""
    chars = F.col("n_chars")
    return table(spark, sf, "documents").groupBy(workload(chars).alias("band")).agg(F.count("*").alias("n"), F.sum(F.round(token_cost(chars), 6).cast("decimal(18,6)")).cast("decimal(28,6)").alias("cost"))


@query("SELECT event_id, CASE WHEN event_id % 100 < 50 THEN 0.0::DOUBLE ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, value * 3 - 10)) END AS used FROM events")
def q_usage(spark: Spark, sf: str) -> Frame:
    """Usage windows, clamped and reset."""
    return table(spark, sf, "events").select("event_id", usage_window(F.col("value") * 3 - 10, F.col("event_id") % 100, F.lit(50)).alias("used"))


@query("""WITH r AS (SELECT c_custkey, CAST(c_acctbal < 0 AS INTEGER) AS section, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal < 0, c_acctbal DESC, c_custkey) AS place FROM customer)
SELECT c_custkey, section, CAST(place AS BIGINT) AS place FROM r WHERE place <= 15""")
def q_paging(spark: Spark, sf: str) -> Frame:
    """A page over two ordered sections."""
    low = (F.col("c_acctbal") < 0).cast("int")
    w = Window.partitionBy("c_nationkey").orderBy(low, F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", low.alias("section"), F.row_number().over(w).cast("long").alias("place")).where("place <= 15")


_BOXES = """b AS (SELECT p_partkey % 40 AS page, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'price' ELSE 'text' END AS kind, CASE WHEN p_size % 3 = 0 THEN 500 ELSE p_size END AS l, p_partkey * 13 % 900 AS t, p_partkey * 13 % 900 + 20 AS u, p_name AS value FROM part)"""


@query(f"""WITH {_BOXES}, j AS (SELECT p.page, p.id AS price_id, t.value AS line, p.value AS price, least(t.u, p.u) - greatest(t.t, p.t) AS o, t.id FROM b t JOIN b p ON t.page = p.page AND t.kind = 'text' AND p.kind = 'price' AND t.l < p.l)
SELECT page, price_id, line, price FROM j WHERE o * 2 >= 20 QUALIFY row_number() OVER (PARTITION BY page, price_id ORDER BY o DESC, id) = 1""")
def q_boxes(spark: Spark, sf: str) -> Frame:
    """Prices to the lines that they stand beside."""
    size, top = F.col("p_size"), F.col("p_partkey") * 13 % 900
    boxes = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("page"), F.col("p_partkey").alias("id"), F.when(size % 3 == 0, "price").otherwise("text").alias("kind"), F.when(size % 3 == 0, 500).otherwise(size).alias("left"), top.alias("top"), (top + 20).alias("bottom"), F.col("p_name").alias("value"))
    return reattached_prices(boxes)


@query("""WITH e AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, event_type, min(event_id) AS first_id, count(*) AS n FROM e GROUP BY user_id, event_type, island HAVING count(*) > 2""")
def q_runs(spark: Spark, sf: str) -> Frame:
    """Runs of more than two equal rows in a row."""
    a, b = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", (F.row_number().over(a) - F.row_number().over(b)).alias("island"))
    return e.groupBy("user_id", "event_type", "island").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n")).where("n > 2").drop("island")


@query("""SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type OR lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type AS keep FROM events""")
def q_neighbours(spark: Spark, sf: str) -> Frame:
    """Rows at a change, by their neighbours."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", (~F.lag(kind).over(w).eqNullSafe(kind) | ~F.lead(kind).over(w).eqNullSafe(kind)).alias("keep"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name >= 'Customer#00000004' AND c_name < 'Customer#00000004' || chr(65535) ORDER BY c_name LIMIT 6")
def q_prefix(spark: Spark, sf: str) -> Frame:
    """Names by prefix, a range that reaches the scan."""
    name = F.col("c_name")
    return table(spark, sf, "customer").where((name >= "Customer#00000004") & (name < "Customer#00000004￿")).select("c_custkey", "c_name").orderBy("c_name").limit(6)


@query("""SELECT o_orderkey, coalesce(nullif(c_name, 'Customer#000000007'), c_mktsegment) AS name, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'resolved' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def q_reports(spark: Spark, sf: str) -> Frame:
    """Reports with the name that was copied, else the current one."""
    people = table(spark, sf, "customer").where("c_acctbal > 0")
    joined = table(spark, sf, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce(F.nullif("c_name", F.lit("Customer#000000007")), "c_mktsegment").alias("name"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("resolved").alias("status"))


@query("""SELECT doc_id, CASE WHEN n_chars < 400 THEN 'reject' WHEN n_chars % 10 >= 6 AND doc_id % 4 <> 0 THEN 'accept' ELSE 'retry' END AS step,
  doc_id % 3 <> 2 AND (n_chars % 10 >= 8 OR doc_id % 5 = 0) AND NOT (doc_id % 2 = 0 AND (n_chars % 10 < 8 OR n_chars < 5000)) AND NOT (n_chars >= 1200 AND doc_id % 7 = 0) AS usable FROM documents""")
def q_routes(spark: Spark, sf: str) -> Frame:
    """Acceptance ladders."""
    d, n = F.col("doc_id"), F.col("n_chars")
    step = ocr_accepted(F.when(n < 400, 100).otherwise(250), F.when(n % 10 >= 6, 0.7).otherwise(0.4), d % 4 == 0)
    method = F.when(d % 3 == 0, "http").when(d % 3 == 1, "headless").otherwise("photo")
    usable = route_usable(method, F.when(n % 10 >= 8, 0.8).otherwise(0.5), n, n, F.lit(0.6), F.when(d % 7 == 0, n * 0.5).otherwise(n), d % 2 == 0, d % 5 == 0)
    return table(spark, sf, "documents").select("doc_id", step.alias("step"), usable.alias("usable"))

"""Updates, reviews and batched calls."""

from datetime import datetime

from pyspark.sql import functions as F

from larkspur.operators.updates import apply_fixes, audit_rows, dismiss, food_signals, guidance, in_batches, pending, update


def test_flags_and_signals(spark):
    r = spark.createDataFrame([(1, False, None, None), (2, False, "OPERATIONAL", "x")], "id long, archived boolean, business_status string, editorial_summary string")
    assert [x.archived for x in update(r, F.col("business_status") == "OPERATIONAL", archived=F.lit(True)).orderBy("id").collect()] == [False, True]
    s = spark.createDataFrame([(1, "google:editorial_summary", "old"), (1, "u", "menu")], "restaurant_id long, url string, content string")
    d = spark.createDataFrame([(1, "CLOSED_PERMANENTLY", "new")], "id long, business_status string, editorial_summary string")
    after, sources = food_signals(r, s.withColumn("type", F.lit("text")), d)
    assert {x.id: x.archived for x in after.collect()} == {1: True, 2: False}
    assert sorted((x.url, x.content) for x in sources.collect()) == [("google:editorial_summary", "new"), ("u", "menu")]


def test_fixes_and_reviews(spark):
    dishes = spark.createDataFrame([(1, "99", None), (2, "5", None)], "id long, price string, calories string")
    fixes = spark.createDataFrame([(1, "price", "$0.99"), (2, "price", "$1"), (1, "name", "x")], "dish_id long, field string, value string")
    hints = spark.createDataFrame([(1, "price", "$0.99")], "dish_id long, field string, suggested string")
    assert {r.id: r.price for r in apply_fixes(dishes, fixes, hints).collect()} == {1: "$0.99", 2: "5"}
    old = spark.createDataFrame([(1, "a", "verified"), (3, "c", "verified")], "id long, fingerprint string, status string")
    new = spark.createDataFrame([(1, "b", "known_issue"), (2, "stale", "verified")], "id long, fingerprint string, status string")
    now = spark.createDataFrame([(1, "b"), (2, "z")], "id long, fingerprint string")
    assert sorted(map(tuple, dismiss(old, new, ["id"], now).collect())) == [(1, "b", "known_issue"), (3, "c", "verified")]
    assert audit_rows(spark.createDataFrame([(None, "x")], "provider string, rule string")).first().asDict() == {"provider": "unknown", "rule": "x", "check_type": "spot_check", "status": "flagged", "detail": ""}


def test_pending_and_batches(spark):
    t = datetime(2024, 1, 1)
    dishes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    cls = spark.createDataFrame([(1, 1, t), (2, 2, t), (3, 2, None)], "id long, dish_id long, attributes_enriched_at timestamp")
    assert sorted(r.id for r in pending(dishes, cls).collect()) == [2, 3]
    got = in_batches(spark.range(10).select(F.col("id")).repartition(1), "id", 4, lambda rows: [{"id": r["id"], "n": len(rows)} for r in rows if r["id"] != 9], "id long, n long")
    assert sorted((r.id, r.n) for r in got.collect()) == [(i, 4) for i in range(8)] + [(8, 2)]
    c = spark.createDataFrame([(1, "a", "x", "y", True, t), (2, "b", "x", "y", False, t), (3, "c", "x", "y", True, t)], "id long, dish_name string, wrong_verdict string, correct_verdict string, active boolean, created_at timestamp")
    assert guidance(c).first()[0] == "- c: x -> y\n- a: x -> y" and guidance(c.limit(0)).first()[0] is None

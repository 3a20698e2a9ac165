"""Queries that take all of their table, where the older ones take a part."""

from larkspur.plans.all import QUERIES

SF = "/root/testdata/sf0.001"


def test_keys_and_previews_see_whole_texts(spark, tmp_path):
    start = "word " * 20
    texts = [start + "one", start + "two", " " * 400 + "late", "a" + " " * 295 + "cut inside", "x" * 300, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["q_keys_and_previews_whole"](spark, str(tmp_path)).collect()}
    assert got[0].key == "word-" * 20 + "one" and got[1].key == "word-" * 20 + "two"
    assert got[2].preview == "late" and got[3].preview == "a cut inside"
    assert got[4].key == "x" * 200 and got[4].preview == "x" * 95 + "…"
    assert got[5].key == "" and got[5].preview is None


def test_dishes_of_all_lines(spark):
    counts = {name: QUERIES[name](spark, SF) for name in ("q_counts_whole", "q_tier_whole", "q_count_map_whole", "q_score_whole")}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    n = lines.count()
    assert sum(r.total for r in counts["q_counts_whole"].collect()) == sum(r.n for r in counts["q_tier_whole"].collect()) == n
    assert sum(int(e.split("=")[1]) for r in counts["q_count_map_whole"].collect() for e in r.by_verdict.split(",")) == n
    # the branches' scores discriminate: the selection part is at its upper bound in few of them
    scores = counts["q_score_whole"].collect()
    assert len({r.selection for r in scores}) > 10 and sum(r.selection == 5 for r in scores) < len(scores) / 2


def test_feed_of_all_orders(spark):
    got = QUERIES["q_activity_union_whole"](spark, SF)
    assert got.where("kind = 'order'").count() == spark.read.parquet(f"{SF}/orders.parquet").count()

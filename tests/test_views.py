"""Whole orders, snapshots and shards, identity against plain loops, word counts, labels."""

import gzip
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.documents import FOOD_WORDS, GIFT_WORDS, substring_hits
from larkspur.functions.text import squeezed
from larkspur.functions.views import in_city, like_ascii, menu_stale, relative_label
from larkspur.operators.identity import canonical, compatible, compatible_groups, upsert_dishes
from larkspur.operators.ranks import ranked
from larkspur.plans.view_plans import dish_rows, q_upsert_dishes
from larkspur.sources.tables import read_shards, read_snapshot

SF = "/root/testdata/sf0.001"
DISH = "restaurant_id long, id long, name string, price string, raw_description string, calories string, latest_cls long"


def test_ranks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]) if i % 3 else "hot", rnd.randint(0, 5) if i % 7 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(6)
    order = [F.col("x").desc_nulls_last(), F.col("i")]
    key = lambda r: (r[1] is None, -(r[1] or 0), r[2])
    want = {r[2]: k for g in ("a", "b", None, "hot") for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=key), 1)}
    assert {r.i: r["rank"] for r in ranked(df, order, ("g",)).collect()} == want
    assert {r.i: r.place for r in ranked(df, order, out="place").collect()} == {r[2]: k for k, r in enumerate(sorted(rows, key=key), 1)}
    assert ranked(df.limit(0), order).count() == 0 and ranked(df, order).columns == ["g", "x", "i", "rank"]


def test_snapshots_and_shards(spark, tmp_path):
    schema = T.StructType([T.StructField("restaurant_id", T.IntegerType()), T.StructField("name", T.StringType())])
    paths = [str(tmp_path / n) for n in ("dishes.json", "dishes-compact.json.gz", "dishes.json.gz")]
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, schema, *paths)
    for path, name in ((paths[2], "legacy"), (paths[1], "compact")):
        with gzip.open(path, "wt") as f:
            f.write(f'{{"restaurant_id": 1, "name": "{name}"}}\n{{"restaurant_id": 9, "name": "{name} nine"}}\n')
        assert [r.name for r in read_snapshot(spark, schema, *paths).orderBy("restaurant_id").collect()] == [name, f"{name} nine"]
    for key, body in ((1, '{"name": "one"}\n'), (2, '{"name": "two"}\n{broken\n'), (3, '{"name": "three"}\n')):
        (tmp_path / "shards" / f"restaurant_id={key}").mkdir(parents=True)
        (tmp_path / "shards" / f"restaurant_id={key}" / "x.json").write_text(body)
    rows, failed = read_shards(spark, str(tmp_path / "shards"), schema, "restaurant_id", [1, 2, 9, 10], read_snapshot(spark, schema, *paths))
    assert sorted(map(tuple, rows.collect())) == [(1, "one"), (9, "compact nine")] and [r[0] for r in failed.collect()] == [2]
    assert sorted(r.name for r in read_shards(spark, str(tmp_path / "shards"), schema, "restaurant_id", [3, 9])[0].collect()) == ["three"]


def keys(r):
    return (r["restaurant_id"], canonical(r["name"]), r["price"], canonical(r["raw_description"]), canonical(r["calories"]))


def plain_groups(rows):
    seeds, out = [], []
    for r in sorted(rows, key=lambda r: r["id"]):
        k = keys(r)
        for seed, members in seeds:
            if seed[0] == k[0] and compatible(seed[1:], k[1:]):
                members.append(r)
                break
        else:
            seeds.append((k, [r]))
    for _, members in seeds:
        best = max(members, key=lambda r: (r["latest_cls"] if r["latest_cls"] is not None else -1, len(r["raw_description"] or ""), -r["id"]))
        out += [(r["restaurant_id"], r["id"], best["id"]) for r in members]
    return sorted(out)


def plain_upsert(base, delta):
    known, out = [(r["id"], keys(r)) for r in sorted(base, key=lambda r: r["id"])], []
    for r in sorted(delta, key=lambda r: r["id"]):
        k = keys(r)
        exact = [i for i, x in known if x == k]
        close = exact or [i for i, x in known if x[0] == k[0] and compatible(x[1:], k[1:])]
        out.append((r["id"], "exact" if exact else "compatible" if close else "insert", close[0] if close else r["id"]))
        if not close:
            known.append((r["id"], k))
    return sorted(out)


def test_identity_equals_plain_loops(spark):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 1), i, rnd.choice(["Tofu", "TOFU!", "Soup"]), "9", rnd.choice([None, "", "a", "b", "c c"]), rnd.choice([None, "1", "2"]), rnd.choice([None, 1, 2])) for i in range(150)]
    df = spark.createDataFrame(rows, DISH)
    plain = [r.asDict() for r in df.collect()]
    assert sorted(map(tuple, compatible_groups(df.repartition(3)).collect())) == plain_groups(plain)
    for cut in (0, 40, 75, 150):
        assert sorted(map(tuple, upsert_dishes(df.where(F.col("id") < cut), df.where(F.col("id") >= cut)).collect())) == plain_upsert(plain[:cut], plain[cut:])


def test_upsert_query(spark):
    rows = [r.asDict() | {"price": (r.price or "").strip("$")} for r in dish_rows(spark, SF).collect()]
    assert sorted(map(tuple, q_upsert_dishes(spark, SF).collect())) == plain_upsert([r for r in rows if r["id"] % 3], [r for r in rows if r["id"] % 3 == 0])


def test_word_counts(spark):
    rnd = random.Random(2)
    texts = ["", "cheesecakes and cheese", "onionion tomatomato tartart", "gift cards e-gift egift vouchers", None] + ["".join(rnd.choice([*FOOD_WORDS, *GIFT_WORDS, " ", "x", "s"]) for _ in range(40)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for words in (FOOD_WORDS, GIFT_WORDS, ("a", "aa", "ab", "abc", "b")):
        assert [r[0] for r in df.select(substring_hits(F.col("t"), words)).collect()] == [None if t is None else sum(t.count(w) for w in words) for t in texts]


def test_squeezed(spark):
    texts = ["", " ", "a", " a  b\t\nc ", "\x85a\xa0\xa0b ", "a\x1cb\x1f", None] + ["".join(random.Random(i).choice("ab \t\xa0\n ") for _ in range(30)) for i in range(40)]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(squeezed(F.col("t"))).collect()] == [None if t is None else " ".join(t.split()) for t in texts]


def test_labels(spark):
    now = datetime(2024, 5, 1, 12)
    ages = [(-1, False, "today"), (0.99, False, "today"), (1, False, "yesterday"), (2, False, "2 days ago"), (29.9, False, "29 days ago"), (30, False, "1 month ago"), (30.01, True, "1 month ago"), (60, True, "2 months ago"), (400, True, "13 months ago")]
    df = spark.createDataFrame([(now - timedelta(days=a),) for a, *_ in ages] + [(None,)], "at timestamp")
    assert [tuple(r) for r in df.select(menu_stale(F.col("at"), F.lit(now)), relative_label(F.col("at"), F.lit(now))).collect()] == [tuple(a[1:]) for a in ages] + [(False, None)]
    places = spark.createDataFrame([("1 Orlando Ave, Maitland, FL",), ("1 Main St, Orlando",), (None,)], "a string")
    assert [r[0] for r in places.select(in_city(F.col("a"), F.lit("MAITLAND"))).collect()] == [True, False, False] and not any(r[0] for r in places.select(in_city(F.col("a"), F.lit("Orlando"))).collect())
    likes = spark.createDataFrame([("DeepSeek-v3",), ("É",), ("é",)], "a string")
    assert [r[0] for r in likes.select(like_ascii(F.col("a"), "%SEEK%")).collect()] == [True, False, False] and [r[0] for r in likes.select(like_ascii(F.col("a"), "É")).collect()] == [False, True, False]

"""Canonical JSON, merged dishes, script calls and ordering sites: odd texts, brute force and cases."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_keyed_streams import plain

from larkspur.functions.canonical import canonical_json, menu_fingerprint
from larkspur.operators.extract import best_sites, common_run, site_score
from larkspur.operators.identity import canonical, display_quality, preferred_name
from larkspur.operators.merging import merged_dishes
from larkspur.operators.script_calls import call_items, script_call_items
from larkspur.plans.crawl_plans import crawl_rows, q_location_batches, q_sibling_drops
from larkspur.streaming import urls as url_streams
from larkspur.streaming.urls import judged

SF = "/root/testdata/sf0.001"


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def test_canonical_json(spark):
    rnd = random.Random(3)
    odd = ["", "plain", '"\\/', "\x00\x1f\x7f\x80\x85 ퟿￿", "ä€😀𐍈", "\b\t\n\f\r", None] + ["".join(chr(rnd.choice([rnd.randint(0, 127), rnd.randint(128, 0xD7FF), rnd.randint(0x10000, 0x10FFFF)])) for _ in range(20)) for _ in range(60)]
    kind = T.StructType([T.StructField("b", T.ArrayType(T.StringType())), T.StructField("a", T.LongType()), T.StructField("é", T.BooleanType()), T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))])
    rows = [(t, ([t, None, "x"] if i % 3 else None, i if i % 2 else None, i % 5 == 0, {t or "": i, "Z": None, "a": 1} if i % 4 else None)) for i, t in enumerate(odd)] + [("none", None)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("t", T.StringType()), T.StructField("v", kind)]))
    got = df.select(canonical_json(F.col("t"), T.StringType()), canonical_json(F.col("v"), kind)).collect()
    want = [(dumps(t), dumps(None if v is None else dict(zip(("b", "a", "é", "m"), v, strict=True)))) for t, v in rows]
    assert [tuple(r) for r in got] == want
    with pytest.raises(TypeError):
        canonical_json(F.col("x"), T.DoubleType())


def test_menu_fingerprint(spark):
    rows = [("https://x/é", [["u", "line\n“q”"], [None, None]], ["stale", "Zebra", "é", "a"]), (None, [], ["one"])]
    df = spark.createDataFrame(rows, "w string, s array<array<string>>, f array<string>")
    got = [r[0] for r in df.select(menu_fingerprint(F.col("w"), F.col("s"), F.col("f"))).collect()]
    assert got == [hashlib.sha256(dumps({"website_url": w, "sources": s, "flags": sorted(f)}).encode()).hexdigest() for w, s, f in rows]


def quality(name):
    letters = "".join(c for c in name if c.isalpha())
    return (not (letters != "" and letters == letters.upper() and letters != letters.lower()), any(c.isascii() and c.isalpha() for c in name) and name.istitle(), not (len(name) > 1 and name[-1] in "Ⓥⓥ" and name[-2].isspace()), -len(name))


def test_spelling(spark):
    names = ["TOFU BOWL", "Tofu Bowl", "tofu bowl", "Tofu Bowl Ⓥ", "Tofu BowlⓋ", "É", "été", "Été", "123", "", "ÉTÉ", "O'Neil'S", "Straße", "Mc Donald", "McDonald", "ⓥegan", "ǅ X", "日本"]
    pairs = [(a, b) for a in names for b in names]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", display_quality(F.col("a")).alias("q"), preferred_name(F.col("a"), F.col("b")).alias("p")).collect()
    assert {r.a: tuple(r.q) for r in got} == {n: quality(n) for n in names}
    assert [r.p for r in got] == [b if quality(b) > quality(a) else a for a, b in pairs]


def test_merged_dishes_equal_a_fold(spark):
    rnd, rows = random.Random(5), []
    for i in range(300):
        name = rnd.choice(["Tofu Bowl", "TOFU BOWL", "tofu-bowl", "Tofu Bowl Ⓥ", "Soup", "soup", None])
        rows.append((i % 3 if i % 50 else None, i, name, rnd.choice(["$9", "9.00", None]), rnd.choice([None, "", "hot", "HOT!"]), rnd.choice([None, "90 cal"]), rnd.choice([0.1, 0.9]), rnd.sample(["lunch", "dinner", "brunch"], rnd.randint(0, 3)) + ["lunch"], [f"i{rnd.randint(0, 14)}" for _ in range(rnd.randint(0, 12))], f"x{i}"))
    columns = ["restaurant_id", "place", "name", "price", "raw_description", "calories", "confidence", "meal_types", "key_ingredients", "early"]
    df = spark.createDataFrame(rows, "restaurant_id int, place int, name string, price string, raw_description string, calories string, confidence double, meal_types array<string>, key_ingredients array<string>, early string")
    want, at = [], {}
    for row in rows:
        r = dict(zip(columns, row, strict=True))
        key = (r["restaurant_id"], canonical(r["name"]), r["price"] and "9", canonical(r["raw_description"]), canonical(r["calories"]))
        if key not in at:
            at[key] = len(want)
            want.append(r)
            continue
        old = want[at[key]]
        best = r if (len(r["raw_description"] or ""), r["confidence"]) > (len(old["raw_description"] or ""), old["confidence"]) else old
        name = r["name"] if quality(r["name"] or "") > quality(old["name"] or "") else old["name"]
        want[at[key]] = {**best, "place": old["place"], "name": name, "meal_types": list(dict.fromkeys(old["meal_types"] + r["meal_types"])), "key_ingredients": list(dict.fromkeys(old["key_ingredients"] + r["key_ingredients"]))[:8]}
    got = merged_dishes(df.repartition(4))
    assert got.columns == columns and sorted(map(tuple, got.collect()), key=repr) == sorted((tuple(w[c] for c in columns) for w in want), key=repr)
    assert merged_dishes(df.limit(0)).count() == 0


def test_script_calls(spark):
    page = r"""
    renderMerchandise(0,"54","Aguachile", 17.5, "Lime, jalapeños &amp; \"avocado\" 😀", "https://x/item.png", "", "False");
    renderMerchandise(1, 'x', 'It\'s (new)', "8", '');renderMerchandise(f(1, [2, 3]), {"a": ")"}, `Third, one`, 3.333, "line\
two") ;
    renderMerchandise(0,"54","AGUACHILE ", 17.50, "lime, JALAPEÑOS & \"avocado\"  😀");
    renderMerchandise(1, 2, "few", 3); renderMerchandise(1, 2, "free", 0, "x"); renderMerchandise(1, 2, "odd", "n/a", "x"); renderMerchandise(1, 2, "", 3, "x"); renderMerchandise(1, 2, "not a statement", 3, "x") + 1;
    renderMerchandise(1, 2, "never closed", 3, "x  renderMerchandise(1, 2, "Last", 4, bare);
    """
    want = [("Aguachile", 'Lime, jalapeños & "avocado" 😀', "$17.50"), ("It's (new)", "", "$8.00"), ("Third, one", "linetwo", "$3.33"), ("Last", "bare", "$4.00")]
    assert call_items(page) == want and call_items(None) == [] and call_items("renderMerchandise(") == []
    df = spark.createDataFrame([(1, page), (2, None), (3, "x")], "id int, html string")
    assert [tuple(r) for r in script_call_items(df, keep=("id",)).orderBy("place").collect()] == [(1, k, *w) for k, w in enumerate(want)]


def test_site_scores(spark):
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        runs = [n for n in range(1, 15) for i in range(len(a) - n + 1) if a[i : i + n] in b]
        assert common_run(a, b) == (max(runs, default=0) if max(runs, default=0) >= 4 else 0)
    home = "https://www.claseazulcapecoral.com/"
    rows = [(1, "https://oo.viguest.com/?siteName=claseazulcape", home), (1, "https://oo.viguest.com/?siteName=Claseazulfortmyers", home), (1, "https://oo.viguest.com/?x=1&siteName=Clase%20Azul%20Cape#y", home), (2, "https://oo.viguest.com/", home), (2, "https://oo.viguest.com/?siteName=zz", home), (3, "https://a/?siteName=ab", None)]
    df = spark.createDataFrame(rows, "k int, c string, h string")
    assert [r[0] for r in df.select(site_score(F.col("c"), F.col("h"))).collect()] == [23, 9, 23, 0, 0, 0]
    assert sorted(r.c[-20:] for r in best_sites(df, "k", "c", "h").collect()) == sorted(c[-20:] for k, c, _ in rows if "fort" not in c)


def test_queries_equal_plain_python(spark):
    rows = [r.asDict() for r in judged(crawl_rows(spark, SF)).collect()]
    assert sorted(map(tuple, q_location_batches(spark, SF).collect())) == plain(rows, url_streams.MOST_OBSERVED)
    one = [r | {"batch": 0, "strong": False} for r in rows]
    kept = {(r, u) for r, _, _, u in plain(one, 10**9)}
    assert {tuple(r) for r in q_sibling_drops(spark, SF).collect()} == {(r["record"], r["url"]) for r in rows} - kept

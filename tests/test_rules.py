"""Ordered validation rules and community operators."""

from datetime import date

from pyspark.sql import functions as F

from larkspur.operators.community import bad_replies, mention_counts, new_lines, notes_by_place, notifications, pdf_date, real_mentions, reattached_prices, resolved_favourites, stale, structured_counts, usage_window
from larkspur.operators.validate import ENUMS, attribute_batch, guarded, ocr_accepted, validated

SCHEMA = "name string, description string, verdict string, confidence double, category string, reasoning string, serving_role string, alcohol_status string, dairy_status string, gluten_status string, nut_status string, protein_level string, meal_types array<string>, key_ingredients array<string>, fully_vegan_venue boolean"


def dish(name, verdict, description=None, confidence=0.5, category="food", venue=False, **more):
    row = dict(name=name, description=description, verdict=verdict, confidence=confidence, category=category, reasoning=None, serving_role=None, alcohol_status=None, dairy_status="x", gluten_status="free", nut_status=None, protein_level=None, meal_types=None, key_ingredients=None, fully_vegan_venue=venue)
    return tuple((row | more).values())


def test_rules_in_order(spark):
    rows = [
        dish("Vegan Pancakes", "likely_vegan"), dish("Blueberry Waffles", "vegan", confidence=0.9), dish("Cheese Empanada", "vegan_adaptable"), dish("Margherita Pizza", "unclear", "mozzarella, basil"),
        dish("Pizza", "vegan", "vegan cheese"), dish("Chicken Waffle", "not_vegan", venue=True), dish("Scallion Pancake", "vegan"), dish("Add tofu", "vegan"), dish("  ", "vegan"), dish("X", "maybe"),
        dish("IPA", "vegan", category="drink"), dish("Bowl", "vegan", confidence=7.0, meal_types=["lunch", "lunch", "x"], key_ingredients=[" Tofu ", "tofu", ""], category="zzz"),
        dish("Vegan Bowl", "unclear", "with bacon"),
    ]
    got = {r.name: r for r in validated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 11
    assert {n: (r.verdict, r.rules) for n, r in got.items()} == {
        "Vegan Pancakes": ("vegan", ["vegan_name"]), "Blueberry Waffles": ("unclear", ["batter"]), "Cheese Empanada": ("not_vegan", ["namesake"]), "Margherita Pizza": ("not_vegan", ["baked_cheese"]),
        "Pizza": ("vegan", []), "Chicken Waffle": ("vegan", ["vegan_venue"]), "Scallion Pancake": ("vegan", []), "Add tofu": ("vegan", ["add_on"]), "IPA": ("vegan", []), "Bowl": ("vegan", []), "Vegan Bowl": ("unclear", []),
    }
    assert got["Blueberry Waffles"].confidence == 0.4 and got["Bowl"].confidence == 1.0 and got["Add tofu"].serving_role == "side"
    assert got["IPA"].alcohol_status == "alcoholic" and got["Bowl"].category == "food" and got["Bowl"].dairy_status == "unclear"
    assert got["Bowl"].meal_types == ["lunch"] and got["Bowl"].key_ingredients == ["tofu"]


def test_guardrail(spark):
    df = spark.createDataFrame([("Bowl", "with egg", None, ["rice"], "vegan", 0.9), ("Bowl", "tofu egg", None, [], "vegan", 0.9), ("Egg", None, None, None, "unclear", 0.9)], "name string, description string, reasoning string, key_ingredients array<string>, verdict string, confidence double")
    assert [(r.verdict, r.confidence, r.downgraded) for r in guarded(df).collect()] == [("unclear", 0.3, True), ("vegan", 0.9, False), ("unclear", 0.9, False)]


def test_attribute_batch(spark):
    fine = {c: v[-1] for c, v in ENUMS.items()} | {"meat_sources": ["fish", "fish"], "flavor_profile": ["tangy"], "ingredient_tags": [" Rice "]}
    rows = [{"id": 1} | fine, {"id": 2} | fine | {"egg_status": "maybe"}, {"id": 9} | fine, {"id": 3} | fine | {"meat_sources": ["unicorn"]}]
    schema = "id long, " + ", ".join(f"{c} string" for c in ENUMS) + ", meat_sources array<string>, flavor_profile array<string>, ingredient_tags array<string>"
    answers = spark.createDataFrame([tuple(r[k] for k in ("id", *ENUMS, "meat_sources", "flavor_profile", "ingredient_tags")) for r in rows], schema)
    good, problems = attribute_batch(spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long"), answers)
    (only,) = good.collect()
    assert (only.id, only.meat_sources, only.ingredient_tags) == (1, ["fish"], ["rice"])
    assert {r.id: r.problem for r in problems.collect()} == {2: "egg_status=maybe", 3: "meat_sources", 9: "unexpected id", 4: "missing from response"}


def test_community(spark):
    c = spark.createDataFrame([(1, "p", "a", None, "hi", 1, []), (2, "p", "b", 1, "re", 2, ["a"]), (3, "q", "b", 1, "x", 3, []), (4, "p", "c", None, "@a", 4, ["a"]), (5, "p", "a", 99, "y", 5, [])], "id long, place_id string, user_id string, parent_id long, body string, created_at long, mentioned array<string>")
    assert sorted(r.id for r in bad_replies(c).collect()) == [3, 5]
    assert [(r.id, r.kind) for r in notifications(c, "a").collect()] == [(4, "mention"), (3, "reply"), (2, "reply")]
    notes = {r.place_id: [n.id for n in r.notes] for r in notes_by_place(c).collect()}
    assert notes == {"p": [5, 4, 2, 1], "q": [3]}
    m = spark.createDataFrame([("p", [("k",), ("k",)]), ("p", [("j",)]), ("q", [])], "place_id string, mentions array<struct<dish_key:string>>")
    assert sorted(map(tuple, mention_counts(m).collect())) == [("p", "j", 1), ("p", "k", 2)]
    body = spark.createDataFrame([(1, "hey @Ann and @bobby", ["ann", "bob", "zed", "ANN"])], "id long, body string, usernames array<string>")
    users = spark.createDataFrame([("u1", "Ann"), ("u2", "bob"), ("u3", "zed")], "user_id string, username string")
    assert [tuple(r) for r in real_mentions(body, users).collect()] == [(1, ["u1"])]
    f = spark.createDataFrame([("p", "k", 7), ("p", "z", 8)], "place_id string, dish_key string, local_id long")
    d = spark.createDataFrame([(3, "p", "k")], "id long, place_id string, dish_key string")
    assert sorted(r.dish_id for r in resolved_favourites(f, d).collect()) == [3, 8]


def test_dates_and_windows(spark):
    one = spark.range(1)
    old = pdf_date(F.lit("D:20200102030405"))
    assert one.select(old).first()[0] == date(2020, 1, 2) and one.select(pdf_date(F.lit("2020"))).first()[0] is None
    today, none = F.lit(date(2024, 1, 1)), F.lit(None).cast("date")
    assert tuple(one.select(stale(old, none, today), stale(none, none, today), stale(old, F.lit(date(2023, 12, 1)), today)).first()) == (True, False, False)
    assert tuple(one.select(usage_window(F.lit(120.0), F.lit(5), F.lit(3)), usage_window(F.lit(50.0), F.lit(2), F.lit(3))).first()) == (100.0, 0.0)
    assert tuple(one.select(ocr_accepted(F.lit(100), F.lit(0.9), F.lit(False)), ocr_accepted(F.lit(300), F.lit(0.7), F.lit(False)), ocr_accepted(F.lit(300), F.lit(0.7), F.lit(True))).first()) == ("reject", "accept", "retry")
    assert tuple(one.select(structured_counts(F.lit("[structured-menu products=4 categories=2] x [structured-menu products=9 categories=1]"))).first()[0]) == (9, 2)
    assert one.select(new_lines(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.array(*map(F.lit, ("a", "b", "new", "c", "d"))))).first()[0] == ["b", "new", "c"]


def test_price_boxes(spark):
    rows = [(1, 1, "text", 0, 0, 20, "Soup"), (1, 2, "text", 0, 30, 50, "Salad"), (1, 3, "price", 100, 2, 22, "$5"), (1, 4, "price", 100, 60, 70, "$9"), (2, 5, "price", 100, 0, 20, "$7"), (1, 6, "text", 0, 1, 21, "Soup again")]
    got = reattached_prices(spark.createDataFrame(rows, "page int, id int, kind string, left int, top int, bottom int, value string")).collect()
    assert [tuple(r) for r in got] == [(1, 3, "Soup again", "$5")]

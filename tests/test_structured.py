"""Menus in JSON-LD, scripts and client state: cases with exact texts, and shown lines of a page."""

import json

from pyspark.sql import functions as F

from larkspur.operators.extract import client_products, html_lines
from larkspur.operators.structured import menu_line, script_items, state_products, state_text, structured_text


def text_of(spark, html, least=1):
    rows = structured_text(spark.createDataFrame([(1, html)], "id int, html string"), keep=("id",), least=least).collect()
    return tuple(rows[0])[1:] if rows else None


def state_of(spark, *values, least=1):
    rows = state_text(spark.createDataFrame([(1, list(values))], "id int, v array<string>"), "v", ("id",), least).collect()
    return tuple(rows[0])[1:] if rows else None


def ld(value) -> str:
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


def test_navigation_and_footers_are_not_shown():
    assert html_lines("<nav>Home About</nav><p>Soup $4</p><footer>Copyright</footer>") == "Soup $4"
    assert html_lines("<template>kept</template><iframe>also</iframe><head>x</head>") == "kept\nalso"


def test_lines(spark):
    rows = [(" Tofu ", " a  b ", "9.5"), ("Tofu", "ab", None), ("Tofu", '", x y\\', "$4 "), ("Tofu", None, ""), ("Tofu", "", "market")]
    got = spark.createDataFrame(rows, "n string, d string, p string").select(menu_line(F.col("n"), F.col("d"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["Tofu — a b ($9.5)", "Tofu", "Tofu — x y ($4)", "Tofu", "Tofu ($market)"]


def test_json_ld(spark):
    item = lambda n, **more: {"@type": "MenuItem", "name": n, **more}
    menu = {"@type": "Menu", "name": "Lunch", "hasMenuSection": [[{"name": "Hot", "hasMenuItem": item("Soup", offers=[{"price": 4.5}, {"price": 9}])}], [{"hasMenuItem": [item("Soup", offers={"price": "4.5"}), item(" "), "x", item("Tea", description="green  tea", offers={"price": 0})]}]]}
    page = "<p>x</p>" + ld({"@graph": [{"deep": {"menu": menu}}]}) + ld([1]) + '<script type="application/ld+json">{"@type": broken</script>'
    assert text_of(spark, page) == ("json_ld", 2, "== Lunch ==\nHot:\nSoup ($4.5)\nTea — green tea ($0)")
    assert text_of(spark, page, least=3) is None and text_of(spark, None) is None


def test_scripts(spark):
    pad = " " * 2000
    body = 'a={"itemName":"A \\u00e9","desc":"with  rice","x":{"price":9.5}}; b="{\\"dishName\\":\\"B\\",\\"unitPrice\\":\\"7\\"}";' + pad
    assert text_of(spark, f"<script>{body}</script>") == ("embedded", 2, "A é — with rice ($9.5)\nB ($7)")
    assert text_of(spark, f"<script>{body[:300]}</script>") is None
    # a name without a price in reach gives way to the next; one that a pair spans is passed over
    assert script_items('"itemName":"far"' + "x" * 701 + '"price":1') == []
    assert script_items('"itemName":"far"' + "x" * 700 + '"price":1') == [("far", None, "1")]
    assert script_items('"itemName":"one","itemName":"two","price":3,"itemName":"three","price":12345') == [("one", None, "3"), ("three", None, "1234")]
    assert script_items('"itemName":"","price":3,"itemName":"' + "n" * 121 + '","price":4') == []


def test_json_ld_wins(spark):
    menu = {"@type": "Menu", "hasMenuSection": {"hasMenuItem": [{"name": f"n{i}"} for i in range(8)]}}
    body = '"itemName":"A","price":1' + " " * 2000
    assert text_of(spark, ld(menu) + f"<script>{body}</script>", least=8)[0] == "json_ld" and text_of(spark, f"<script>{body}</script>" + ld({"@type": "Menu"}))[0] == "embedded"


def test_state(spark):
    pad = "x" * 100
    dayparts = json.dumps({"restaurant_menu": {"Brunch": [{"name": "Eggs", "items": [{"name": "Toast", "cost": {"price": "4"}}, {"name": "Jam", "nutrition": {"fdamessage": "40  cal"}}, {"name": "Button"}]}]}, "pad": pad})
    assert state_of(spark, dayparts) == (2, 1, "[structured-menu products=2 categories=1]\n== Brunch > Eggs ==\nToast ($4)\nJam [40 cal]")
    # only branches carry their label down; other nodes wrap
    wrapped = {"name": "A", "categories": [{"name": "B", "items": [{"id": "PROD7", "name": "x"}]}], "data": {"items": [{"name": "y", "price": 3}]}}
    assert [p[:2] for p in state_products([json.dumps(wrapped)])] == [("A > B", "x"), ("", "y")]
    assert state_products([json.dumps({"products": [{"name": "<b>Tofu</b> &amp; rice", "description": "<p>very<br>hot</p>", "price": {"value": 5}}, {"name": "tofu & RICE", "price": 5.0}, {"name": "TOFU & rice", "price": 5}, {"name": "x" * 161, "price": 1}]})])[0] == ("", "Tofu & rice", "very hot", 5, None)
    assert client_products('{"products": [{"name": "a", "price": 0}, {"name": "b", "formattedPrice": "$1", "price": 2}, {"name": "c", "calories": 90}]}') == [("", "a", "", "0"), ("", "b", "", "$1"), ("", "c", "", "")]
    assert state_of(spark, "{}", None, "[1", dayparts[:50]) is None and state_products(["[" * 3000 + "]" * 3000]) == []

"""Sibling pages, page filters and text repairs."""

from pyspark.sql import functions as F

from larkspur.operators.extract import canonical_root, common_run, joined_letters, letters_joined, pdf_links, site_match, unescaped
from larkspur.operators.locate import filter_pages, sibling_drops


def test_sibling_drops(spark):
    home = "10 N Park Ave, Winter Park, FL 32789, USA"
    urls = ["http://x/Anejo-Winter-Park-Menus.pdf", "http://x/Anejo-Daytona-Beach-Menus.pdf", "http://x/Anejo-dinner-Menus.pdf", "http://y/Anejo-Tampa-Menus.pdf", "http://x/Anejo-Menus.pdf"]
    got = sibling_drops(spark.createDataFrame([(1, u, home) for u in urls], "r long, url string, address string"), "r").collect()
    assert [r.url for r in got] == [urls[1]]


def test_filter_pages(spark):
    home = "3201 Corrine Dr, Orlando, FL 32803, USA"
    rows = [(1, "http://d/eemenu", "Corrine Dr. 3201 Corrine", home), (1, "http://d/jaxmenu", "Jacksonville only", home), (1, "http://d/dinner-menu", "none", home), (1, "http://d/dpmenu", "corrine 3201", home), (2, "http://d/amenu", "x", home), (2, "http://d/bmenu", "y", home), (3, "http://d/amenu", "x", None)]
    got = filter_pages(spark.createDataFrame(rows, "restaurant_id long, url string, text string, address string"))
    assert sorted((r.restaurant_id, r.url) for r in got.collect()) == [(1, "http://d/dinner-menu"), (1, "http://d/dpmenu"), (1, "http://d/eemenu"), (2, "http://d/amenu"), (2, "http://d/bmenu"), (3, "http://d/amenu")]


def test_text_repairs(spark):
    assert joined_letters("D e s s e r t s  a n d\nplain line") == "Desserts and\nplain line"
    assert (common_run("winterpark", "xterpax"), common_run("abc", "abc")) == (5, 0)
    df = spark.createDataFrame([("T o f u  b o w l s", "a &amp; b\\/c", "thesitename", "http://www.site.name/", '<link rel="canonical" href="https://d.squarespace.com/x">', "http://www.d.com/m", "<a href='/m.pdf'><a href='/m.pdf'>(https://x/y.pdf?z=1)")], "a string, b string, c string, d string, e string, f string, g string")
    r = df.select(letters_joined(F.col("a")), unescaped(F.col("b")), site_match(F.col("c"), F.col("d")), canonical_root(F.col("e"), F.col("f")), canonical_root(F.col("e"), F.lit("https://d.squarespace.com/")), pdf_links(F.col("g"))).first()
    assert tuple(r) == ("Tofu bowls", "a & b/c", 8, "https://d.squarespace.com", None, ["/m.pdf", "https://x/y.pdf?z=1"])


def test_products(spark):
    import json

    from larkspur.functions.venues import cuisine, preferred_category, venue_kind
    from larkspur.operators.extract import client_products, embedded_items, product_rows

    state = json.dumps({"menu": {"categories": [{"name": "Mains", "items": [{"id": "prod1", "name": "Tofu"}, {"name": "Soup", "price": {"value": 4}}, {"name": "Button"}], "subCategories": [{"name": "Hot", "products": [{"displayName": "Curry", "description": " very  hot "}, {"id": "prod1", "name": "Tofu"}]}]}]}})
    want = [("Mains", "Tofu", "", ""), ("Mains", "Soup", "", "4"), ("Mains > Hot", "Curry", "very hot", "")]
    assert client_products(state) == want and client_products("{") == []
    assert [tuple(r) for r in product_rows(spark.createDataFrame([(state,), (None,)], "s string"), "s").collect()] == want
    assert embedded_items('x={"itemName":"A \\u00e9","d":1,"price":"9.50"}; y="{\\"itemName\\":\\"B\\",\\"price\\":7}"') == [("A é", "9.50"), ("B", "7")]
    df = spark.createDataFrame([("latin_american_restaurant", 1, 0, 0), ("steak_house", 0, 2, 1), ("bakery", 2, 2, 0), (None, 0, 0, 1), ("hotel", 0, 0, 0)], "t string, f int, d int, k int")
    got = df.select(cuisine(F.col("t")), venue_kind(F.col("t")), preferred_category(F.col("t"), F.col("f"), F.col("d"), F.col("k"))).collect()
    assert [tuple(r) for r in got] == [("Mexican & Latin", "restaurant", "food"), ("American & Burgers", "restaurant", "dessert"), ("Sweets & Treats", "dessert", "dessert"), ("Other", "restaurant", "drink"), ("Other", "restaurant", "food")]

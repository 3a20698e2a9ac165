"""Section words, marks and white space as web pages hold them; attribute enums; random samples."""

from pyspark.sql import functions as F

from larkspur.functions.documents import menu_signals
from larkspur.functions.text import squeezed, url_tokens
from larkspur.operators.locate import sibling_drops
from larkspur.operators.site_rules import daypart_probes, random_rows, request_errors
from larkspur.operators.validate import ENUMS


def test_menu_sections_are_no_other_places(spark):
    base, address = "https://x.example/", "1 Main St, Winter Park, FL 32789, USA"
    urls = [base + "winter-park"] + [base + w for w in ("pizza", "order", "sides", "sushi", "cafe", "maitland")]
    rows = spark.createDataFrame([(1, u, address) for u in urls], "r long, url string, address string")
    assert [r.url for r in sibling_drops(rows, "r").collect()] == [base + "maitland"]


def test_the_structured_menu_mark_is_no_token(spark):
    rows = spark.createDataFrame([("https://x.example/winter-park#structured-menu",), ("https://x.example/a#Menu",)], "u string")
    assert [r.t for r in rows.select(url_tokens(F.col("u")).alias("t")).collect()] == [["winter", "park"], ["a", "menu"]]


def test_white_space_of_web_pages(spark):
    text = "Soup\xa0 $4\n\t\n\xa0\nBread  Oil \x85"
    signals = menu_signals(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(squeezed(F.col("t")).alias("s"), signals["lines"].alias("n"), signals["short_lines"].alias("k")).first()
    assert row.s == " ".join(text.split())
    assert row.n == len([x for x in text.splitlines() if x.strip()]) and row.k == 3


def test_dish_formats_are_checked():
    assert len(ENUMS["dish_format"]) == 40 and "unclear" not in ENUMS["dish_format"]


def test_probes_requests_and_samples(spark):
    pages = spark.createDataFrame([(1, "https://www.a.example/menu/", 0), (1, "http://a.example/menu/wine", 1), (2, None, 2), (3, "https://b.example/about", 3)], "r long, url string, o long")
    got = [r.url for r in daypart_probes(pages, "r", "url", "o").orderBy("place").collect()]
    assert got == ["http://a.example/menu/" + w for w in ("dinner", "lunch", "brunch", "breakfast", "happy-hour", "wine", "dessert", "desserts", "drinks") if w != "wine"]
    rows = spark.createDataFrame([([1], None), ([], None), (None, 0), (None, None), ([1, None], 3)], "ids array<long>, days int")
    assert [r.e for r in rows.select(request_errors(F.col("ids"), F.col("days")).alias("e")).collect()] == [None, "restaurant_ids", "stale_days", None, "restaurant_ids"]
    some = random_rows(spark.range(50).withColumn("__random", F.lit(1)), 20, 3)
    assert some.columns == ["id", "__random"] and some.distinct().count() == 20

"""Kept pages against a plain loop over them, and the cases of a finished crawl."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators.finish import chosen_pages, finished, keep_pages


def plain(rows, least, most):
    kept, total = [], 0
    for _, page, text in sorted(rows):
        if text is None or len(text) < least or any(text in t or t in text for _, t in kept) or (kept and total + len(text) > most):
            continue
        kept.append((page, text))
        total += len(text)
    return kept


@pytest.mark.parametrize("size", [1, 3, 50])
def test_choice_equals_a_plain_loop(spark, size):
    rnd = random.Random(size)
    base = "".join(rnd.choice("abcd") for _ in range(300))
    rows = []
    for key in ("x", "y", None):
        for i in range(60):
            a = rnd.randint(0, 280)
            text = rnd.choice([base[a : a + rnd.randint(1, 40)], "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 30))), None, base])
            rows.append((key, rnd.random(), f"p{i}", text))
    df = spark.createDataFrame(rows, "key string, o double, page string, text string").repartition(5)
    got = {r.key: [tuple(k) for k in r.kept] for r in chosen_pages(df, "key", "page", "text", [F.col("o")], 8, 150, size).collect()}
    assert got == {key: plain([(o, p, t) for k, o, p, t in rows if k == key], 8, 150) for key in ("x", "y", None)}
    assert chosen_pages(df.limit(0), "key", "page", "text", [F.col("o")]).count() == 0


def test_a_hot_key_of_copies(spark):
    rows = [("x", f"p{i:04d}", ("same text " * 30) if i % 3 else ("other %04d " % i) * 40, 0.9 - i / 10_000, True) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, page string, text string, score double, is_menu boolean")
    got = [r.page for r in keep_pages(df, "k", 200, 5000).orderBy("place").collect()]
    assert got == [p for p, _ in plain([(-s, p, t) for _, p, t, s, _ in rows], 200, 5000)]


def crawl(spark, pages, landing="https://r.example/"):
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pages)], "site int, place int, url string, text string, score double, prices int, sections int, is_menu boolean")
    return finished(df, spark.createDataFrame([(1, landing)], "site int, landing string"), "site").first()


def test_finished(spark):
    t = lambda c, n=300: c * n
    home = ("https://www.r.example", t("h"), 0.5, 0, 1, True)
    toast, dash = ("https://www.toasttab.com/r", t("t"), 0.9, 20, 3, True), ("https://www.doordash.com/r", t("d"), 0.8, 30, 3, True)
    r = crawl(spark, [home, toast, dash, ("https://order.toasttab.com/r2", t("u"), 0.6, 3, 0, True), ("https://www.toasttab.com/r", "later", 1.0, 9, 9, True)])
    assert (r.status, r.best_url, r.urls) == ("ok", toast[0], [toast[0], "https://order.toasttab.com/r2"])
    assert r.text == f"[page: {toast[0]}]\n{toast[1]}\n\n[page: https://order.toasttab.com/r2]\n{t('u')}" and r.content_hash is not None
    # a landing page with sections stays, and so does one beside no strong page
    assert crawl(spark, [(*home[:4], 2, True), toast]).urls == [toast[0], home[0]]
    assert crawl(spark, [home, (toast[0], t("t"), 0.7, 20, 3, True)]).urls == [toast[0], home[0]]
    # platforms with few prices prefer nothing
    assert crawl(spark, [(toast[0], t("t"), 0.9, 7, 3, True), (dash[0], t("d"), 0.8, 7, 3, True)]).urls == [toast[0], dash[0]]
    r = crawl(spark, [("https://r.example/a", "short", 0.9, 9, 9, True), home])
    assert (r.status, r.urls, r.text) == ("too_little_text", None, "short")
    r = crawl(spark, [("https://r.example/a", t("x"), 0.3, 0, 0, False), ("https://r.example/b", None, 0.1, 0, 0, False)])
    assert (r.status, r.best_url, r.urls, r.content_hash) == ("no_menu", "https://r.example/a", None, None)
    r = crawl(spark, [("https://r.example/a", "[structured-menu products=9 categories=2]" + t("x"), 0.9, 0, 0, True), ("https://r.example/b", t("x", 250), 0.8, 0, 0, True)])
    assert (r.urls, r.products, r.categories) == (["https://r.example/a"], 9, 2)

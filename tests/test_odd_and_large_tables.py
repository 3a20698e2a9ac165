"""Queries against their SQL on rows that the test tables lack, and operators on many rows of one place."""

import time

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import finish
from larkspur.operators.community import reattached_prices
from larkspur.plans.all import QUERIES, SQL
from larkspur.sources.tables import settled


def same_as_sql(spark, folder, query, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS FROM '{folder}/{name}.parquet'")
    got, want = QUERIES[query](spark, str(folder)), con.sql(SQL[query])
    found = sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect())))
    assert found == sorted(map(repr, want.fetchall()))
    return found


def test_references_without_a_semicolon(spark, tmp_path):
    html = ["<h1>des&amp</h1><p>a &lt b &amp; c&amp;lt; &&&amp", "<p>AT&amp;T</p>x&gt", None]
    assert len(same_as_sql(spark, tmp_path, "q_html_text", pages={"page_id": [1, 2, 3], "html": html})) == 3


def test_single_characters_by_chance(spark, tmp_path):
    text = ["a line\nE y o a u e ou\nb", "1 2 3 4 5 6 7\nx y z\n\nspread letters", "a b c", "", None]
    assert len(same_as_sql(spark, tmp_path, "q_letters_joined", documents={"doc_id": [1, 2, 3, 4, 5], "text": text})) == 4


def test_prices_of_one_place(spark):
    """Texts and prices in the same place meet others once: 100,000 boxes of one page are no 2,500,000,000 pairs."""
    rows = spark.range(100_000).selectExpr("0 AS page", "id", "if(id % 2 = 0, 'text', 'price') AS kind", "if(id % 2 = 0, 1, 5) AS left", "id % 4 AS top", "id % 4 + 20 AS bottom", "cast(id AS string) AS value")
    start = time.monotonic()
    got = reattached_prices(rows).groupBy("line", F.expr("price_id % 4").alias("k"), F.expr("price = price_id").alias("own")).count().collect()
    assert sorted(map(tuple, got)) == [("0", 1, True, 25_000), ("2", 3, True, 25_000)]
    assert time.monotonic() - start < 60


def optimized(df, capsys) -> str:
    df.explain("extended")
    return capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


@pytest.mark.parametrize(("name", "step"), [("q_protein_breakfasts", "translate(lower("), ("q_script_menus", "[^A-Za-z0-9]+"), ("q_ld_menus", "[^A-Za-z0-9]+"), ("q_state_menus", "[^A-Za-z0-9]+"), ("q_script_calls", "([A-Za-z]+)")])
def test_dear_steps_stand_once(spark, capsys, name, step):
    """A projection's expressions are written again into every filter and column that reads them."""
    assert optimized(QUERIES[name](spark, "/root/testdata/sf0.001"), capsys).count(step) == 1


def test_pages_are_scored_once(spark, capsys, monkeypatch):
    plans = []
    monkeypatch.setattr(finish, "settled", lambda df: plans.append(optimized(df, capsys)) or settled(df))
    QUERIES["q_keep_pages"](spark, "/root/testdata/sf0.001")
    assert [p.count("[-–—]") for p in plans] == [1] + [0] * (len(plans) - 1)


@pytest.mark.parametrize("name", ["q_menu_links", "q_state_menus", "q_serialized_links", "q_unescaped", "q_html_text"])
def test_long_texts_go_to_python_by_the_hundred(spark, capsys, name):
    """Batches of ten thousand rows hold addresses at most."""
    plan = optimized(QUERIES[name](spark, "/root/testdata/sf0.001"), capsys)
    assert "BatchEvalPython" in plan and plan.count("ArrowEvalPython") == plan.count("ArrowEvalPython [joined(")

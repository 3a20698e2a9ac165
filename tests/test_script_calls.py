"""Script calls: what the pattern of a whole call says against reading step by step, and pages with many items."""

import random
import re

from larkspur.operators import script_calls
from larkspur.operators.script_calls import CALL, NAME_AT, PRICE_AT, TEXT_AT, call_arguments, call_items, calls, script_call_items

PARTS = [f"{CALL}(", f"{CALL}(1, 2, 'a', 3, 'b')", f"my{CALL}(", ";", " ;", ",", ",", ",", "(", ")", ")", "[", "]", "{", "}", "'", '"', "`", "\\", "\\'", "\\u00f1", "\\ud83d", "&amp;", "x", "2.5", "$", "\n", "é", "'n'", '"m"', " " * 199, " " * 200, "([{", "}])", "((((", "))))"]


def step_by_step(page):
    out, at = [], 0
    while m := re.compile(rf"(?<![\w$]){re.escape(CALL)}\(").search(page, at):
        call = call_arguments(page, m.end())
        at = call[1] if call else m.end()
        if call and len(call[0]) > TEXT_AT and re.match(r"\s*;", page[at : at + 200]):
            out.append(tuple(call[0][i] for i in (NAME_AT, PRICE_AT, TEXT_AT)))
    return out


def test_pattern_says_what_steps_say():
    rnd, found = random.Random(4), 0
    for _ in range(6_000):
        head = f"{CALL}(1, [2], {''.join(rnd.choices(PARTS[3:], k=4))}, 3.5, {''.join(rnd.choices(PARTS[3:], k=4))}) ;" if rnd.random() < 0.5 else ""
        page = head + "".join(rnd.choices(PARTS, k=rnd.choice([8, 30, 90])))
        want = step_by_step(page)
        assert [tuple(a.strip() for a in call) for call in calls(page)] == want, page
        found += len(want)
    assert found > 300
    deep = f"{CALL}(0, [[[[1, ')']]]], 'deep', 2, 'x', f(g(h(i(1))))); "
    assert call_items(deep * 2 + f"{CALL}(1, 2, 'b', 3, '')  ;") == [("deep", "x", "$2.00"), ("b", "", "$3.00")]


def test_ordinary_calls_are_read_by_one_match(monkeypatch):
    """The reader by steps took most of the time of ``q_script_calls``."""
    monkeypatch.setattr(script_calls, "call_arguments", None)
    page = f"""{CALL}(0, [1, "a)"], "It, \\"hot\\" (1)", 2.5, "n\\u00f1o", f(2, {{a: 1}})) ;{CALL}(1, 2, "few", 3);"""
    assert call_items(page) == [('It, "hot" (1)', "nño", "$2.50")]


def test_pages_of_many_items(spark):
    """Items leave a task before all of its pages are read, each with its own page's columns."""
    page = "".join(f"{CALL}(0, 0, 'i{k}', 1, '{'x' * (k % 3)}');" for k in range(7_000))
    rows = spark.createDataFrame([(1, "a", page), (2, None, ""), (3, None, page), (None, "d", page + "x"), (5, "e", None)], "id int, own string, html string").coalesce(1)
    got = script_call_items(rows, keep=("own", "id"))
    assert got.dtypes == [("own", "string"), ("id", "int"), ("place", "int"), ("name", "string"), ("description", "string"), ("price", "string")]
    want = [(own, i, k, f"i{k}", "x" * (k % 3), "$1.00") for own, i in (("a", 1), (None, 3), ("d", None)) for k in range(7_000)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))

"""Keyed state: the location filter and the cooldown as streams, as batches and in plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspur.operators.locate import sibling_drops
from larkspur.streaming import urls as url_streams
from larkspur.streaming.providers import cooldown_changes, cooldowns, known_answers, limit_error
from larkspur.streaming.urls import filtered_batches, filtered_stream, judged

SCHEMA = "record long, batch int, place int, url string, address string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOMES = ["10 N Park Ave, Winter Park, FL 32789, USA", "3201 Corrine Dr, Orlando, FL 32803, USA", None, "7 Main St, Maitland, FL 32751, USA"]


def crawls():
    rnd = random.Random(4)
    words = ["winter-park", "winterpark", "winter-garden", "daytona-beach", "orlando", "maitland", "corrine", "dinner", "locations/tampa", "locations/winter-park", "3201-corrine-dr", "77-oak-st", "10-park-avenue", "3201", "park", "lake-mary-florida-usa-x"]
    shapes = ["https://a.example/{}", "https://a.example/{}/menu", "https://b.example/Menus-{}.pdf", "https://a.example/x/{}/dinner?y=1"]
    rows = []
    for record in range(12):
        for batch in range(3):
            found = [rnd.choice(shapes).format(rnd.choice(words)) for _ in range(rnd.randint(0, 9))]
            rows += [(record, batch, k, u, HOMES[record % 4]) for k, u in enumerate(found)]
    return rows


def plain(rows, most):
    """Batch after batch, every address against every one seen so far."""
    def differing(a, b):
        head = 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return a[head : len(a) - tail], b[head : len(b) - tail]

    def names(span, r):
        return bool(span) and (set(span) in (set(r["city"].split()), set(r["street"].split())) or (len(set(span)) == 1 and span[0] in (r["city"].replace(" ", ""), r["number"])))

    out, anchored, observed = [], {}, {}
    batches = sorted({(r["record"], r["batch"]) for r in rows})
    for key in batches:
        now = sorted((r for r in rows if (r["record"], r["batch"]) == key), key=lambda r: (r["place"], r["url"]))
        seen = observed.setdefault(key[0], [])
        if not now[0]["known"]:
            out += [(*key, r["place"], r["url"]) for r in now]
            continue
        gone = set()
        for a in seen + now:
            for b in now:
                x, y = differing(a["tokens"].split(), b["tokens"].split())
                if a["host"] == b["host"] and 1 <= len(x) <= 4 and 1 <= len(y) <= 4 and names(x, now[0]) and not names(y, now[0]) and not set(y) & set(url_streams.SECTION_WORDS):
                    gone.add(b["url"])
        kept = [r for r in now if r["url"] not in gone]
        anchored[key[0]] = anchored.get(key[0], False) or any(r["strong"] for r in kept)
        if anchored[key[0]]:
            kept = [r for r in kept if r["plausible"] or not r["specific"]]
        if len(seen) < most:
            for r in kept:
                if r["url"] not in [s["url"] for s in seen]:
                    seen.append(r)
        out += [(*key, r["place"], r["url"]) for r in kept]
    return sorted(out)


def stream(spark, tmp_path, batches, f):
    """The rows of ``f`` over a stream of one micro-batch for each of the frames."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    seen = []
    try:
        for k, df in enumerate(batches):
            df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
            query = f(source).writeStream.outputMode("append").foreachBatch(lambda out, _: seen.extend(map(tuple, out.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return sorted(seen)


def test_location_filter(spark, tmp_path):
    rows = crawls()
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain([r.asDict() for r in judged(df).collect()], url_streams.MOST_OBSERVED)
    assert 0 < len(want) < len(rows)
    assert sorted(map(tuple, filtered_batches(df.repartition(3)).collect())) == want
    assert stream(spark, tmp_path, [df.where(F.col("batch") == b) for b in range(3)], filtered_stream) == want
    # what an earlier batch held counts later
    late = [r for r in rows if r[1] == 2]
    assert sorted(map(tuple, filtered_batches(spark.createDataFrame(late, SCHEMA)).collect())) != [w for w in want if w[1] == 2]


def test_odd_crawls(spark):
    assert filtered_batches(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, 0, 0, "https://a.example/winter-park", HOMES[0]), (None, 1, 0, "https://a.example/tampa", HOMES[0]), (1, 0, 0, None, HOMES[0]), (1, 0, 1, "junk", HOMES[0]), (2, 0, 0, "https://a.example/tampa", "")]
    got = sorted(map(tuple, filtered_batches(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [(1, 0, 1, "junk"), (2, 0, 0, "https://a.example/tampa"), (None, 0, 0, "https://a.example/winter-park")]


def test_siblings_meet_by_what_is_around_the_place(spark):
    df = spark.createDataFrame(crawls(), SCHEMA).select("record", "url", "address")
    rows = [r.asDict() for r in judged(spark.createDataFrame([(*r[:1], 0, *r[2:]) for r in crawls()], SCHEMA)).collect()]
    for r in rows:
        r["strong"], r["specific"] = False, False
    kept = {(r, u) for r, _, _, u in plain(rows, 10**9)}
    assert {(r.record, r.url) for r in sibling_drops(df, "record").collect()} == {(r["record"], r["url"]) for r in rows} - kept


def test_cooldowns(spark, tmp_path):
    t, rnd = datetime(2024, 1, 1), random.Random(2)
    said = ["429 Too Many Requests", "Rate-limit", "boom", None, "insufficient credit", "code 4290", "Overloaded!"]
    calls = sorted((rnd.choice("ab"), t + timedelta(seconds=rnd.randint(0, 40_000)), rnd.choice(said)) for _ in range(120))
    calls += [("c", t, said[0]), ("c", t + timedelta(seconds=1200), said[0]), ("c", t + timedelta(seconds=2399), said[1])]
    df = spark.createDataFrame(calls, "provider string, ts timestamp, error string")
    rests = []
    for name in "abc":
        until = None
        for ts in sorted(c[1] for c in calls if c[0] == name and c[2] in (said[0], said[1], said[4], said[6])):
            if until is None or ts >= until:
                rests.append([name, ts, None])
            until = ts + timedelta(seconds=1200)
            rests[-1][2] = until
    assert sorted(map(tuple, cooldowns(df).collect())) == sorted(map(tuple, rests)) and len(rests) > 6
    # by event time: three micro-batches, and a last one whose late time lets all timers expire
    cut = [t + timedelta(seconds=s) for s in (15_000, 30_000, 10**6)]
    parts = [df.where((F.col("ts") < F.lit(b)) & (F.col("ts") >= F.lit(a))) for a, b in zip([t, *cut], cut, strict=False)]
    parts += [spark.createDataFrame([("z", t + timedelta(days=9 + k), said[0])], df.schema) for k in range(2)]
    got = [x for x in stream(spark, tmp_path, parts, cooldown_changes) if x[0] != "z"]
    assert got == sorted([(n, "limited", a) for n, a, _ in rests] + [(n, "ready", b) for n, _, b in rests])


def test_answers_hold(spark):
    t = datetime(2024, 1, 1)
    rows = [("a", t, True), ("a", t + timedelta(seconds=299), False), ("a", t + timedelta(seconds=300), False), ("a", t + timedelta(seconds=599), True), ("a", t + timedelta(seconds=601), True), ("b", t, False), (None, t, True), ("b", None, True)]
    got = known_answers(spark.createDataFrame(rows, "provider string, ts timestamp, available boolean")).orderBy("provider", "ts").collect()
    assert [(r.provider, r.asked, r.available) for r in got] == [(None, True, True), ("a", True, True), ("a", False, True), ("a", True, False), ("a", False, False), ("a", True, True), ("b", True, False)]


@pytest.mark.parametrize(("said", "limit"), [("HTTP 429", True), ("x4290", False), ("insufficient  credits", True), ("insufficient account credit", False), ("limit reached", True), ("limit", False), (None, False)])
def test_limit_errors(spark, said, limit):
    assert spark.createDataFrame([(said,)], "e string").select(limit_error(F.col("e"))).first()[0] is limit

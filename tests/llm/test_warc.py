import io
import random
import re

import duckdb
import pytest

from larkspur.llm.common import new_path
from larkspur.llm.warc import OP2_SQL, WarcError, digest_text, read_records, read_warc, record_bytes, write_warc


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", rng.choice(["<p>é</p>" * rng.randint(0, 9), "same", "\r\n\r\n", "x" * 300_000])) for i in range(120)]
    rows += [(500, None, None), (501, "http://a b/\r\nX: y", ""), (None, "u", "same"), (502, "v", "only \x00 this")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = new_path(spark, "warc")
    names = write_warc(pages, out)
    got = read_warc(spark, out, names).collect()
    assert len(got) == len(rows)
    holder = {}
    for page, _, html in rows:
        holder[html or ""] = max(holder.get(html or "", -1), -1 if page is None else page)
    for page, url, html in rows:
        data = (html or "").encode()
        (r,) = [r for r in got if r.page_id == page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), digest_text(data))
        if page == holder[html or ""]:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, data)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", holder[html or ""], None)
    assert {r.url for r in got if r.page_id in (500, 501)} == {None, "http://a%20b/%0D%0AX:%20y"}


def test_sql(spark):
    rows = [(i, "u", ["a", "bé", "", None, "a"][i % 5] if i < 20 else f"own {i}") for i in range(40)]
    out = new_path(spark, "warc")
    got = read_warc(spark, out, write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), out), with_payload=False)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.sql(OP2_SQL)
    assert want.columns == got.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_nothing(spark):
    out = new_path(spark, "warc")
    assert read_warc(spark, out, write_warc(spark.createDataFrame([], "page_id long, url string, html string"), out)).count() == 0


def test_damage_is_found():
    good = record_bytes(1, "u", b"hello" * 1000, None, False, "d") + record_bytes(2, "u", b"", 1, True, "d")
    assert [r.payload for r in read_records(io.BytesIO(good))] == [b"hello" * 1000, b""]
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(good[:-5])))
    with pytest.raises(WarcError):
        list(read_records(io.BytesIO(good[:40] + bytes([good[40] ^ 1]) + good[41:])))
    import gzip

    plain = gzip.decompress(record_bytes(1, "u", b"hello", None, False, "d"))
    for bad in (plain.replace(b"hello", b"jello"), plain.replace(b"hello", b"hell"), plain[:-2], plain.replace(b"WARC/1.1", b"HTTP/1.1", 1), re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"X: 1\r\n\r\nHTTP", plain)):
        with pytest.raises(WarcError):
            list(read_records(io.BytesIO(gzip.compress(bad))))

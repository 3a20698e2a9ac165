"""WARC archives: a writer of one gzip member per record, and a sequential reader.

The reader decompresses member by member in bounded pieces, takes each record's block by its
Content-Length, and verifies the block and payload digests.  A page whose payload another page holds
already is a revisit record: it carries the HTTP header alone and refers to that page's record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Files, new_path, table

_END = b"\r\n\r\n"
_PIECE = 1 << 16
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_text(data: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page) -> str:
    return f"<urn:larkspur:page:{'none' if page is None else page}>"


def _page_of(record_id: str | None) -> int | None:
    page = record_id.rpartition(":")[2].rstrip(">") if record_id else "none"
    return None if page == "none" else int(page)


def record_bytes(page, url: str | None, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page)}", f"WARC-Date: {date}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if revisit:
        lines += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest_text(payload)}", f"WARC-Block-Digest: sha1:{digest_text(block)}", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return pack.compress(head + _END) + pack.compress(block) + pack.compress(_END) + pack.flush()


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> list[str]:
    """Write one record per row of ``pages`` below ``out``; return the archives' names.

    Of rows with equal payloads (null counts as empty), those with the largest id are response records,
    the others revisit it; without any id in the group all are response.  Rows with a null id in a group
    that has ids revisit too.  Archives appear under their final name only when whole.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("sha"))
    holders = rows.groupBy("sha").agg(F.max("page").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").select("sha", "holder")
    joined = rows.join(holders, "sha", "left").select("page", "url", "html", "holder")

    def write(batches):
        name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", 0

        def records():
            nonlocal n
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for r in batch.slice(at, 64).to_pylist():
                        n += 1
                        revisit = r["holder"] is not None and r["page"] != r["holder"]
                        yield record_bytes(r["page"], r["url"], r["html"].encode("utf-8", "surrogatepass"), r["holder"], revisit, date)

        Files(out).write(name, records())
        yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    made = joined.mapInArrow(write, "name string, n long").collect()  # a row an archive
    return sorted(r["name"] for r in made if r["n"])


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes


class WarcError(ValueError):
    pass


def _members(stream):
    """The decompressed pieces of each gzip member, as one iterator a member."""
    rest = stream.read(_PIECE)
    while rest:
        unpack, state = zlib.decompressobj(31), {"rest": rest}

        def pieces(unpack=unpack, state=state):
            data = state["rest"]
            while not unpack.eof:
                if not data and not (data := stream.read(_PIECE)):
                    raise WarcError("the archive ends inside a record")
                try:
                    out = unpack.decompress(data, _PIECE)
                except zlib.error as e:
                    raise WarcError(f"damaged member: {e}") from None
                data = unpack.unconsumed_tail
                if out:
                    yield out
            state["rest"] = unpack.unused_data or stream.read(_PIECE)

        yield pieces()
        rest = state["rest"]


def read_records(stream):
    """Each record of an archive, in order; WarcError where framing or a digest is wrong."""
    for member in _members(stream):
        head = bytearray()
        while (cut := head.find(_END)) < 0:
            piece = next(member, None)
            if piece is None:
                raise WarcError("a record without an end of its header")
            head += piece
        version, *fields = head[:cut].decode("utf-8", "surrogatepass").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a record: {version[:20]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (f.partition(":") for f in fields)}
        size = int(headers.get("content-length", -1))
        if size < 0:
            raise WarcError("a record without Content-Length")
        body = bytearray(head[cut + len(_END) :])
        for piece in member:
            body += piece
            if len(body) > size + len(_END):
                break
        if len(body) != size + len(_END) or body[size:] != _END:
            raise WarcError(f"a block of {len(body) - len(_END)} bytes or more where {size} were said")
        _verify(headers.get("warc-block-digest"), digest_text(body[:size]), "block")
        http, _, payload = bytes(body[:size]).partition(_END)
        if headers.get("warc-type") != "revisit":
            _verify(headers.get("warc-payload-digest"), digest_text(payload), "payload")
        yield Record(headers, http, payload)


def _verify(said: str | None, found: str, what: str) -> None:
    if said is not None and said != f"sha1:{found}":
        raise WarcError(f"the {what} digest is {found}, not {said}")


def read_warc(spark: SparkSession, out: str, names: list[str], with_payload: bool = True) -> DataFrame:
    """A row per record of the named archives below ``out``: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url and, if asked for, payload (null in revisits)."""
    import pyarrow as pa

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * with_payload

    def row(r: Record) -> dict:
        h, revisit = r.headers, r.headers["warc-type"] == "revisit"
        said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", r.http)
        found = {
            "page_id": _page_of(h["warc-record-id"]), "payload_bytes": int(said[1]) if revisit else len(r.payload), "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": h["warc-type"], "refers_to": _page_of(h.get("warc-refers-to")), "url": h.get("warc-target-uri"),
        }
        return found | ({"payload": None if revisit else r.payload} if with_payload else {})

    def read(batches):
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), *([("payload", pa.binary())] if with_payload else [])])
        files = Files(out)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with files.open(name) as stream:
                    for r in read_records(stream):
                        held.append(row(r))
                        size += len(r.payload)
                        if len(held) >= 2000 or size > 1 << 24:
                            yield pa.RecordBatch.from_pylist(held, kinds)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, kinds)

    if not names:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([(n,) for n in names], "name string").repartition(len(names)).mapInArrow(read, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of all pages, read back from the archives that
    were written of them; a null page has an empty payload, and pages of equal payload revisit the largest id."""
    out = new_path(spark, "warc")
    return read_warc(spark, out, write_warc(table(spark, sf_dir, "pages"), out), with_payload=False)


OP2_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT html, max(page_id) AS holder FROM p GROUP BY html),
b AS (SELECT p.page_id, p.url, octet_length(encode(p.html)) AS payload_bytes, h.holder,
  list_transform(range(0, 40), lambda i: strpos('0123456789abcdef', substr(sha1(p.html), i + 1, 1)) - 1) AS x
  FROM p JOIN h ON p.html = h.html)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda g: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_sum(list_transform(range(g * 5, g * 5 + 5), lambda b: ((x[b // 4 + 1] >> (3 - b % 4)) & 1) << (4 - (b - g * 5)))) AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder OR holder IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder OR holder IS NULL THEN NULL ELSE holder END AS refers_to,
  url
FROM b
"""

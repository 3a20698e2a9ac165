"""A location filter over a crawl that finds addresses in several batches.

What a batch finds is judged with what earlier batches kept: once any address strongly names the record's own
place, location pages of other places go, then and later; and a page that differs from one of the record's own, seen
in any batch up to now, in nothing but the place goes too.  Both forms below run the same step: the stream keeps its
state by record, the batch form goes through sorted partitions and holds one batch of one record at a time.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.text import url_tokens
from ..operators.locate import SECTION_WORDS, address_parts, location_specific, plausible_match, strong_match

# --- fixed values ------------------------------------------------------------------------------------------
MOST_OBSERVED, LONGEST_SPAN = 300, 4
# ------------------------------------------------------------------------------------------------------------
_SECTIONS = frozenset(SECTION_WORDS)
_FIELDS = ("url", "host", "tokens", "number", "street", "city", "known", "strong", "plausible", "specific")


def judged(urls: DataFrame, record: str = "record", batch: str = "batch", place: str = "place", url: str = "url", address: str = "address") -> DataFrame:
    """``record, batch, place, url`` with all that the step asks of an address, worked out by columns."""
    parts, u = address_parts(F.col(address)), F.col(url)
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    known = F.coalesce((F.size(parts["street"]) > 0) | (F.size(parts["city"]) > 0) | parts["number"].isNotNull(), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return urls.select(
        F.col(record).alias("record"), F.col(batch).alias("batch"), F.col(place).alias("place"), u.alias("url"), host.alias("host"), F.array_join(url_tokens(u), " ").alias("tokens"), F.coalesce(parts["number"], F.lit("")).alias("number"),
        F.array_join(F.coalesce(parts["street"], F.array().cast("array<string>")), " ").alias("street"), F.array_join(F.coalesce(parts["city"], F.array().cast("array<string>")), " ").alias("city"), known.alias("known"),
        flag(strong_match(u, parts)).alias("strong"), flag(plausible_match(u, parts)).alias("plausible"), flag(location_specific(u)).alias("specific"),
    )


class Crawl:
    """One record's state: whether an address named its place, and the addresses kept so far (url to host and tokens)."""

    def __init__(self, anchored: bool = False, observed: dict[str, tuple[str, str]] | None = None):
        self.anchored, self.observed = anchored, observed or {}

    def step(self, rows: list[dict]) -> list[dict]:
        """The rows of a batch that stay."""
        if not rows or not rows[0]["known"]:
            return rows
        place = {k: rows[0][k] for k in ("number", "street", "city")}
        own: dict[tuple, set] = {}
        for host, tokens in dict.fromkeys([*self.observed.values(), *((r["host"], r["tokens"]) for r in rows)]):
            for head, span, tail in _spans(tokens):
                if _names(span, place):
                    own.setdefault((host, head, tail), set()).add((span[0], span[-1]))
        kept = [r for r in rows if not _sibling(r, own, place)]
        self.anchored = self.anchored or any(r["strong"] for r in kept)
        if self.anchored:
            kept = [r for r in kept if r["plausible"] or not r["specific"]]
        if len(self.observed) < MOST_OBSERVED:
            for r in kept:
                self.observed.setdefault(r["url"], (r["host"], r["tokens"]))
        return kept


def _spans(tokens: str):
    """(what is before, the span, what is after) of each short span of tokens."""
    words = tuple(tokens.split())
    for i in range(len(words)):
        for j in range(i + 1, min(i + LONGEST_SPAN, len(words)) + 1):
            yield words[:i], words[i:j], words[j:]


def _names(span: tuple[str, ...], place: dict[str, str]) -> bool:
    """Whether a span is the record's city, street or number and nothing else."""
    said = set(span)
    if said in (set(place["city"].split()), set(place["street"].split())):
        return True
    return len(said) == 1 and span[0] in (place["city"].replace(" ", ""), place["number"])


def _sibling(row: dict, own: dict[tuple, set], place: dict[str, str]) -> bool:
    """Whether an address has another place where one of the record's own has its place."""
    return any(
        any(a != span[0] and b != span[-1] for a, b in own.get((row["host"], head, tail), ())) and not _names(span, place) and _SECTIONS.isdisjoint(span) for head, span, tail in _spans(row["tokens"])
    )


def _rows(frame) -> list[dict]:
    return frame.to_dict("records")


def filtered_batches(urls: DataFrame, record: str = "record", batch: str = "batch", place: str = "place", url: str = "url", address: str = "address") -> DataFrame:
    """(record, batch, place, url) of the addresses that stay, batch after batch of each record.  Records without an
    address keep all.  Null records are one record; null urls go."""
    rows = judged(urls, record, batch, place, url, address).where("url IS NOT NULL")
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("record", "batch", "place", "url"))

    def run(frames):
        import pandas as pd

        state, at, held, out = Crawl(), None, [], []

        def close():
            out.extend((r["record"], r["batch"], r["place"], r["url"]) for r in state.step(held))

        for frame in frames:
            for r in _rows(frame):
                key = (None if pd.isna(r["record"]) else r["record"], r["batch"])
                if key != at:
                    close()
                    if at is None or key[0] != at[0]:
                        state = Crawl()
                    at, held = key, []
                held.append(r)
            yield pd.DataFrame(out, columns=["record", "batch", "place", "url"])
            out = []
        close()
        yield pd.DataFrame(out, columns=["record", "batch", "place", "url"])

    return rows.repartition("record").sortWithinPartitions("record", "batch", "place", "url").mapInPandas(run, kind)


class _Filter(StatefulProcessor):
    def init(self, handle) -> None:
        self.anchored = handle.getValueState("anchored", "anchored boolean")
        self.observed = handle.getListState("observed", "url string, host string, tokens string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        import pandas as pd

        before = list(self.observed.get())
        state = Crawl(self.anchored.exists() and bool(self.anchored.get()[0]), {u: (h, t) for u, h, t in before})
        arrived = sorted((r for frame in rows for r in _rows(frame)), key=itemgetter("batch", "place", "url"))
        kept = [r for _, batch in groupby(arrived, key=itemgetter("batch")) for r in state.step(list(batch))]
        self.anchored.update((state.anchored,))
        for u, (h, t) in list(state.observed.items())[len(before) :]:
            self.observed.appendValue((u, h, t))
        yield pd.DataFrame({"record": [key[0]] * len(kept), **{c: [r[c] for r in kept] for c in ("batch", "place", "url")}}, dtype=object)

    def close(self) -> None:
        pass


def filtered_stream(urls: DataFrame, record: str = "record", batch: str = "batch", place: str = "place", url: str = "url", address: str = "address") -> DataFrame:
    """The same over a stream, whose batches of a record must arrive in order, each within one micro-batch.  Needs the
    RocksDB state store (``spark.sql.streaming.stateStore.providerClass``)."""
    rows = judged(urls, record, batch, place, url, address).where("url IS NOT NULL")
    kind = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("record", "batch", "place", "url"))
    return rows.groupBy("record").transformWithStateInPandas(_Filter(), kind, "Append", "None")

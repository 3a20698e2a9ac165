"""Providers that answer with a limit error rest for a while; whether one is there is asked again only after a while."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# --- fixed values: what limit errors say, and for how long they and answers hold --------------------------------
LIMIT_ERROR = r"(?i)rate.?limit|usage limit|limit (?:reached|exceeded)|quota|too many requests|\b429\b|insufficient.{0,8}credit|out of credits|overloaded"
COOLDOWN_SECONDS, ANSWER_SECONDS = 20 * 60, 300
# ------------------------------------------------------------------------------------------------------------------


def limit_error(error: Column) -> Column:
    return F.coalesce(error.rlike(LIMIT_ERROR), F.lit(False))


def cooldowns(calls: DataFrame, provider: str = "provider", at: str = "ts", error: str = "error", seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """(provider, limited_at, ready_at): each rest begins with a limit error while the provider is ready and ends so many seconds
    after the last limit error in it.  Calls without a time or a limit error do not count."""
    limited = calls.where(limit_error(F.col(error)) & F.col(at).isNotNull())
    # a session takes in what comes at its very end, a rest does not
    rests = limited.groupBy(F.col(provider).alias("provider"), F.session_window(at, f"{seconds * 1_000_000 - 1} microseconds").alias("w")).agg(F.count("*").alias("errors"))
    return rests.select("provider", F.col("w.start").alias("limited_at"), (F.col("w.end") + F.expr("INTERVAL 0.000001 SECOND")).alias("ready_at"))


def known_answers(probes: DataFrame, provider: str = "provider", at: str = "ts", value: str = "available", seconds: int = ANSWER_SECONDS) -> DataFrame:
    """(provider, ts, asked, available): each request for a provider's state, whether it was asked anew, and the answer in
    use: one that was asked for holds for so many seconds.  Of equal times the first by value counts; null times go."""
    rows = probes.select(F.col(provider).alias("provider"), F.col(at).alias("ts"), F.col(value).alias("available")).where("ts IS NOT NULL")

    def run(frames):
        import pandas as pd

        own, since, answer = None, None, None
        for frame in frames:
            out = []
            for name, ts, available in zip(frame["provider"], frame["ts"], frame["available"], strict=True):
                asked = since is None or name != own or (ts - since).total_seconds() >= seconds
                if asked:
                    own, since, answer = name, ts, available
                out.append((name, ts, asked, answer))
            yield pd.DataFrame(out, columns=["provider", "ts", "asked", "available"])

    kind = f"provider {rows.schema['provider'].dataType.simpleString()}, ts timestamp, asked boolean, available boolean"
    return rows.repartition("provider").sortWithinPartitions("provider", "ts", "available").mapInPandas(run, kind)


def _millis(ts) -> int:
    return round(ts.timestamp() * 1000)


class _Cooldown(StatefulProcessor):
    """Emits ``limited`` when a rest begins, ``ready`` when its timer expires; later limit errors move the timer."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def _frame(self, key, rows):
        import pandas as pd

        at = [datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None) for _, ms in rows]
        return pd.DataFrame({"provider": pd.Series([key[0]] * len(rows), dtype=object), "state": pd.Series([s for s, _ in rows], dtype=object), "at": pd.Series(at, dtype="datetime64[us]")})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        until, out = (self.until.get()[0] if self.until.exists() else None), []
        for ms in sorted(_millis(ts.tz_localize("UTC")) for frame in rows for ts in frame["ts"]):
            if until is None or ms >= until:
                out += [("ready", until)] if until is not None else []
                out.append(("limited", ms))
            if until is not None:
                self.handle.deleteTimer(until)
            until = max(until or 0, ms + self.seconds * 1000)
            self.handle.registerTimer(until)
        self.until.update((until,))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        ended = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] == ended:
            self.until.clear()
            yield self._frame(key, [("ready", ended)])

    def close(self) -> None:
        pass


def cooldown_changes(calls: DataFrame, provider: str = "provider", at: str = "ts", error: str = "error", seconds: int = COOLDOWN_SECONDS, delay: str = "1 minute") -> DataFrame:
    """(provider, state, at) of a stream of calls whenever a provider becomes limited or ready again, by event time.  Needs
    the RocksDB state store and a session in UTC."""
    limited = calls.where(limit_error(F.col(error))).select(F.col(provider).alias("provider"), F.col(at).alias("ts")).withWatermark("ts", delay)
    return limited.groupBy("provider").transformWithStateInPandas(_Cooldown(seconds), f"provider {limited.schema['provider'].dataType.simpleString()}, state string, at timestamp", "Append", "EventTime")

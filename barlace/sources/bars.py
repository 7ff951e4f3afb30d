"""Bar sources: provider contract, Parquet scan, bars from ticks, vendor pages.

A bar's ``timestamp`` (zone-free, UTC) is its end, the time at which it is
known; ``t`` is the same in epoch seconds and serves as position and join key.
"""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from datetime import date, datetime, timedelta
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import epoch_seconds, from_epoch


class BarProvider(Protocol):
    """Loads bars of a symbol between inclusive bounds, without sorting or filling."""

    def load(self, symbol: str, start: datetime | None, end: datetime | None) -> DataFrame: ...


def aware(value: datetime | None, name: str) -> datetime | None:
    if value is not None and value.tzinfo is None:
        raise ValueError(f"{name} must carry a time zone")
    return value


class ParquetBars:
    """Parquet scan with symbol check and inclusive bounds that reach the scan as filters."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self, symbol: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        start, end = aware(start, "start"), aware(end, "end")
        if start and end and start > end:
            raise ValueError("start must not follow end")
        bars = self.spark.read.parquet(self.path)
        if "symbol" in bars.columns:
            if bars.agg(F.bool_and(F.coalesce(F.col("symbol") == symbol, F.lit(False))).alias("ok")).first()["ok"] is False:
                raise ValueError(f"bars hold other symbols than {symbol}")
        if start:
            bars = bars.where(F.col("timestamp") >= F.lit(start))
        if end:
            bars = bars.where(F.col("timestamp") <= F.lit(end))
        return bars


def bars_from_events(events: DataFrame, minutes: int, first_day: str = "2024-01-01") -> DataFrame:
    """Tumbling bars of ``ts`` and ``value``, under a calendar of whole days."""
    width = minutes * 60
    ticks = events.select(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div {width * 1_000_000}").alias("slot"), "ts", "value")
    return (
        ticks.groupBy("slot")
        .agg(
            F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
            F.count("*").cast("double").alias("volume"), F.avg("value").alias("vwap"),
        )
        .withColumn("t", (F.col("slot") + 1) * width)
        .withColumn("timestamp", from_epoch("t"))
        .withColumn("session_index", F.expr(f"cast((t - {width}) div 86400 - datediff(date'{first_day}', date'1970-01-01') as int)"))
        .withColumn("session", F.expr(f"date_add(date'{first_day}', session_index)"))
        .withColumn("minute_of_session", F.expr(f"cast((t - {width}) % 86400 div 60 as int)"))
        .drop("slot")
    )


VENDOR = {"t": "timestamp", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "n": "trade_count"}
PAGE = "symbol string, next_page_token string, bars array<struct<t:string,o:double,h:double,l:double,c:double,v:double,vw:double,n:bigint>>"


def vendor_bars(pages: DataFrame, symbol: str) -> DataFrame:
    """Bars of archived pages (column ``body``, JSON); pages of another symbol are an error."""
    parsed = pages.select(F.from_json("body", PAGE).alias("p")).select("p.*")
    other = parsed.where(~F.coalesce(F.col("symbol") == symbol, F.lit(False)))
    if not other.isEmpty():
        raise ValueError(f"a page does not hold {symbol}")
    rows = parsed.select(F.explode("bars").alias("b")).select(*(F.col(f"b.{short}").alias(name) for short, name in VENDOR.items()))
    # as zone-free UTC whatever the session's zone: the vendor writes RFC 3339 in UTC
    return rows.withColumn("timestamp", F.expr("cast(replace(replace(timestamp, 'Z', ''), 'T', ' ') as timestamp_ntz)")).withColumn("t", epoch_seconds("timestamp"))


def within_half_open(bars: DataFrame, start: str, stop: str) -> bool:
    """True if each timestamp lies in [start, stop)."""
    ok = bars.agg(F.bool_and(F.expr(f"timestamp >= timestamp_ntz'{start}' and timestamp < timestamp_ntz'{stop}'")).alias("ok")).first()["ok"]
    return ok is not False


def month_ranges(start: date, stop: date) -> list[tuple[date, date]]:
    """[start, stop) cut at month starts."""
    cuts, at = [start], start
    while (at := (at.replace(day=1) + timedelta(days=32)).replace(day=1)) < stop:
        cuts.append(at)
    return list(zip(cuts, [*cuts[1:], stop], strict=True))


def request_page(url: str, headers: dict[str, str], attempts: int = 6, opener: Callable = urllib.request.urlopen, pause: Callable = time.sleep) -> bytes:
    """One HTTP page; 429 and 5xx are tried again after Retry-After or a doubling wait."""
    for attempt in range(attempts):
        try:
            with opener(urllib.request.Request(url, headers=headers), timeout=60) as reply:
                return reply.read()
        except urllib.error.HTTPError as error:
            if (error.code != 429 and error.code < 500) or attempt == attempts - 1:
                raise
            wait = error.headers.get("Retry-After") if error.headers else None
            pause(float(wait) if wait and wait.replace(".", "", 1).isdigit() else 2.0**attempt)
        except urllib.error.URLError:
            if attempt == attempts - 1:
                raise
            pause(2.0**attempt)
    raise AssertionError("unreachable")


def cached_page(folder: Path, name: str, request: dict, fetch: Callable[[], bytes]) -> bytes:
    """A page from the archive, or fetched into it; a changed request or body is an error."""
    body, note = folder / f"{name}.json", folder / f"{name}.request.json"
    if body.exists():
        known = json.loads(note.read_text())
        if known["request"] != request:
            raise ValueError(f"{name} was archived for another request")
        content = body.read_bytes()
        if hashlib.sha256(content).hexdigest() != known["sha256"]:
            raise ValueError(f"{name} changed since it was archived")
        return content
    content = fetch()
    folder.mkdir(parents=True, exist_ok=True)
    body.write_bytes(content)
    note.write_text(json.dumps({"request": request, "sha256": hashlib.sha256(content).hexdigest()}, sort_keys=True))
    return content


def download_pages(folder: Path, symbol: str, start: date, stop: date, page: Callable[[dict], bytes]) -> list[str]:
    """Archived page bodies month by month, following page tokens; a repeated token is an error."""
    bodies = []
    for first, last in month_ranges(start, stop):
        token, seen, number = None, set(), 0
        while True:
            request = {"symbol": symbol, "start": first.isoformat(), "end": last.isoformat(), "page_token": token}
            text = cached_page(folder, f"{symbol}-{first.isoformat()}-{number}", request, lambda request=request: page(request)).decode()
            bodies.append(text)
            token = json.loads(text).get("next_page_token")
            if token is None:
                break
            if token in seen:
                raise ValueError("the vendor repeated a page token")
            seen.add(token)
            number += 1
    return bodies


def prefix_subset(bars: DataFrame, stop: datetime, path: str) -> dict:
    """Writes the bars before ``stop``, once only, and tells rows and bounds."""
    bars.where(F.col("timestamp") < F.lit(stop)).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    found = bars.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    return {"rows": found["rows"], "first": str(found["first"]), "last": str(found["last"]), "stop": str(stop)}

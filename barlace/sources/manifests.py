"""Manifests: what a written table of bars holds, where it came from, and its checksum."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as ops
from ..plans.config import Config, config_from
from .bars import download_pages, prefix_subset, vendor_bars, within_half_open
from .calendar import bar_grid, filter_regular_hours, xnys_calendar


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and SHA-256 of a table's files, which executors read; the driver gets one row a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(str(path))
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha")).collect()
    return hashlib.sha256("".join(f"{r['name']}:{r['sha']}\n" for r in sorted(rows)).encode()).hexdigest()


def manifest_path(table: str) -> Path:
    return Path(f"{str(table).rstrip('/')}.manifest.json")


def write_manifest(table: str, values: dict) -> dict:
    """Beside the table, and never over another manifest."""
    path = manifest_path(table)
    with path.open("x") as f:
        json.dump(values, f, indent=2, sort_keys=True, default=str)
    return values


def check_manifest(spark: SparkSession, table: str) -> dict | None:
    """The manifest of a table, if it has one; an error if the table is not what it says."""
    path = manifest_path(table)
    if not path.exists():
        return None
    values = json.loads(path.read_text())
    if values.get("sha256") not in (None, checksum(spark, table)):
        raise ValueError(f"{table} differs from its manifest")
    return values


def missing_by_session(bars: DataFrame, grid: DataFrame) -> dict[str, int]:
    """Bars that each scheduled session lacks, sessions without a lack left out; one row a session reaches the driver."""
    rows = ops.session_coverage(bars, grid).where("missing > 0").orderBy("session").collect()
    return {r["session"].isoformat(): r["missing"] for r in rows}


def archive_bars(spark: SparkSession, folder: Path, symbol: str, start: date, stop: date, page: Callable[[dict], bytes], table: str, config: Config | None = None) -> dict:
    """Downloads [start, stop) month by month, keeps the regular hours, validates them, and writes the table with its manifest."""
    config = config or config_from({"symbol": symbol, "data": {"timestamp_label": "start", "path": table}})
    bodies = download_pages(folder, symbol, start, stop, page)
    every = vendor_bars(spark.createDataFrame([(b,) for b in bodies], "body string"), symbol)
    if not within_half_open(every, start.isoformat(), stop.isoformat()):
        raise ValueError("the vendor sent bars outside the asked range")
    grid = bar_grid(xnys_calendar(spark, start, stop - timedelta(days=1)), config.bar_minutes)
    kept = filter_regular_hours(every, grid, config.bar_minutes, "start").select(every.columns)
    # judged against the whole asked range, so a missing first or last day shows
    canonical, quality = ops.validate_bars(kept.drop("t"), grid, config)
    kept.drop("t").write.mode("errorifexists").option("compression", "zstd").parquet(table)
    n_all, n_kept = every.count(), kept.count()
    return write_manifest(table, {
        "symbol": symbol, "start": start, "stop": stop, "timestamp_label": "start", "bar_minutes": config.bar_minutes, "vendor_bars": n_all, "kept_bars": n_kept, "excluded_bars": n_all - n_kept,
        "requested_sessions": grid.select("session").distinct().count(), "observed_sessions": canonical.select("session").distinct().count(), "missing_bars": missing_by_session(canonical, grid),
        "quality": asdict(quality), "pages": len(bodies), "page_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in bodies], "sha256": checksum(spark, table),
    })


def extract_prefix(spark: SparkSession, parent: str, stop: datetime, table: str) -> dict:
    """Writes the bars before ``stop`` with a manifest that names the parent and its checksum; a parent that differs from its manifest is an error."""
    known = check_manifest(spark, parent) or {}
    found = prefix_subset(spark.read.parquet(parent), stop, table)
    inherited = {k: known[k] for k in ("symbol", "timestamp_label", "bar_minutes") if k in known}
    return write_manifest(table, inherited | found | {"parent": str(parent), "parent_sha256": checksum(spark, parent), "parent_manifest": str(manifest_path(parent)) if known else None, "sha256": checksum(spark, table)})

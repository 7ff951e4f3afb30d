"""Commands: validate-data, run, report, audit.  A run directory holds Parquet, CSV, JSON, YAML and one HTML page."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
import time
from dataclasses import asdict
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import bars as ops
from ..operators import audit, bootstrap, hmm, metrics, trading
from ..sources import calendar, manifests
from ..sources.bars import ParquetBars
from . import report, walk_forward
from .config import Config, load_config, save_config
from .store import keep


def load_and_validate(spark: SparkSession, config: Config):
    """(canonical bars, report).  Bars are moved to their ends before the days of the grid are taken from them; bars off the grid are rejected."""
    bars = ParquetBars(spark, config.data.path).load(config.symbol)
    if faults := ops.schema_faults(bars):
        raise ops.BarDataError(faults, ops.QualityReport())
    bars = ops.at_bar_end(bars.drop("t"), config)
    limits = bars.agg(F.min("t"), F.max("t")).first()
    if limits[0] is None:
        raise ops.BarDataError([ops.Fault("no_rows")], ops.QualityReport())
    days = [datetime.fromtimestamp(x, timezone.utc).date() for x in limits]
    maker = calendar.day_calendar if config.data.calendar == "DAYS" else calendar.xnys_calendar
    return ops.validate_bars(bars, calendar.bar_grid(maker(spark, *days), config.bar_minutes), config)


def source_hashes() -> dict[str, str]:
    """SHA-256 of each module of the package."""
    root = Path(__file__).resolve().parent.parent
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(root.rglob("*.py"))}


def run(spark: SparkSession, config_path: str) -> Path:
    """Evaluates a configuration into a new run directory; a failed run leaves its manifest."""
    config, began = load_config(config_path), time.time()
    out = Path(config.report.output_dir) / datetime.now(timezone.utc).strftime("run-%Y%m%dT%H%M%S")
    out.mkdir(parents=True, exist_ok=False)
    parent = manifests.check_manifest(spark, config.data.path)
    manifest = {
        "status": "running", "input": config.data.path, "input_sha256": manifests.checksum(spark, config.data.path), "input_manifest": parent is not None, "source_sha256": source_hashes(),
        "versions": {"python": sys.version.split()[0], **{name: metadata.version(name) for name in ("pyspark", "numpy", "pandas", "pyarrow")}},
    }
    report.write_json(manifest, out / "data_manifest.json")
    save_config(config, str(out / "config.yaml"))
    try:
        bars, quality = load_and_validate(spark, config)
        report.write_json(asdict(quality), out / "quality.json")
        bars.write.option("compression", "zstd").parquet(str(out / "bars.parquet"))
        w = walk_forward.plan(bars, config)
        models = keep(walk_forward.fit_models(w), "models")
        report.write_json({r["refit_id"]: json.loads(r["diagnostics"]) for r in models.select("refit_id", "diagnostics").collect()}, out / "refits.json")
        models.write.option("compression", "zstd").parquet(str(out / "models.parquet"))
        queries = walk_forward.common_queries(w)
        if queries.isEmpty():
            raise walk_forward.NoEvaluableQueries("no query can be evaluated")
        walk_forward.skipped_blocks(w, models, queries).coalesce(1).write.option("header", True).csv(str(out / "skipped_blocks.csv"))
        walk_forward.forecasts(w, models).write.option("compression", "zstd").parquet(str(out / "predictions.parquet"))
        predictions = spark.read.parquet(str(out / "predictions.parquet"))
        walk_forward.neighbor_audit(w, queries, models).write.option("compression", "zstd").parquet(str(out / "neighbors.parquet"))
        neighbors = spark.read.parquet(str(out / "neighbors.parquet"))
        shown = neighbors.where("method = 'raw_knn'")
        walk_forward.examples(w, walk_forward.modelled(queries, models), shown).write.parquet(str(out / "examples.parquet"))
        write_training_diagnostics(w, models, out)
        metrics.require_cohorts(predictions)
        primary = predictions.where(F.col("embargo_sessions") == config.retrieval.embargo_sessions)
        keys = ["method", "horizon_minutes"]
        tables = {
            "metrics": metrics.metric_table(primary, keys), "fold_metrics": metrics.metric_table(primary, ["fold", *keys]), "calibration": metrics.calibration(primary),
            "sensitivity_metrics": metrics.sensitivity(predictions),
            "bootstrap": bootstrap.paired_session_bootstrap(predictions, config.bootstrap.n_resamples, config.bootstrap.confidence, config.random_state),
        }
        if config.trading.enabled:
            signals = primary.select(*keys, "q_t", "outcome_end", "median")
            done = keep(trading.trades(bars, signals, config.trading.threshold, config.costs.bps_per_side, config.bar_minutes * 60), "trades")
            marks = trading.equity(bars, signals, done)
            done.write.parquet(str(out / "trades.parquet"))
            marks.write.parquet(str(out / "equity.parquet"))
            tables["trading_metrics"] = trading.trading_metrics(marks, done, config.costs.bps_per_side)
        for name, table in tables.items():
            table.coalesce(1).write.option("header", True).csv(str(out / f"{name}.csv"))
        accepted = {r["status"]: r["count"] for r in models.groupBy("status").count().collect()}
        manifest |= {"status": "complete", "forecasts": predictions.count(), "neighbors": neighbors.count(), "refits": accepted, "seconds": time.time() - began, "bytes": sum(p.stat().st_size for p in out.rglob("*") if p.is_file())}
        write_report(spark, out)
    except Exception as error:
        manifest |= {"status": "failed", "reason": str(error)[:2000]}
        raise
    finally:
        report.write_json(manifest, out / "data_manifest.json")
    return out


def write_training_diagnostics(w, models, out: Path) -> None:
    """State tables of the filtered training posteriors: occupancy and means, and occupancy by minute, return sign and volatility."""
    columns = w.config.features.columns
    posterior = hmm.filter_refits(w.panel, columns, models, w.config.bar_minutes * 60)
    rows = keep(w.panel.where("is_train").join(posterior, ["refit_id", "t"]), "training")
    sign = hmm.conditional_occupancy(rows, F.signum("log_return"))
    minutes = hmm.conditional_occupancy(rows, F.col("minute_of_session").cast("double"))
    buckets = hmm.conditional_occupancy(hmm.volatility_buckets(rows, "realized_volatility"), F.col("bucket").cast("double"))
    by = [t.withColumn("kind", F.lit(name)) for name, t in (("return_sign", sign.withColumn("label", F.col("label").cast("double"))), ("minute", minutes), ("volatility", buckets))]
    occupancy = by[0].unionByName(by[1]).unionByName(by[2])
    tables = {"states": hmm.state_summaries(rows, columns), "occupancy": occupancy, "clock": hmm.clock_concentration(minutes)}
    for name, table in tables.items():
        table.coalesce(1).write.option("header", True).csv(str(out / f"{name}.csv"))


def audit_run(spark: SparkSession, out: Path, prefix: Path | None = None) -> dict:
    """Checks the artifacts of a run against its bars and, with ``prefix``, against a run on fewer bars; writes audit.json.

    Outcomes are recomputed from the saved bars, and every forecast distribution from its saved neighbours.
    """
    config, manifest = load_config(str(out / "config.yaml")), json.loads((out / "data_manifest.json").read_text())
    read = lambda where, name: spark.read.parquet(str(where / f"{name}.parquet"))
    predictions, neighbors = read(out, "predictions"), read(out, "neighbors")
    bars = ops.forward_labels(read(out, "bars"), config.horizon_bars)
    found = {r["violation"]: r["n"] for r in audit.violations(bars, predictions, neighbors, list(config.horizons_minutes), config.retrieval.k, config.retrieval.max_neighbors_per_session).collect()}
    found |= {f"cohort_{r['violation']}": r["n"] for r in metrics.cohort_violations(predictions).collect()}
    found |= {"not_complete": int(manifest["status"] != "complete"), "input_changed": int(manifests.checksum(spark, config.data.path) != manifest["input_sha256"])}
    found |= {"forecasts_miscounted": abs(predictions.count() - manifest.get("forecasts", -1)), "neighbors_miscounted": abs(neighbors.count() - manifest.get("neighbors", -1))}
    if prefix:
        found |= {f"prefix_{r['difference']}": r["n"] for r in audit.prefix_differences(read(prefix, "predictions"), predictions).collect()}
    result = {"status": "failed" if any(found.values()) else "passed", "violations": found, "forecasts": predictions.count(), "neighbors": neighbors.count()}
    report.write_json(result, out / "audit.json")
    return result


def write_report(spark: SparkSession, out: Path) -> Path:
    """The page from saved artifacts alone."""
    config = load_config(str(out / "config.yaml"))
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(str(out / f"{name}.csv"))
    intervals = read("bootstrap").where((F.col("model") == "hmm_trajectory") & (F.col("loss") == "absolute_error") & (F.col("embargo_sessions") == config.retrieval.embargo_sessions))
    outcome = bootstrap.conclusion(intervals, list(config.horizons_minutes), config.walk_forward.n_folds, config.data.synthetic).first()["outcome"]
    predictions = spark.read.parquet(str(out / "predictions.parquet")).where(F.col("embargo_sessions") == config.retrieval.embargo_sessions)
    tables = {
        "Errors": (report.error_series(read("metrics")), 100), "Calibration": (report.calibration_series(read("calibration")), 400),
        "Sensitivity": (report.sensitivity_series(read("sensitivity_metrics")), 400), "Intervals": (intervals, 100), "Coverage": (report.query_coverage(predictions).orderBy("q_session"), 400),
        "Neighbors": (spark.read.parquet(str(out / "neighbors.parquet")).where("method = 'raw_knn'").orderBy("q_t", "embargo_sessions", "rank").drop("vector"), report.NEIGHBORS_SHOWN),
    }
    held = lambda name: spark.read.parquet(str(out / f"{name}.parquet"))
    primary = held("neighbors").where(F.col("embargo_sessions") == config.retrieval.embargo_sessions)
    longest = f"return_{max(config.horizons_minutes)}m"
    picked = report.spread_picks(held("examples")).orderBy("refit_id", "role", "rank", "context_step")
    tables |= {
        "Example contexts": (picked.select("refit_id", "role", "rank", "context_step", "normalized_close", *config.features.columns), 400),
        f"Cohort {longest}": (report.histogram(primary.where(f"{longest} is not null"), longest).orderBy("method", "bin"), 200),
        "States": (read("states").orderBy("refit_id", "state"), 200), "Clock concentration": (read("clock").orderBy("refit_id", "state"), 200),
    }
    tables |= {f"State {name}": (table.orderBy("refit_id", "state"), 400) for name, table in report.state_tables(held("models")).items()}
    if (out / "trades.parquet").exists():
        last = held("equity").groupBy("method", "horizon_minutes", "session").agg(F.max_by("net_equity", "t").alias("net_equity"), F.max_by("gross_equity", "t").alias("gross_equity"))
        tables["Equity"] = (last.orderBy("method", "horizon_minutes", "session"), 2000)
        tables["Trades"] = (spark.read.parquet(str(out / "trades.parquet")).orderBy("method", "horizon_minutes", "q_t"), report.TRADES_SHOWN)
    page = out / "report.html"
    page.write_text(report.render(f"{config.symbol} walk-forward", tables, [f"Conclusion: {outcome}"]))
    return page


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="barlace")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, option in (("validate-data", "--config"), ("run", "--config"), ("report", "--run"), ("audit", "--run")):
        command = commands.add_parser(name)
        command.add_argument(option, required=True, dest="path")
        if name == "audit":
            command.add_argument("--prefix", help="run directory of a run on fewer bars")
    chosen = parser.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if chosen.command == "validate-data":
            _, quality = load_and_validate(spark, load_config(chosen.path))
            print(json.dumps(report.json_safe(asdict(quality)), indent=2))
        elif chosen.command == "run":
            print(run(spark, chosen.path))
        elif chosen.command == "audit":
            result = audit_run(spark, Path(chosen.path), Path(chosen.prefix) if chosen.prefix else None)
            print(json.dumps(result, indent=2))
            return 0 if result["status"] == "passed" else 1
        else:
            print(write_report(spark, Path(chosen.path)))
    except ops.BarDataError as error:
        print(json.dumps(report.json_safe({"error": str(error), "report": asdict(error.report)}), indent=2), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())

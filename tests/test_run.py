"""End to end: validate, run and report from files; streaming bars and filter; leakage checks."""

import json
import math
import shutil
from datetime import date, datetime, timezone
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlace import registry
from barlace.operators import audit, hmm, retrieval
from barlace.plans import report
from barlace.plans.config import config_from, save_config
from barlace.plans.run import main
from barlace.sources import manifests
from barlace.sources.bars import bars_from_events
from barlace.streaming.bars import filter_step, streaming_bars, streaming_filter

DATA = "/root/testdata/sf0.001"


def saved_bars(spark, path, scale_after=None):
    bars = bars_from_events(spark.read.parquet(f"{DATA}/events.parquet"), 60)
    if scale_after:
        bars = bars.withColumns({c: F.when(F.col("t") > scale_after, F.col(c) * 4).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "vwap")})
    bars.select("timestamp", "open", "high", "low", "close", "volume", "vwap").coalesce(1).write.mode("overwrite").parquet(path)


def test_commands(spark, tmp_path, capsys):
    saved_bars(spark, str(tmp_path / "bars.parquet"))
    values = {
        "bar_interval": "60m", "context_bars": 3, "horizons_minutes": [60, 120], "data": {"path": str(tmp_path / "bars.parquet"), "calendar": "DAYS", "min_session_coverage": 0.1},
        "features": {"realized_vol_window": 3}, "retrieval": {"k": 5}, "walk_forward": {"min_training_sessions": 10}, "hmm": {"n_states": 2, "covariance_type": "diag", "tol": 0.1},
        "bootstrap": {"n_resamples": 20}, "sensitivity": {"embargo_sessions": [0, 1]}, "trading": {"enabled": True}, "report": {"output_dir": str(tmp_path / "runs")},
    }
    save_config(config_from(values), str(tmp_path / "c.yaml"))
    assert main(["validate-data", "--config", str(tmp_path / "c.yaml")]) == 0
    assert json.loads(capsys.readouterr().out)["number_of_bars"] > 400
    assert main(["run", "--config", str(tmp_path / "c.yaml")]) == 0
    out = Path(capsys.readouterr().out.strip().splitlines()[-1])
    manifest = json.loads((out / "data_manifest.json").read_text())
    assert manifest["status"] == "complete" and manifest["forecasts"] > 0
    methods = {r.method for r in spark.read.parquet(str(out / "predictions.parquet")).select("method").distinct().collect()}
    assert methods == {"unconditional", "same_time_of_day", "raw_knn", "momentum", "hmm_current", "hmm_trajectory"}
    page = (out / "report.html").read_text()
    assert all(title in page for title in ("Conclusion", "Example contexts", "Cohort return_120m", "State transitions", "Clock concentration", "Equity"))
    assert manifest["neighbors"] > manifest["forecasts"] and manifest["refits"]["accepted"] > 0 and "operators/hmm.py" in manifest["source_sha256"]
    members = {r.method for r in spark.read.parquet(str(out / "neighbors.parquet")).select("method").distinct().collect()}
    assert members == methods - {"momentum"}
    assert main(["audit", "--run", str(out)]) == 0
    assert json.loads((out / "audit.json").read_text())["status"] == "passed"
    changed = spark.read.parquet(str(out / "neighbors.parquet")).withColumn("return_60m", F.expr("if(method = 'hmm_current' and rank = 1, return_60m + 1, return_60m)"))
    n = changed.where("method = 'hmm_current' and rank = 1").count()
    changed.write.parquet(str(tmp_path / "changed"))
    shutil.rmtree(out / "neighbors.parquet")
    shutil.move(tmp_path / "changed", out / "neighbors.parquet")
    capsys.readouterr()
    assert main(["audit", "--run", str(out)]) == 1
    broken = {k: v for k, v in json.loads(capsys.readouterr().out)["violations"].items() if v}
    assert broken == {"neighbor_outcome_differs": n, "summary_differs": n}
    save_config(config_from(values | {"data": values["data"] | {"min_session_coverage": 1.0}}), str(tmp_path / "bad.yaml"))
    assert main(["validate-data", "--config", str(tmp_path / "bad.yaml")]) == 2
    assert "coverage" in capsys.readouterr().err


def test_queries_and_oracle_have_the_same_names():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_future_does_not_change_the_past(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    changed = events.withColumn("value", F.when(F.col("ts") >= F.lit("2024-01-24").cast("timestamp_ntz"), F.col("value") * 4).otherwise(F.col("value")))
    from barlace.operators import bars as ops

    cut = 1706054400
    tables = [ops.causal_features(ops.with_segments(bars_from_events(e, 60), 60), 3).where(F.col("t") <= cut).select("t", "log_return", "realized_volatility", "vwap_distance") for e in (events, changed)]
    assert audit.same_rows(*tables)


def test_streaming(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value").where("ts < timestamp'2024-01-03 00:00:00'")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = streaming_bars(stream, 60).writeStream.format("memory").queryName("made_bars").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = bars_from_events(spark.read.parquet(f"{DATA}/events.parquet"), 60)
    got = {r.timestamp.timestamp(): r.close for r in spark.table("made_bars").collect()}
    want = {float(r.t): r.close for r in batch.collect()}
    assert got and all(want[t] == c for t, c in got.items())


def test_streaming_filter_equals_steps(spark, tmp_path):
    model = registry.MODEL
    rows = [("s", 900 * k, float(np.sin(k)), float(np.cos(k))) for k in range(1, 9)]
    table = spark.createDataFrame(rows, "session string, t long, x double, y double").withColumn("ts", F.timestamp_seconds("t"))
    for k, part in enumerate(("t <= 3600", "t > 3600")):
        table.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour")
    query = streaming_filter(stream, ["x", "y"], model, 900).writeStream.format("memory").queryName("posteriors").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {r.t: r.posterior for r in spark.table("posteriors").collect()}
    p = None
    for _, t, x, y in rows:
        p = filter_step(p, np.array([x, y]), model)
        assert np.allclose(got[t], np.exp(p))


def test_json_and_histogram(spark):
    assert report.json_safe({"a": math.nan, "b": [math.inf, 1.0]}) == {"a": None, "b": [None, 1.0]}
    values = spark.createDataFrame([("m", float(k)) for k in range(31)] + [("n", 30.0)], "method string, v double")
    bins = report.histogram(values, "v").collect()
    assert math.isclose(sum(r.density * (r.upper - r.lower) for r in bins if r.method == "m"), 1.0)


def test_archive_and_prefix_manifests(spark, tmp_path):
    opens = {date(2024, 1, 3): 1704292200, date(2024, 1, 4): 1704378600}  # 09:30 New York as UTC seconds

    def page(request):
        first = date.fromisoformat(request["start"])
        bars = []
        for day, at in opens.items():
            for k in range(-2, 80):  # two bars before the session and two after it
                if day == date(2024, 1, 4) and k == 5:
                    continue
                t = datetime.fromtimestamp(at + 300 * k, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
                bars.append({"t": t, "o": 100.0, "h": 102.0, "l": 99.0, "c": 101.0, "v": 10.0, "vw": 100.5, "n": 3})
        return json.dumps({"symbol": "SPY", "bars": bars if first == date(2024, 1, 3) else [], "next_page_token": None}).encode()

    table = str(tmp_path / "bars.parquet")
    made = manifests.archive_bars(spark, tmp_path / "pages", "SPY", date(2024, 1, 3), date(2024, 1, 6), page, table)
    assert (made["vendor_bars"], made["kept_bars"], made["excluded_bars"]) == (163, 155, 8)
    assert made["missing_bars"] == {"2024-01-04": 1, "2024-01-05": 78} and made["requested_sessions"] == 3 and made["observed_sessions"] == 2
    part = manifests.extract_prefix(spark, table, datetime(2024, 1, 4), str(tmp_path / "part.parquet"))
    assert part["rows"] == 78 and part["parent_sha256"] == made["sha256"] == manifests.check_manifest(spark, table)["sha256"] and part["timestamp_label"] == "start"
    with pytest.raises(FileExistsError):
        manifests.write_manifest(table, {})
    spark.read.parquet(table).limit(3).write.mode("append").parquet(table)
    with pytest.raises(ValueError, match="differs"):
        manifests.check_manifest(spark, table)


def test_hmm_input_contract(spark):
    rows = spark.createDataFrame([("r", 300, "2024-01-03", 0, 1.0), ("r", 600, "2024-01-03", 0, 2.0), ("r", 1500, "2024-01-03", 1, 2.0)], "refit_id string, t long, session string, segment_id int, x double")
    hmm.check_input(rows, ["x"])
    assert [r.interval for r in hmm.bar_intervals(rows).collect()] == [300]
    for bad, columns in ((rows, []), (rows, ["x", "x"]), (rows, ["y"]), (rows.withColumn("session", F.lit(None).cast("string")), ["x"]), (rows.unionByName(rows), ["x"])):
        with pytest.raises(hmm.HmmInputError):
            hmm.check_input(bad, columns)
    good = {"means": np.zeros((2, 1)), "covariances": np.ones((2, 1, 1)), "transitions": np.full((2, 2), 0.5), "start": np.full(2, 0.5)}
    assert hmm.parameter_faults(good, 2, 1) == []
    for name, value in (("means", np.zeros((2, 2))), ("means", np.full((2, 1), np.nan)), ("transitions", np.full((2, 2), 0.6)), ("start", np.array([1.5, -0.5]))):
        assert len(hmm.parameter_faults(good | {name: value}, 2, 1)) == 1
    skew = np.array([[[1.0, 0.2], [0.1, 1.0]]] * 2)
    assert hmm.parameter_faults(good | {"means": np.zeros((2, 2)), "covariances": skew}, 2, 2) == ["covariance of state 0: not symmetric", "covariance of state 1: not symmetric"]


def test_blocked_knn_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(size=(90, 7)), 1)
    vectors[5] = vectors[17] = 0
    vectors[30] = vectors[31]
    items = spark.createDataFrame([(k, k % 4, v.tolist()) for k, v in enumerate(vectors)], "id long, grp int, v array<double>")
    queries = items.where("id % 9 = 0 or id in (5, 30)").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 20)
    for metric in ("euclidean", "cosine"):
        got = {(r.q, r["rank"]): r.id for r in retrieval.exact_knn(queries, items, 6, 2, metric).collect()}
        for q in (r.q for r in queries.collect()):
            a, norms = vectors[q], np.sqrt((vectors**2).sum(axis=1))
            if metric == "euclidean":
                d = np.sqrt(((vectors - a) ** 2).sum(axis=1))
            else:
                whole = norms * norms[q]
                d = np.where((norms == 0) & (norms[q] == 0), 0.0, np.where(whole == 0, 1.0, 1 - np.clip((vectors * a).sum(axis=1) / np.where(whole == 0, 1, whole), -1, 1)))
            taken, want = {}, []
            for k in sorted((k for k in range(90) if k != q), key=lambda k: (d[k], k)):
                if taken.get(k % 4, 0) < 2 and len(want) < 6:
                    taken[k % 4] = taken.get(k % 4, 0) + 1
                    want.append(k)
            assert [got[q, r + 1] for r in range(6)] == want, (metric, q)

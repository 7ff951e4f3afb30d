"""Hand-calculated operator values, boundaries, top-k rules, rejection of bad input."""

import json
import math
from datetime import date, datetime, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlace.functions import scalars
from barlace.operators import bars as ops
from barlace.operators import bootstrap, hmm, metrics, preprocessing, trading
from barlace.operators import retrieval as rt
from barlace.plans.config import ConfigError, Hmm, config_from, load_config, save_config
from barlace.sources import bars as source
from barlace.sources import calendar

DAY = date(2024, 1, 2)


def made(spark, closes, volumes=None, sessions=None, segments=None, minutes=5, vwap=None, gaps=()):
    """Bars with high and low one above and below the close."""
    rows, t = [], 0
    for k, c in enumerate(closes):
        t += minutes * 60 * (2 if k in gaps else 1)
        rows.append((t, float(c), c + 1.0, c - 1.0, float(c), float((volumes or [1] * len(closes))[k]), (sessions or [0] * len(closes))[k], DAY, (segments or [0] * len(closes))[k], *([vwap[k]] if vwap else [])))
    return spark.createDataFrame(rows, "t long, open double, high double, low double, close double, volume double, session_index int, session date, segment_id int" + (", vwap double" if vwap else ""))


def column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)), (got, want)


def test_features(spark):
    f = ops.causal_features(made(spark, [10.0, 20.0, 80.0], [1, 2, 1]), 2).cache()
    near(column(f, "log_return"), [None, math.log(2), math.log(4)])
    near(column(f, "realized_volatility"), [None, None, math.log(2) / math.sqrt(2)])
    near(column(f, "range_fraction"), [0.2, 0.1, 0.025])
    near(column(f, "session_vwap"), [10, 50 / 3, 32.5])
    near(column(f, "vwap_distance"), [0, 1 / 6, 47.5 / 80])
    assert column(f, "day_of_week") == [1, 1, 1]


def test_vwap_rules(spark):
    rows = made(spark, [10.0, 20.0, 30.0], [1, 3, 2], vwap=[9.0, 18.0, 27.0])
    near(column(ops.causal_features(rows, 2), "session_vwap"), [9, 63 / 4, 117 / 6])
    near(column(ops.causal_features(made(spark, [10.0, 20.0, 30.0], [0, 0, 2]), 2), "session_vwap"), [None, None, 30])
    poisoned = made(spark, [10.0, 20.0, 30.0], [1, 3, 2], vwap=[9.0, float("nan"), 27.0])
    near(column(ops.causal_features(poisoned, 2), "session_vwap"), [9, None, None])


def test_labels_do_not_bridge(spark):
    closes = [100.0, 105, 104, 90, 95, 98, 120, 119, 121, 122, 126, 125, 80]
    lab = ops.forward_labels(made(spark, closes), {5: 1, 15: 3, 30: 6, 60: 12})
    first, second = lab.orderBy("t").collect()[:2]
    near([first[f"return_{h}m"] for h in (5, 15, 30, 60)], [0.05, -0.1, 0.2, -0.2])
    near([second["return_5m"], second["return_60m"]], [-1 / 105, None])
    assert first["outcome_end_60m"] == first["t"] + 3600
    trail = ops.recent_return(made(spark, [float(2 ** (k % 4)) for k in range(8)], segments=[0] * 4 + [1] * 4), 3)
    near(column(trail, "recent_return"), [None] * 3 + [7] + [None] * 3 + [7])


def test_segments(spark):
    rows = made(spark, [1.0] * 6, gaps=(2, 5))
    assert column(ops.with_segments(rows.drop("segment_id"), 5), "segment_id") == [0, 0, 1, 1, 1, 2]
    two = rows.drop("segment_id").withColumn("session", F.when(F.col("t") > 1500, F.date_add("session", 1)).otherwise(F.col("session")))
    assert column(ops.with_segments(two, 5), "segment_id") == [0, 0, 1, 1, 2, 3]


def test_contexts(spark):
    rows = made(spark, [1.0, 2, 3, 4, 5, 6], segments=[0, 0, 0, 1, 1, 1]).withColumn("b", F.when(F.col("close") == 5, F.lit(float("nan"))).otherwise(F.col("close") * 10))
    got = column(ops.contexts(rows, ["close", "b"], 2), "context")
    assert got == [None, [1, 10, 2, 20], [2, 20, 3, 30], None, None, None]


def test_seasonality_and_scaler(spark):
    rows = spark.createDataFrame(
        [("r", True, 0, 10.0, 1.0, 5.0), ("r", True, 0, 14.0, 3.0, 5.0), ("r", True, 5, 100.0, None, 5.0), ("r", True, 5, 120.0, float("nan"), 5.0), ("r", False, 0, 16.0, 5.0, 8.0), ("r", False, 5, 130.0, 2.0, 5.0), ("r", False, 10, 200.0, 2.0, 5.0)],
        "refit_id string, is_train boolean, minute_of_session int, volume double, x double, y double",
    )
    out = preprocessing.with_surprise(rows, preprocessing.volume_statistics(rows)).where("not is_train").orderBy("minute_of_session").collect()
    near([r["volume_surprise"] for r in out], [4 / (1.4826 * 2), 20 / (1.4826 * 10), None])
    z = preprocessing.standardized(rows, preprocessing.scaler_statistics(rows, ["x", "y"]), ["x", "y"]).where("volume = 16").first()
    near([z["x"], z["y"], z["raw_x"]], [3.0, 3.0, 5.0])
    flat = rows.withColumn("volume", F.lit(4.0))
    assert {r["slot_scale"] for r in preprocessing.volume_statistics(flat).collect()} == {4.0}


def test_distances_and_cap(spark):
    one = lambda metric, q: [round(r[0], 9) for r in spark.createDataFrame([(k, q, v) for k, v in enumerate([[10.0, 0.0], [1.0, 1.0], [0.0, 2.0], [-1.0, 0.0], [0.0, 0.0]])], "k int, q array<double>, v array<double>").orderBy("k").select(scalars.DISTANCES[metric](F.col("q"), F.col("v"))).collect()]
    assert one("euclidean", [1.0, 0.0]) == [9.0, 1.0, round(5**0.5, 9), 2.0, 1.0]
    assert one("cosine", [1.0, 0.0]) == [0.0, round(1 - 1 / 2**0.5, 9), 1.0, 2.0, 1.0]
    assert one("cosine", [0.0, 0.0]) == [1.0, 1.0, 1.0, 1.0, 0.0]
    pairs = spark.createDataFrame([("q", k, s, 1.0) for k, s in enumerate([9, 9, 4, 7, 8])], "q string, c_t int, c_session int, distance double")
    pick = lambda k, cap: [r.c_t for r in rt.capped_nearest(pairs, k, cap, ["q"]).orderBy("rank").collect()]
    assert (pick(3, 1), pick(9, 1), pick(3, 2)) == ([0, 2, 3], [0, 2, 3, 4], [0, 1, 2])
    with pytest.raises(ValueError):
        rt.capped_nearest(pairs, 0, 1, ["q"])


def test_availability_and_embargo(spark):
    q = spark.createDataFrame([("r", 1000, 5)], "refit_id string, q_t long, q_session int")
    c = spark.createDataFrame([("r", 900, 5, 1000), ("r", 901, 5, 1001), ("r", 100, 4, 200), ("r", 50, 2, 60)], "refit_id string, c_t long, c_session int, c_known long")
    pairs = rt.by_embargo(rt.available_pairs(q, c), [0, 1, 2])
    got = {(r.embargo_sessions, r.c_t) for r in pairs.collect()}
    assert got == {(0, 900), (0, 100), (0, 50), (1, 50), (2, 50)}


def test_summary_and_momentum(spark):
    rows = spark.createDataFrame([(v, d) for v, d in zip([-0.2, -0.1, 0.0, 0.1, 0.6], [0.0, 1.0, 2.0, 3.0, 100.0], strict=True)], "r double, d double")
    s = rows.agg(*rt.summary_columns("r", "d")).first()
    near([s[n] for n in ("mean", "median", "probability_up", "q10", "q25", "q75", "q90", "return_std", "distance_mean")], [0.08, 0, 0.4, -0.16, -0.1, 0.1, 0.4, 0.0776**0.5, 21.2])
    m = spark.createDataFrame([(0.21,), (-0.36,), (0.0,)], "r double").select(scalars.momentum(F.col("r"), 2, 4).alias("m")).select("m", scalars.hard_sign(F.col("m")).alias("p")).collect()
    near([x for r in m for x in r], [0.1, 1, -0.2, 0, 0, 0.5])


def predictions(spark, methods=("raw_knn", "hmm_current", "hmm_trajectory")):
    rows = []
    for method in methods:
        for k, (a, m, p) in enumerate(zip([-0.02, 0.01, 0.03, 0.0], [-0.01, 0.02, 0.01, 0.0], [0.0, 1.0, 0.5, 0.1], strict=True)):
            shift = {"hmm_current": 0.01, "hmm_trajectory": 0.0}.get(method, 0.0)
            rows.append((0, k, k // 2, 1 + k // 2, method, 5, m + shift, p, a - 0.01 if k else a + 0.001, a + 0.015 if k else a + 0.026, a, 0.1, 5, 1.0, 0.5, 2.0))
    return spark.createDataFrame(rows, "embargo_sessions int, q_t long, q_session int, fold int, method string, horizon_minutes int, median double, probability_up double, q10 double, q90 double, actual_return double, return_std double, effective_neighbor_count int, distance_mean double, distance_min double, distance_max double")


def test_metrics(spark):
    m = metrics.metric_table(predictions(spark).where("method = 'raw_knn'"), ["method"]).first()
    near([m.mae, m.rmse, m.spearman, m.brier, m.interval_10_90_width, m.interval_10_90_coverage], [0.01, 0.00015**0.5, 0.8, 0.065, 0.025, 0.75])
    flat = predictions(spark).withColumn("median", F.lit(0.1))
    assert metrics.metric_table(flat, ["method"]).first().spearman is None
    bins = metrics.calibration(spark.createDataFrame([("m", 5, k / 10, 0.0, 0) for k in range(11)], "method string, horizon_minutes int, probability_up double, actual_return double, q_session int"))
    assert [r.n_forecasts for r in bins.orderBy("bin").collect()] == [1] * 9 + [2]
    table = metrics.sensitivity(predictions(spark))
    assert sorted({r.fold for r in table.collect()}) == [0, 1, 2]


def test_unpaired_cohorts_are_rejected(spark):
    p = predictions(spark)
    metrics.require_cohorts(p)
    for broken in (p.unionByName(p.limit(1)), p.where("not (method = 'raw_knn' and q_t = 1)"), p.withColumn("fold", F.when(F.col("q_t") == 1, 2).otherwise(F.col("fold"))), p.limit(0)):
        with pytest.raises(metrics.CohortError):
            metrics.require_cohorts(broken)


def test_bootstrap(spark):
    p = predictions(spark)
    table = bootstrap.paired_session_bootstrap(p, 50, 0.8, 7)
    again = bootstrap.paired_session_bootstrap(p.repartition(3).orderBy(F.rand(1)), 50, 0.8, 7)
    assert [tuple(r) for r in table.collect()] == [tuple(r) for r in again.collect()]
    by = {(r.fold, r.model, r.loss): r for r in table.collect()}
    assert by[1, "hmm_current", "brier"].status == "insufficient_sessions" and by[1, "hmm_current", "brier"].ci_lower is None
    top = by[0, "hmm_current", "absolute_error"]
    assert top.ci_lower <= top.mean_difference <= top.ci_upper and top.n_sessions == 2
    cells = spark.createDataFrame([(f, 5, "ok", -0.1, -0.2, -0.05) for f in range(3)], "fold int, horizon_minutes int, status string, mean_difference double, ci_lower double, ci_upper double")
    outcome = lambda t, n=2: bootstrap.conclusion(t, [5], n).first().outcome
    assert outcome(cells) == "improved" and outcome(cells, 3) == "inconclusive" and outcome(cells.where("fold > 0")) == "inconclusive"
    assert outcome(cells.withColumns({c: -F.col(c) for c in ("mean_difference", "ci_upper")}).withColumn("ci_lower", F.lit(0.01))) == "not_improved"
    assert bootstrap.conclusion(cells, [5], 2, synthetic=True).first().outcome == "synthetic"


def test_forward_filter_equals_hand_pass(spark):
    model = {"means": [[-1.0], [1.0]], "covariances": [[[1.0]], [[0.5]]], "transitions": [[0.9, 0.1], [0.2, 0.8]], "start": [0.6, 0.4]}
    xs = [0.1, 0.4, None, -0.7, 2.0, 1e3, -1e3]
    rows = made(spark, [1.0] * 7, gaps=(4,)).withColumn("refit_id", F.lit("r")).withColumn("x", F.element_at(F.array(*(F.lit(x) for x in xs)), F.row_number().over(__import__("pyspark").sql.Window.partitionBy("session").orderBy("t"))))
    got = hmm.fixed_filter(rows, ["x"], model, 300).orderBy("t").collect()
    want, p = [], None
    for k, x in enumerate(xs):
        if x is None:
            p = None
            continue
        prior = np.array(model["start"]) if p is None or k == 4 else p @ np.array(model["transitions"])
        logs = np.array([-0.5 * (math.log(2 * math.pi * v) + (x - m) ** 2 / v) for m, v in ((-1.0, 1.0), (1.0, 0.5))]) + np.log(prior)
        p = np.exp(logs - logs.max())
        p /= p.sum()
        want.append(p)
    assert np.allclose([r.posterior for r in got], want)


def hidden(seed, n=6, length=60):
    rng = np.random.default_rng(seed)
    means, cov, rows = np.array([[-1.6, -0.8], [1.6, 0.8]]), np.array([[0.3, 0.08], [0.08, 0.2]]), []
    for _ in range(n):
        s = rng.integers(2)
        for _ in range(length):
            s = 1 - s if rng.random() < 0.06 else s
            rows.append(rng.multivariate_normal(means[s], cov))
    return np.array(rows), [length] * n


def test_em_recovers_states_and_retries():
    x, lengths = hidden(4)
    config = Hmm(n_states=2, covariance_type="full", n_iter=200, tol=1e-3)
    a, b = hmm.fit(x, lengths, config), hmm.fit(x, lengths, config)
    assert a["status"] == "accepted" and a["means"] == b["means"]
    assert np.allclose(sorted(m[0] for m in a["means"]), [-1.6, 1.6], atol=0.2)
    failed = hmm.fit(x, lengths, Hmm(n_states=2, n_iter=2, tol=1e-9))
    assert failed["status"] == "failed" and [t["seed"] for t in failed["attempts"]] == [42, 43, 44] and failed["fallback_reason"] is None
    for history, ok in (([1.0, 1.0005], True), ([1.0, 1.1], False), ([1.0, 0.9], False), ([1.0], False)):
        if ok:
            hmm.judge_history(history, 1e-3)
        else:
            with pytest.raises(hmm.FitRejected):
                hmm.judge_history(history, 1e-3)
    assert hmm.fit(x[:1], [1], config)["status"] == "failed"
    assert hmm.covariance_summary([np.diag([1.0, 4.0])])[0]["condition"] == 4.0


def track(spark, closes, opens, windows, median=0.1, method="m"):
    bars = made(spark, closes).withColumn("open", F.element_at(F.array(*(F.lit(float(x)) for x in opens)), (F.col("t") / 300).cast("int")))
    rows = [(method, 5, 300 * (q + 1), 300 * (x + 1), median) for q, x in windows]
    return bars, spark.createDataFrame(rows, "method string, horizon_minutes int, q_t long, outcome_end long, median double")


def test_trading(spark):
    bars, signals = track(spark, [20.0, 110, 500], [10.0, 100, 1000], [(0, 1)])
    done = trading.trades(bars, signals, 0.0, 0.0, 300)
    one = done.first()
    assert (one.entry_price, one.exit_price, done.count()) == (100, 110, 1)
    near(column(trading.equity(bars, signals, done), "net_equity"), [1, 1.1, 1.0999999999999999])
    bars, signals = track(spark, [100.0, 110, 110, 110, 121], [100.0] * 4 + [110.0], [(0, 2), (1, 3), (2, 4)])
    done = trading.trades(bars, signals, 0.0, 0.0, 300)
    assert sorted(r.q_t for r in done.collect()) == [300, 900]
    m = trading.trading_metrics(trading.equity(bars, signals, done), done, 0.0).first()
    near([m.gross_return, m.time_in_market, m.hit_rate], [0.331, 4 / 5, 1.0])
    costly = trading.trades(bars, signals, 0.0, 100.0, 300).orderBy("q_t").first()
    near([costly.entry_notional, costly.net_return], [1 / 1.01, 1.1 * 0.99 / 1.01 - 1])
    none = trading.trades(bars, signals, 9.0, 0.0, 300)
    empty = trading.trading_metrics(trading.equity(bars, signals, none), none, 0.0).first()
    assert empty.n_trades == 0 and empty.net_return == 0 and empty.sharpe is None
    with pytest.raises(trading.TradingInputError):
        trading.checked(bars.withColumn("open", F.lit(0.0)), signals)
    with pytest.raises(trading.TradingInputError):
        trading.checked(bars, signals.withColumn("q_t", F.lit(7).cast("long")))


def test_last_equity_keeps_its_digits_near_zero(spark):
    """A track that loses almost all: ``net_return`` is -1 to the last bit, the equity is not 0."""
    losses = [(2 * k, 2 * k + 1) for k in range(9)]
    bars, signals = track(spark, [100.0, 1.0] * 9, [100.0] * 18, losses)
    done = trading.trades(bars, signals, 0.0, 0.0, 300)
    m = trading.trading_metrics(trading.equity(bars, signals, done), done, 0.0).first()
    assert m.n_trades == 9 and m.net_return == -1
    near([m.net_equity * 1e18], [1.0])


def test_calendar(spark):
    table = calendar.bar_grid(calendar.xnys_calendar(spark, date(2024, 11, 27), date(2024, 11, 29)), 5)
    counts = {str(r.session): r["count"] for r in table.groupBy("session").count().collect()}
    assert counts == {"2024-11-27": 78, "2024-11-29": 42}
    last = table.orderBy(F.desc("t")).first()
    assert datetime.fromtimestamp(last.t, timezone.utc).isoformat() == "2024-11-29T18:00:00+00:00" and last.minute_of_session == 205
    march = calendar.bar_grid(calendar.xnys_calendar(spark, date(2024, 3, 8), date(2024, 3, 11)), 5).groupBy("session").agg(F.min("t").alias("t"), F.count("*").alias("n")).orderBy("session").collect()
    assert [(datetime.fromtimestamp(r.t, timezone.utc).strftime("%H:%M"), r.n) for r in march] == [("14:35", 78), ("13:35", 78)]
    assert len(calendar.xnys_sessions(date(2019, 1, 1), date(2019, 12, 31))) == 252
    assert len(calendar.xnys_sessions(date(2019, 1, 1), date(2025, 12, 31))) == 1760


def checked_bars(spark, drop=(), change=None):
    grid = calendar.bar_grid(calendar.xnys_calendar(spark, date(2024, 1, 3), date(2024, 1, 5)), 5)
    rows = [(r.t, 100.0, 102.0, 99.0, 101.0, 10.0) for r in grid.orderBy("t").collect()]
    rows = [r for k, r in enumerate(rows) if k not in drop]
    if change:
        rows[3] = change(rows[3])
    table = spark.createDataFrame(rows, "t long, open double, high double, low double, close double, volume double")
    return table.withColumn("timestamp", scalars.from_epoch("t")), grid


def test_validation(spark):
    config = config_from({"bar_interval": "5m"})
    bars, grid = checked_bars(spark, drop={20})
    prepared, report = ops.validate_bars(bars, grid, config)
    assert report.missing_bars_by_session == {"2024-01-03": 1, "2024-01-04": 0, "2024-01-05": 0} and prepared.count() == 233
    assert {r.segment_id for r in prepared.select("segment_id").distinct().collect()} == {0, 1, 2, 3}
    assert report.largest_timestamp_gaps[0]["minutes"] > 1000
    for change, broken in (
        (lambda r: (r[0], 0.0, *r[2:]), {("price", "open"), ("enclosure", None)}), (lambda r: (*r[:2], 99.5, *r[3:]), {("enclosure", None)}), (lambda r: (r[0] + 7, *r[1:]), {("off_grid", None)}),
        (lambda r: (*r[:5], -1.0), {("volume", "volume")}), (lambda r: (*r[:4], float("nan"), r[5]), {("price", "close"), ("enclosure", None)}), (lambda r: (*r[:3], float("nan"), *r[4:]), {("price", "low"), ("enclosure", None)}),
    ):
        with pytest.raises(ops.BarDataError) as error:
            ops.validate_bars(*checked_bars(spark, change=change), config)
        found = {(f.rule, f.column) for f in error.value.faults}
        assert found == broken or found == broken - {("enclosure", None)}, (found, broken)
        assert error.value.report.errors == [str(f) for f in error.value.faults] and all(f.rows == 1 for f in error.value.faults)
    rules = lambda table: [(f.rule, f.column, f.rows) for f in pytest.raises(ops.BarDataError, ops.validate_bars, table, grid, config).value.faults]
    short, grid = checked_bars(spark, drop=set(range(20)))
    assert rules(short) == [("coverage", None, 58)]
    assert rules(bars.unionByName(bars)) == [("time_repeated", None, 233)]
    assert rules(bars.limit(0)) == [("no_rows", None, None)]
    assert rules(bars.drop("volume").withColumn("open", F.lit("x"))) == [("absent_column", "volume", None), ("not_numeric", "open", None)]
    assert rules(bars.withColumn("symbol", F.lit("OTHER"))) == [("foreign_symbol", "symbol", 233)]
    # start labels move to the end of their bar before anything else looks at them
    starts = bars.drop("t").withColumn("timestamp", F.expr("timestamp - interval 5 minutes"))
    labelled = config_from({"bar_interval": "5m", "data": {"timestamp_label": "start"}})
    moved, _ = ops.validate_bars(starts, grid, labelled)
    assert sorted(r.t for r in moved.select("t").collect()) == sorted(r.t for r in prepared.select("t").collect())


def test_config(tmp_path):
    config = config_from({"context_bars": 4, "retrieval": {"k": 5}})
    save_config(config, str(tmp_path / "c.yaml"))
    assert load_config(str(tmp_path / "c.yaml")).retrieval.k == 5
    for bad in ({"nope": 1}, {"bar_interval": "0m"}, {"horizons_minutes": [7]}, {"retrieval": {"distance": "l1"}}, {"hmm": {"retry_seed_offsets": [1]}}, {"sensitivity": {"embargo_sessions": [1, 0]}}):
        with pytest.raises(ConfigError):
            config_from(bad)


def test_vendor_pages(spark, tmp_path):
    page = lambda token, *bars: json.dumps({"symbol": "SPY", "next_page_token": token, "bars": [{"t": t, "o": 1, "h": 2, "l": 1, "c": 1.5, "v": 3, "vw": 1.4, "n": 2} for t in bars]}).encode()
    asked = []

    def vendor(request):
        asked.append(request["page_token"])
        return page("next", "2024-01-02T14:30:00Z") if request["page_token"] is None else page(None, "2024-01-02T14:35:00Z")

    bodies = source.download_pages(tmp_path, "SPY", date(2024, 1, 1), date(2024, 2, 1), vendor)
    again = source.download_pages(tmp_path, "SPY", date(2024, 1, 1), date(2024, 2, 1), vendor)
    assert bodies == again and asked == [None, "next"]
    bars = source.vendor_bars(spark.createDataFrame([(b,) for b in bodies], "body string"), "SPY")
    assert [r.t for r in bars.orderBy("t").collect()] == [1704205800, 1704206100]
    assert source.within_half_open(bars, "2024-01-02", "2024-01-03") and not source.within_half_open(bars, "2024-01-03", "2024-01-04")
    with pytest.raises(ValueError):
        source.vendor_bars(spark.createDataFrame([(bodies[0],)], "body string"), "QQQ")
    with pytest.raises(ValueError, match="repeated"):
        source.download_pages(tmp_path / "x", "SPY", date(2024, 1, 1), date(2024, 2, 1), lambda request: page("same"))
    (tmp_path / "SPY-2024-01-01-0.json").write_bytes(b"{}")
    with pytest.raises(ValueError, match="changed"):
        source.download_pages(tmp_path, "SPY", date(2024, 1, 1), date(2024, 2, 1), vendor)


def test_parquet_provider(spark, tmp_path):
    rows = [(datetime(2024, 1, 2, 14, m), "SPY", 1.0) for m in (30, 35, 40)]
    spark.createDataFrame(rows, "timestamp timestamp, symbol string, close double").write.parquet(str(tmp_path / "b"))
    bars = source.ParquetBars(spark, str(tmp_path / "b"))
    utc = lambda m: datetime(2024, 1, 2, 14, m, tzinfo=timezone.utc)
    assert bars.load("SPY", utc(30), utc(35)).count() == 2
    for bad in (lambda: bars.load("QQQ"), lambda: bars.load("SPY", utc(35), utc(30)), lambda: bars.load("SPY", datetime(2024, 1, 2))):
        with pytest.raises(ValueError):
            bad()

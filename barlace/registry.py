"""Registered queries over the driver's tables, and their oracle SQL.

Bars come from ``events``: 15-minute bars under a calendar of whole days.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import nudge, rounded
from .operators import audit, bootstrap, hmm, metrics, preprocessing, trading
from .operators import bars as ops
from .operators import retrieval as rt
from . import oracle
from .oracle import metrics as metric_sql
from .oracle import sql
from .plans import report
from .plans import walk_forward as wf
from .plans.config import config_from
from .plans.store import keep
from .sources.bars import bars_from_events
from .sources.calendar import bar_grid, day_calendar, filter_regular_hours, xnys_calendar

CONFIG = config_from({
    "bar_interval": "15m", "context_bars": 4, "horizons_minutes": [15, 30, 60], "features": {"realized_vol_window": 4},
    "retrieval": {"k": 10}, "walk_forward": {"min_training_sessions": 10}, "hmm": {"n_states": 3, "covariance_type": "diag", "tol": 1e-2, "n_iter": 300},
    "bootstrap": {"n_resamples": 100},
})
SECONDS = CONFIG.bar_minutes * 60
FEATURES = CONFIG.features.columns
#: Parameters of the two-state model that the filter queries use.
MODEL = {"means": [[-0.5, -0.5], [0.5, 0.8]], "covariances": [[[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], [0.0, 1.5]]], "transitions": [[0.9, 0.1], [0.2, 0.8]], "start": [0.6, 0.4]}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Resamples of the registered bootstrap, as many as the reference draws.
RESAMPLES = 1000
_EVALUATIONS: dict[tuple, wf.WalkForward] = {}
_PREDICTIONS: dict[tuple[str, str], DataFrame] = {}


def bars(spark, d):
    return bars_from_events(_table(spark, d, "events"), CONFIG.bar_minutes)


def segments(spark, d):
    return ops.with_segments(bars(spark, d), CONFIG.bar_minutes)


def grid(spark):
    return bar_grid(day_calendar(spark, date(2024, 1, 1), date(2024, 1, 30)), CONFIG.bar_minutes)


def evaluation(spark, d, config=CONFIG) -> wf.WalkForward:
    """Tables of one walk-forward run, computed once per session, input and configuration."""
    key = (spark.sparkContext.applicationId, d, config)
    if key not in _EVALUATIONS:
        _EVALUATIONS[key] = _evaluation(spark, d, config)
    return _EVALUATIONS[key]


def _evaluation(spark, d, config) -> wf.WalkForward:
    return wf.plan(ops.with_segments(bars_from_events(_table(spark, d, "events"), config.bar_minutes), config.bar_minutes), config)


def _r(*names: str, digits: int = 8):
    return [rounded(F.col(n), digits).alias(n) for n in names]


def _rs(*names: str, digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _tied(text: str) -> str:
    """The oracle's rounding with the offset of ``rounded``."""
    return re.sub(r", (\d)\) \+ 0\.0 AS", lambda m: f" + {nudge(int(m[1]))!r}, {m[1]}) + 0.0 AS", text)


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of a walk-forward run on hourly bars, which the smallest table can fill."""
    config = config_from({
        "bar_interval": "60m", "context_bars": 3, "horizons_minutes": [60, 120], "features": {"realized_vol_window": 3}, "retrieval": {"k": 10},
        "walk_forward": {"min_training_sessions": 10}, "sensitivity": {"embargo_sessions": [0, 1]},
    })
    return metrics.metric_table(wf.forecasts(evaluation(spark, d, config)), ["embargo_sessions", "method", "horizon_minutes"])


# ---- bars, grid, validation --------------------------------------------------


def q_bars(spark, d):
    return bars(spark, d).select("t", "session_index", "minute_of_session", *_r("open", "high", "low", "close", "volume", "vwap"))


def q_bar_range(spark, d):
    return _table(spark, d, "events").where(F.col("ts").between(F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-06").cast("timestamp_ntz"))).select("event_id", "user_id", "event_type", "value")


def q_quality(spark, d):
    return ops.quality_counts(bars(spark, d))


def q_coverage(spark, d):
    return ops.session_coverage(bars(spark, d), grid(spark)).select("session", "expected", "observed", "missing", *_r("coverage"))


def q_gaps(spark, d):
    return ops.largest_gaps(bars(spark, d))


def q_grid(spark, d):
    return grid(spark)


def q_xnys(spark, d):
    return bar_grid(xnys_calendar(spark, date(2024, 1, 1), date(2024, 12, 31)), 5).groupBy("session", "session_index").agg(F.count("*").alias("bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("minute_of_session").alias("last_minute"))


def q_off_grid(spark, d):
    shifted = bars(spark, d).withColumn("t", F.when(F.col("minute_of_session") == 0, F.col("t") + 60).otherwise(F.col("t")))
    return ops.off_grid(shifted, grid(spark)).select("t", "session_index")


def q_rth(spark, d):
    hours = grid(spark).where("minute_of_session >= 570 and minute_of_session < 960")
    return filter_regular_hours(bars(spark, d), hours, CONFIG.bar_minutes).select("t", "session_index", "minute_of_session", *_r("close"))


def q_segments(spark, d):
    return segments(spark, d).select("t", "session_index", "segment_id")


# ---- features, labels, preprocessing ----------------------------------------


def features(spark, d):
    return ops.causal_features(segments(spark, d), CONFIG.features.realized_vol_window)


def q_features(spark, d):
    return features(spark, d).select("t", "day_of_week", *_r("log_return", "realized_volatility", "range_fraction", "session_vwap", "vwap_distance", digits=6))


def q_labels(spark, d):
    rows = ops.recent_return(ops.forward_labels(segments(spark, d), CONFIG.horizon_bars), CONFIG.context_bars)
    return rows.select("t", *_r("return_15m", "return_30m", "return_60m", "recent_return"), "outcome_end_15m", "outcome_end_30m", "outcome_end_60m")


def q_blocks(spark, d):
    return wf.refit_blocks(segments(spark, d), "weekly", 10)


def q_folds(spark, d):
    b = segments(spark, d)
    return wf.fold_map(b, wf.refit_blocks(b, "weekly", 10), "weekly", 3)


def q_seasonality(spark, d):
    return preprocessing.volume_statistics(evaluation(spark, d).panel).select("refit_id", "minute_of_session", *_r("slot_median", "slot_mad", "slot_scale"))


def q_scaler(spark, d):
    w = evaluation(spark, d)
    raw = w.panel.withColumns({c: F.col(f"raw_{c}") for c in FEATURES})
    return preprocessing.scaler_statistics(raw, FEATURES).select("refit_id", "feature", *_r("mean", "scale"), "n")


def q_standardized(spark, d):
    return evaluation(spark, d).panel.select("refit_id", "t", "is_train", *_r(*FEATURES, digits=6))


def q_contexts(spark, d):
    size = F.size("context")
    total = F.aggregate("context", F.lit(0.0), lambda s, x: s + x)
    return evaluation(spark, d).contexts.select("refit_id", "t", "context_start", size.alias("n_values"), rounded(total, 6).alias("total"), rounded(F.element_at("context", -1), 6).alias("last_value"))


# ---- availability, cohorts, neighbours ---------------------------------------


def q_eligible(spark, d):
    w = evaluation(spark, d)
    pairs = wf.unconditional_pairs(w, wf.common_queries(w))
    return pairs.groupBy("refit_id", "q_t", "embargo_sessions").agg(F.count("*").alias("n_candidates"), F.min("c_t").alias("first_c"), F.max("c_t").alias("last_c"))


def q_same_time(spark, d):
    return wf.same_time_pairs(evaluation(spark, d)).groupBy("refit_id", "q_t", "embargo_sessions").agg(F.count("*").alias("n_candidates"))


def q_common(spark, d):
    return wf.common_queries(evaluation(spark, d)).select("refit_id", "q_t", "q_session", "q_minute", *_r("recent_return"))


def q_neighbors(spark, d):
    w = evaluation(spark, d)
    return wf.neighbor_pairs(w, wf.common_queries(w)).select("refit_id", "q_t", "embargo_sessions", "rank", "c_t", "c_session", *_r("distance", digits=6), *_r("return_15m"))


def _embedding_knn(spark, d, metric):
    v = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("v"))
    q = v.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return rt.exact_knn(q, v, 10, 3, metric).select("q", "id", "grp", *_r("distance", digits=6), "rank")


def q_knn_euclidean(spark, d):
    return _embedding_knn(spark, d, "euclidean")


def q_knn_cosine(spark, d):
    return _embedding_knn(spark, d, "cosine")


# ---- forecasts ---------------------------------------------------------------

FORECAST = ["refit_id", "q_t", "embargo_sessions", "horizon_minutes", "method", "effective_neighbor_count"]
VALUES = ["mean", "median", "probability_up", "q10", "q25", "q75", "q90", "return_std", "distance_mean", "distance_min", "distance_max", "actual_return", "realized_percentile"]


def _forecast(spark, d, method):
    w = evaluation(spark, d)
    queries = wf.common_queries(w)
    own = queries.select("refit_id", "q_t")
    if method == "momentum":
        rows = rt.momentum_forecast(queries.withColumn("embargo_sessions", F.explode(F.lit(w.config.embargoes).cast("array<int>"))), w.config.horizon_bars, w.config.context_bars, wf.KEYS)
    else:
        cohort = {
            "unconditional": lambda: wf.unconditional_pairs(w, queries), "raw_knn": lambda: wf.neighbor_pairs(w, queries),
            "same_time_of_day": lambda: wf.same_time_pairs(w).join(own, ["refit_id", "q_t"], "left_semi"),
        }[method]()
        rows = rt.cohort_forecast(cohort, queries, method, w.horizons, wf.KEYS, "distance" if method == "raw_knn" else None)
    return rows.select(*FORECAST, *_r(*VALUES, digits=7))


def q_unconditional(spark, d):
    return _forecast(spark, d, "unconditional")


def q_same_time_forecast(spark, d):
    return _forecast(spark, d, "same_time_of_day")


def q_momentum(spark, d):
    return _forecast(spark, d, "momentum")


def q_raw_knn(spark, d):
    return _forecast(spark, d, "raw_knn")


def predictions(spark, d):
    """Rows of three methods; computed once per session and input, as one run scores one set of forecasts."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PREDICTIONS:
        _PREDICTIONS[key] = wf.forecasts(evaluation(spark, d), methods=("same_time_of_day", "raw_knn", "momentum"))
        _PREDICTIONS[key] = keep(_PREDICTIONS[key], "predictions")
    return _PREDICTIONS[key]


def q_predictions(spark, d):
    return predictions(spark, d).select(*FORECAST, "fold", "q_session", "outcome_end", *_r("median", "actual_return", digits=7))


METRICS = ["mae", "rmse", "mean_signed_error", "brier", "interval_10_90_width", "interval_10_90_coverage"]


def _metrics(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.select(*keys, "n_forecasts", "n_sessions", "query_start", "query_end", *_r(*METRICS), *_r("log_loss", "effective_neighbor_count_mean", "spearman", digits=6), "n_intervals")


def q_metrics(spark, d):
    rows = predictions(spark, d).where("embargo_sessions = 1")
    return _metrics(metrics.metric_table(rows, ["method", "horizon_minutes"]), ["method", "horizon_minutes"])


def q_fold_metrics(spark, d):
    keys = ["fold", "method", "horizon_minutes"]
    return _metrics(metrics.metric_table(predictions(spark, d).where("embargo_sessions = 1"), keys), keys)


def q_calibration(spark, d):
    rows = metrics.calibration(predictions(spark, d).where("embargo_sessions = 1"))
    return rows.select("method", "horizon_minutes", "bin", "n_forecasts", "n_sessions", *_r("bin_lower", "bin_upper", "mean_probability_up", "observed_up_frequency"))


def q_sensitivity(spark, d):
    return _metrics(metrics.sensitivity(predictions(spark, d)), ["embargo_sessions", "fold", "method", "horizon_minutes"])


def q_paired(spark, d):
    return metrics.paired_differences(predictions(spark, d)).select("embargo_sessions", "horizon_minutes", "control", "n_forecasts", "n_sessions", *_r("mean_absolute_error_difference", "mean_squared_error_difference"))


def q_cohorts(spark, d):
    return metrics.cohort_violations(predictions(spark, d))


MODELS = ("same_time_of_day", "momentum")


def q_cluster_sums(spark, d):
    return bootstrap.cluster_sums(predictions(spark, d), MODELS).select("embargo_sessions", "horizon_minutes", "fold", "q_session", "model", "loss", "n", *_r("total", digits=7))


def _bootstrap(spark, d):
    sums = keep(bootstrap.cluster_sums(predictions(spark, d), MODELS), "sums")
    return bootstrap.bootstrap_intervals(sums, bootstrap.multiplicities(sums, RESAMPLES, CONFIG.random_state), 0.95, RESAMPLES)


def q_bootstrap(spark, d):
    names = ["embargo_sessions", "horizon_minutes", "fold", "model", "loss", "n_forecasts", "n_sessions", "status"]
    return _bootstrap(spark, d).select(*names, *_r("mean_difference", "ci_lower", "ci_upper", digits=7))


def q_bootstrap_means(spark, d):
    """The part of the bootstrap that does not depend on draws."""
    return q_bootstrap(spark, d).drop("ci_lower", "ci_upper")


def q_multiplicities(spark, d):
    """What is drawn: how often each session, over the first resamples."""
    sums = bootstrap.cluster_sums(predictions(spark, d), MODELS)
    return bootstrap.multiplicities(sums, 10, CONFIG.random_state)


def q_query_coverage(spark, d):
    return report.query_coverage(predictions(spark, d))


def q_conclusion(spark, d):
    table = _bootstrap(spark, d).where("model = 'momentum' and loss = 'absolute_error' and embargo_sessions = 1")
    return bootstrap.conclusion(table, [15, 30, 60], 3)


# ---- hidden states -----------------------------------------------------------


def filtered(spark, d):
    w = evaluation(spark, d)
    two = ["log_return", "range_fraction"]
    return w, hmm.fixed_filter(w.panel, two, MODEL, SECONDS)


def q_filter(spark, d):
    _, rows = filtered(spark, d)
    return rows.select("refit_id", "t", *(rounded(F.get("posterior", F.lit(k)), 6).alias(f"p{k}") for k in range(2)))


def _training_posteriors(spark, d):
    w, rows = filtered(spark, d)
    return w.panel.where("is_train").join(rows, ["refit_id", "t"])


def q_occupancy(spark, d):
    return hmm.state_summaries(_training_posteriors(spark, d), ["log_return", "range_fraction"]).select("refit_id", "state", "flag", *_r("occupancy", "mean_log_return", "mean_range_fraction", digits=6))


def q_occupancy_by_sign(spark, d):
    return hmm.conditional_occupancy(_training_posteriors(spark, d), F.signum("raw_log_return")).select("refit_id", "label", "state", *_r("probability", digits=6))


def q_occupancy_by_volatility(spark, d):
    rows = hmm.volatility_buckets(_training_posteriors(spark, d), "raw_realized_volatility")
    return hmm.conditional_occupancy(rows, F.col("bucket")).select("refit_id", "label", "state", *_r("probability", digits=6))


def q_clock(spark, d):
    by_minute = hmm.conditional_occupancy(_training_posteriors(spark, d), F.col("minute_of_session"))
    return hmm.clock_concentration(by_minute).select("refit_id", "state", "concentrated", "minutes", *_r("most", "least", digits=6))


def q_hmm_fit(spark, d):
    return wf.fit_models(evaluation(spark, d)).select("refit_id", "status", "covariance_type", "selected_seed", F.size("means").alias("n_states"))


def q_hmm_forecasts(spark, d):
    w = evaluation(spark, d)
    models = keep(wf.fit_models(w), "models")
    return wf.forecasts(w, models, ()).select(*FORECAST, *_r("median", "actual_return"))


# ---- trading, audit ----------------------------------------------------------


def _trading(spark, d):
    rows = predictions(spark, d).where("embargo_sessions = 1 and method in ('momentum', 'same_time_of_day')").select("method", "horizon_minutes", "q_t", "outcome_end", "median")
    b = segments(spark, d)
    return b, rows, keep(trading.trades(b, rows, 0.0, 1.0, SECONDS), "trades")


def q_trades(spark, d):
    return _trading(spark, d)[2].select("method", "horizon_minutes", "q_t", "entry_t", F.col("outcome_end").alias("exit_t"), "holding_bars", *_r("entry_price", "exit_price", "gross_return", "net_return", digits=6))


def q_equity(spark, d):
    return trading.equity(*_trading(spark, d)).select("method", "horizon_minutes", "session", "t", *(F.round(F.log(c), 5).alias(f"ln_{c}") for c in ("gross_equity", "net_equity")))


def q_trading_metrics(spark, d):
    b, rows, done = _trading(spark, d)
    table = trading.trading_metrics(trading.equity(b, rows, done), done, 1.0)
    return table.select("method", "horizon_minutes", "n_trades", "n_sessions", "n_bars", F.round("sharpe", 5).alias("sharpe"), F.round(F.log1p("turnover"), 5).alias("ln_turnover"), *_r("hit_rate", "average_holding_return", "time_in_market", "max_drawdown", digits=6), F.round(F.log("net_equity"), 5).alias("ln_net"))


def _audit_tables(spark, d):
    """(bars with outcomes, forecasts, their neighbours) of the methods that ``predictions`` holds."""
    w = evaluation(spark, d)
    key = (spark.sparkContext.applicationId, d, "neighbors")
    if key not in _PREDICTIONS:
        _PREDICTIONS[key] = keep(wf.neighbor_audit(w, wf.common_queries(w), methods=("same_time_of_day", "raw_knn")), "neighbors")
    return w.bars, predictions(spark, d), _PREDICTIONS[key], w.horizons, w.config.retrieval.k, w.config.retrieval.max_neighbors_per_session


def q_audit(spark, d):
    return audit.violations(*_audit_tables(spark, d))


def planted_predictions(p: DataFrame) -> DataFrame:
    """Forecasts with faults of every kind, at places that the numbers of a row tell."""
    on = lambda n, more="true": F.expr(f"q_t div 900 % 97 = {n} and {more}")
    p = p.where(~on(1, "method = 'momentum' and horizon_minutes = 15 and embargo_sessions = 0"))
    p = p.withColumns({
        "actual_return": F.when(on(2, "method = 'raw_knn' and horizon_minutes = 30"), F.col("actual_return") + 1).when(on(3, "method = 'momentum'"), F.lit(float("inf"))).otherwise(F.col("actual_return")),
        "probability_up": F.when(on(4, "method = 'raw_knn'"), 1.5).otherwise(F.col("probability_up")),
        "fold": F.when(on(5, "method = 'raw_knn' and embargo_sessions = 0"), F.col("fold") - 10).otherwise(F.col("fold")),
        "q_session": F.when(on(6, "method = 'raw_knn' and embargo_sessions = 1"), F.col("q_session") + 1000).otherwise(F.col("q_session")),
        "query_model_id": F.when(on(7), F.lit("other")).otherwise(F.col("query_model_id")),
        "latest_feature_t": F.when(on(8), F.col("q_t") + 1).otherwise(F.col("latest_feature_t")),
        "fit_end": F.when(on(9), F.col("refit_block_start")).otherwise(F.col("fit_end")),
        "effective_neighbor_count": F.when(on(10, "method = 'raw_knn'"), F.col("effective_neighbor_count") + 1).otherwise(F.col("effective_neighbor_count")),
    })
    return p.unionByName(p.where(on(11, "method = 'raw_knn' and embargo_sessions = 0")))


def planted_neighbors(n: DataFrame) -> DataFrame:
    """Neighbours with faults of every kind, at places that the numbers of a row tell."""
    on = lambda k, more="true": F.expr(f"q_t div 900 % 89 = {k} and {more}")
    n = n.withColumns({
        "return_30m": F.when(on(1, "rank = 1"), F.col("return_30m") + 1).otherwise(F.col("return_30m")),
        "outcome_end_60m": F.when(on(2, "rank = 2"), F.col("q_t") + 60).otherwise(F.col("outcome_end_60m")),
        "c_session": F.when(on(3, "rank = 1 and embargo_sessions = 5"), F.col("query_session_index") - 5).otherwise(F.col("c_session")),
        "fit_end": F.when(on(4, "rank = 3"), F.col("q_t")).otherwise(F.col("fit_end")),
        "neighbor_model_id": F.when(on(5, "rank = 1"), F.lit("other")).otherwise(F.col("neighbor_model_id")),
        "c_t": F.when(on(6, "rank = 1"), F.col("q_t")).otherwise(F.col("c_t")),
    })
    return n.unionByName(n.where(on(7, "rank <= 4 and method = 'raw_knn'")))


def q_audit_planted(spark, d):
    """The audit over tables with planted faults."""
    bars, p, n, *limits = _audit_tables(spark, d)
    return audit.violations(bars, planted_predictions(p), planted_neighbors(n), *limits)


def q_cohorts_planted(spark, d):
    return metrics.cohort_violations(planted_predictions(predictions(spark, d)))


def q_prefix(spark, d):
    """Forecasts of a run that ends early differ nowhere from those of the whole run."""
    return audit.prefix_differences(_prefix_run(spark, d), predictions(spark, d))


def _prefix_run(spark, d):
    events = _table(spark, d, "events")
    part = wf.plan(ops.with_segments(bars_from_events(events.where("ts < timestamp_ntz'2024-01-22 00:00:00'"), CONFIG.bar_minutes), CONFIG.bar_minutes), CONFIG)
    return wf.forecasts(part, methods=("same_time_of_day", "raw_knn", "momentum"))


def q_prefix_planted(spark, d):
    """What the comparison finds where the longer run was changed and has lost rows."""
    whole = predictions(spark, d).where("not (q_t div 900 % 53 = 1 and method = 'raw_knn')")
    changed = whole.withColumn("median", F.when(F.expr("q_t div 900 % 53 = 2 and horizon_minutes = 15"), F.col("median") + 1).otherwise(F.col("median")))
    return audit.prefix_differences(_prefix_run(spark, d), changed)


QUERIES = {
    "bars_from_events": q_bars, "events_between": q_bar_range, "bar_quality_report": q_quality, "session_coverage": q_coverage, "largest_gaps": q_gaps,
    "calendar_grid": q_grid, "xnys_calendar": q_xnys, "off_grid_rows": q_off_grid, "rth_filter": q_rth, "segments": q_segments,
    "causal_features": q_features, "forward_returns": q_labels, "refit_blocks": q_blocks, "planned_folds": q_folds, "volume_seasonality": q_seasonality,
    "feature_scaler": q_scaler, "standardized_features": q_standardized, "contexts": q_contexts, "eligible_counts_by_embargo": q_eligible,
    "same_time_counts": q_same_time, "common_cohort": q_common, "neighbors": q_neighbors, "knn_euclidean": q_knn_euclidean, "knn_cosine": q_knn_cosine,
    "unconditional_forecast": q_unconditional, "same_time_forecast": q_same_time_forecast, "momentum_forecast": q_momentum, "raw_knn_forecast": q_raw_knn,
    "predictions": q_predictions, "forecast_metrics": q_metrics, "fold_metrics": q_fold_metrics, "calibration": q_calibration, "sensitivity": q_sensitivity,
    "paired_differences": q_paired, "cohort_violations": q_cohorts, "bootstrap_cluster_sums": q_cluster_sums, "bootstrap_ci": q_bootstrap, "multiplicities": q_multiplicities, "bootstrap_means": q_bootstrap_means, "query_coverage": q_query_coverage, "conclusion": q_conclusion,
    "hmm_filter_fixed": q_filter, "state_occupancy": q_occupancy, "occupancy_by_sign": q_occupancy_by_sign, "occupancy_by_volatility": q_occupancy_by_volatility,
    "clock_concentration": q_clock, "hmm_fit_walk_forward": q_hmm_fit, "hmm_forecasts": q_hmm_forecasts, "trades": q_trades, "equity_curve": q_equity,
    "trading_metrics": q_trading_metrics, "audit_violations": q_audit, "prefix_invariance": q_prefix, "audit_planted": q_audit_planted, "cohorts_planted": q_cohorts_planted, "prefix_planted": q_prefix_planted,
}

_FORECAST_SQL = "SELECT refit_id, q_t, embargo_sessions, horizon_minutes, method, effective_neighbor_count, " + _rs(*VALUES, digits=7) + " FROM "
_KNN_SQL = """WITH v AS (SELECT vec_id AS id, label AS grp, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.id AS q, b.id, b.grp, {} AS distance FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 10 = 0)
SELECT q, id, grp, round(distance, 6) + 0.0 AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q, grp ORDER BY distance, id) AS k FROM p) WHERE k <= 3) WHERE rank <= 10"""
_HOLIDAYS = "('2024-01-01'), ('2024-01-15'), ('2024-02-19'), ('2024-03-29'), ('2024-05-27'), ('2024-06-19'), ('2024-07-04'), ('2024-09-02'), ('2024-11-28'), ('2024-12-25')"

ORACLE_SQL = {
    "bars_from_events": sql("SELECT t, session_index, minute_of_session, " + _rs("open", "high", "low", "close", "volume", "vwap") + " FROM bars"),
    "events_between": "SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06'",
    "bar_quality_report": sql("""SELECT count(*) AS n_bars, count(t) - count(DISTINCT t) AS n_duplicates, (count(*) - count(t)) AS n_null_timestamps, count(*) FILTER (NOT coalesce(open > 0, false)) AS bad_open, count(*) FILTER (NOT coalesce(high > 0, false)) AS bad_high,
        count(*) FILTER (NOT coalesce(low > 0, false)) AS bad_low, count(*) FILTER (NOT coalesce(close > 0, false)) AS bad_close, count(*) FILTER (NOT coalesce(volume >= 0, false)) AS bad_volume,
        count(*) FILTER (low > high OR open < low OR open > high OR close < low OR close > high) AS ohlc_violations, count(*) FILTER (NOT coalesce(vwap > 0, false)) AS bad_vwap, min(t) AS first_t, max(t) AS last_t FROM bars"""),
    "session_coverage": sql("SELECT g.session, count(*) AS expected, count(b.t) AS observed, count(*) - count(b.t) AS missing, round(count(b.t) / count(*), 8) + 0.0 AS coverage FROM grid g LEFT JOIN bars b ON g.t = b.t GROUP BY g.session"),
    "largest_gaps": sql("SELECT * FROM (SELECT lag(t) OVER (ORDER BY t) AS start_t, t AS end_t, t - lag(t) OVER (ORDER BY t) AS seconds FROM bars) WHERE start_t IS NOT NULL ORDER BY seconds DESC, end_t LIMIT 10"),
    "calendar_grid": sql("SELECT t, session, session_index, minute_of_session FROM grid"),
    "xnys_calendar": f"""WITH days AS (SELECT d::DATE AS session FROM range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY) r(d) WHERE isodow(d) < 6 AND d::DATE NOT IN (SELECT h::DATE FROM (VALUES {_HOLIDAYS}) x(h))),
        hours AS (SELECT session, (row_number() OVER (ORDER BY session) - 1)::INT AS session_index, CASE WHEN session IN (DATE '2024-07-03', DATE '2024-11-29', DATE '2024-12-24') THEN 210 ELSE 390 END AS minutes,
        epoch(session::TIMESTAMP)::BIGINT + 34200 + CASE WHEN session >= DATE '2024-03-10' AND session < DATE '2024-11-03' THEN 14400 ELSE 18000 END AS open_t FROM days)
        SELECT session, session_index, (minutes / 5)::BIGINT AS bars, open_t + 300 AS first_t, open_t + minutes * 60 AS last_t, (minutes - 5)::INT AS last_minute FROM hours""",
    "off_grid_rows": sql("SELECT t + 60 AS t, session_index FROM bars WHERE minute_of_session = 0"),
    "rth_filter": sql("SELECT t, session_index, minute_of_session, " + _rs("close") + " FROM bars WHERE minute_of_session >= 570 AND minute_of_session < 960"),
    "segments": sql("SELECT t, session_index, segment_id FROM seg"),
    "causal_features": sql("SELECT t, (isodow(session) - 1)::INT AS day_of_week, " + _rs("log_return", "realized_volatility", "range_fraction", "session_vwap", "vwap_distance", digits=6) + " FROM feat"),
    "forward_returns": sql("SELECT t, round(r15, 8) + 0.0 AS return_15m, round(r30, 8) + 0.0 AS return_30m, round(r60, 8) + 0.0 AS return_60m, " + _rs("recent_return") + ", e15 AS outcome_end_15m, e30 AS outcome_end_30m, e60 AS outcome_end_60m FROM lab"),
    "refit_blocks": sql("SELECT refit_id, first_t, last_t, n_bars, block, n_train_sessions, accepted FROM blocks"),
    "planned_folds": sql("SELECT session, fold FROM folds"),
    "volume_seasonality": sql("SELECT refit_id, minute_of_session, round(m, 8) + 0.0 AS slot_median, round(d, 8) + 0.0 AS slot_mad, round(s, 8) + 0.0 AS slot_scale FROM slots"),
    "feature_scaler": sql("SELECT refit_id, feature, " + _rs("mean", "scale") + ", n FROM stat"),
    "standardized_features": sql("SELECT refit_id, t, is_train, " + ", ".join(f"round(z{k}, 6) + 0.0 AS {c}" for k, c in enumerate(FEATURES)) + " FROM panel"),
    "contexts": sql("SELECT refit_id, t, context_start, len(vec)::INT AS n_values, round(list_sum(vec), 6) + 0.0 AS total, round(vec[-1], 6) + 0.0 AS last_value FROM ctx"),
    "eligible_counts_by_embargo": sql("SELECT refit_id, q_t, embargo_sessions, count(*) AS n_candidates, min(c_t) AS first_c, max(c_t) AS last_c FROM pairs_e GROUP BY ALL"),
    "same_time_counts": sql("SELECT refit_id, q_t, embargo_sessions, count(*) AS n_candidates FROM same GROUP BY ALL"),
    "common_cohort": sql("SELECT refit_id, q_t, q_session, q_minute, " + _rs("recent_return") + " FROM cq"),
    "neighbors": sql("SELECT refit_id, q_t, embargo_sessions, rank, c_t, c_session, round(distance, 6) + 0.0 AS distance, round(r15, 8) + 0.0 AS return_15m FROM near"),
    "knn_euclidean": _KNN_SQL.format("list_distance(a.v, b.v)"),
    "knn_cosine": _KNN_SQL.format("list_cosine_distance(a.v, b.v)"),
    "unconditional_forecast": sql(_FORECAST_SQL + "f_all"),
    "same_time_forecast": sql(_FORECAST_SQL + "f_same"),
    "momentum_forecast": sql(_FORECAST_SQL + "f_mom"),
    "raw_knn_forecast": sql(_FORECAST_SQL + "f_near"),
    "predictions": sql("SELECT refit_id, q_t, embargo_sessions, horizon_minutes, method, effective_neighbor_count, fold, q_session, outcome_end, " + _rs("median", "actual_return", digits=7) + " FROM pred"),
    "forecast_metrics": sql(metric_sql("(SELECT * FROM loss WHERE embargo_sessions = 1)", "method, horizon_minutes")),
    "fold_metrics": sql(metric_sql("(SELECT * FROM loss WHERE embargo_sessions = 1)", "fold, method, horizon_minutes")),
    "calibration": sql("""SELECT k.method, k.horizon_minutes, k.bin, coalesce(n, 0) AS n_forecasts, coalesce(s, 0) AS n_sessions, round(k.bin / 10, 8) + 0.0 AS bin_lower, round((k.bin + 1) / 10, 8) + 0.0 AS bin_upper, round(p, 8) + 0.0 AS mean_probability_up, round(u, 8) + 0.0 AS observed_up_frequency
        FROM (SELECT DISTINCT method, horizon_minutes, b::INT AS bin FROM loss CROSS JOIN range(0, 10) r(b)) k LEFT JOIN (SELECT method, horizon_minutes, least(trunc(probability_up * 10)::INT, 9) AS bin, count(*) AS n, count(DISTINCT q_session) AS s, avg(probability_up) AS p, avg((actual_return > 0)::INT::DOUBLE) AS u
        FROM loss WHERE embargo_sessions = 1 GROUP BY ALL) x USING (method, horizon_minutes, bin)"""),
    "sensitivity": sql(metric_sql("sub", "embargo_sessions, fold, method, horizon_minutes")),
    "paired_differences": sql("""SELECT embargo_sessions, horizon_minutes, o.method AS control, count(*) AS n_forecasts, count(DISTINCT r.q_session) AS n_sessions, round(avg(r.absolute_error - o.absolute_error), 8) + 0.0 AS mean_absolute_error_difference,
        round(avg(r.squared_error - o.squared_error), 8) + 0.0 AS mean_squared_error_difference FROM loss r JOIN loss o USING (embargo_sessions, horizon_minutes, q_t) WHERE r.method = 'raw_knn' AND o.method <> 'raw_knn' GROUP BY ALL"""),
    "cohort_violations": "SELECT unnest(['duplicates', 'unequal_methods', 'outcomes_disagree', 'sessions_disagree', 'folds_disagree', 'session_in_two_folds', 'missing_identity', 'bad_integers', 'outcome_not_finite', 'probability_out_of_range', 'embargoes_unpaired']) AS violation, 0::BIGINT AS n",
    "bootstrap_cluster_sums": sql("""SELECT embargo_sessions, horizon_minutes, fold, q_session, model, loss_name AS loss, count(*) AS n, round(sum(v), 7) + 0.0 AS total FROM (UNPIVOT (SELECT o.embargo_sessions, o.horizon_minutes, o.fold, o.q_session, o.method AS model, o.absolute_error - r.absolute_error AS absolute_error,
        o.squared_error - r.squared_error AS squared_error, o.brier - r.brier AS brier FROM sub o JOIN sub r USING (embargo_sessions, horizon_minutes, fold, q_t) WHERE r.method = 'raw_knn' AND o.method <> 'raw_knn') ON absolute_error, squared_error, brier INTO NAME loss_name VALUE v) GROUP BY ALL"""),
    "audit_violations": "SELECT unnest(" + str(list(audit.CHECKS)) + ") AS violation, 0::BIGINT AS n",
    "audit_planted": sql(oracle.audit_planted(CONFIG.retrieval.k, CONFIG.retrieval.max_neighbors_per_session)), "cohorts_planted": sql(oracle.cohorts_planted()), "prefix_planted": sql(oracle.prefix_planted(1705881600)),
    "prefix_invariance": "SELECT unnest(['missing', 'added']) AS difference, 0::BIGINT AS n",
}
_DENSITY = lambda mean, var: f"-0.5 * ({2} * ln(2 * pi()) + ln({var[0]}) + ln({var[1]}) + (z0 - ({mean[0]})) ** 2 / {var[0]} + (z2 - ({mean[1]})) ** 2 / {var[1]})"
_FILTER_STEPS = f"""fin AS MATERIALIZED (SELECT *, z0 IS NOT NULL AND z2 IS NOT NULL AS ok FROM panel),
seqs AS MATERIALIZED (SELECT * FROM (SELECT *, sum(CASE WHEN lag_ok AND same AND near THEN 0 ELSE 1 END) OVER (PARTITION BY refit_id ORDER BY t) AS seq FROM (SELECT *, coalesce(lag(ok) OVER w, false) AS lag_ok,
coalesce(lag(segment_id) OVER w = segment_id, false) AS same, coalesce(t - lag(t) OVER w = 900, false) AS near FROM fin WINDOW w AS (PARTITION BY refit_id ORDER BY t))) WHERE ok),
obs AS MATERIALIZED (SELECT refit_id, seq, t, row_number() OVER (PARTITION BY refit_id, seq ORDER BY t) AS i, {_DENSITY([-0.5, -0.5], [1.0, 1.0])} AS d0, {_DENSITY([0.5, 0.8], [2.0, 1.5])} AS d1 FROM seqs),
step(refit_id, seq, i, t, p0) AS (SELECT refit_id, seq, i, t, 0.6 * exp(d0) / (0.6 * exp(d0) + 0.4 * exp(d1)) FROM obs WHERE i = 1 UNION ALL
SELECT o.refit_id, o.seq, o.i, o.t, 1 / (1 + (s.p0 * 0.1 + (1 - s.p0) * 0.8) * exp(o.d1 - o.d0) / (s.p0 * 0.9 + (1 - s.p0) * 0.2)) FROM step s JOIN obs o ON o.refit_id = s.refit_id AND o.seq = s.seq AND o.i = s.i + 1)"""


def _with_filter(final: str) -> str:
    chain = sql("SELECT * FROM panel")
    return chain[: chain.rindex(") SELECT * FROM panel") + 1].replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _FILTER_STEPS + " " + final


_LONG = "(SELECT f.*, k AS state, CASE k WHEN 0 THEN p0 ELSE 1 - p0 END AS p FROM fin f JOIN step USING (refit_id, t) CROSS JOIN range(0, 2) r(k) WHERE is_train)"
ORACLE_SQL |= {
    "hmm_filter_fixed": _with_filter("SELECT refit_id, t, round(p0, 6) + 0.0 AS p0, round(1 - p0, 6) + 0.0 AS p1 FROM step"),
    "state_occupancy": _with_filter(f"SELECT refit_id, state::INT AS state, CASE WHEN avg(p) < 0.01 THEN 'low_occupancy' WHEN avg(p) > 0.95 THEN 'dominant_occupancy' END AS flag, round(avg(p), 6) + 0.0 AS occupancy, round(sum(p * z0) / sum(p), 6) + 0.0 AS mean_log_return, round(sum(p * z2) / sum(p), 6) + 0.0 AS mean_range_fraction FROM {_LONG} GROUP BY ALL"),
    "occupancy_by_sign": _with_filter(f"SELECT refit_id, sign(log_return)::DOUBLE AS label, state::INT AS state, round(avg(p), 6) + 0.0 AS probability FROM {_LONG} WHERE log_return IS NOT NULL GROUP BY ALL"),
    "occupancy_by_volatility": _with_filter(f"""SELECT x.refit_id, ((realized_volatility >= a)::INT + (realized_volatility >= b)::INT) AS label, state::INT AS state, round(avg(p), 6) + 0.0 AS probability FROM {_LONG} x JOIN (SELECT refit_id, quantile_cont(realized_volatility, 1.0/3) AS a, quantile_cont(realized_volatility, 2.0/3) AS b
        FROM {_LONG} WHERE state = 0 AND realized_volatility IS NOT NULL GROUP BY refit_id) e USING (refit_id) WHERE realized_volatility IS NOT NULL GROUP BY ALL"""),
    "clock_concentration": _with_filter(f"""SELECT refit_id, state::INT AS state, max(pr) >= 0.8 AND max(pr) - min(pr) >= 0.5 AS concentrated, coalesce(string_agg(minute_of_session::VARCHAR, ',' ORDER BY minute_of_session) FILTER (pr >= 0.8), '') AS minutes, round(max(pr), 6) + 0.0 AS most, round(min(pr), 6) + 0.0 AS least
        FROM (SELECT refit_id, state, minute_of_session, avg(p) AS pr FROM {_LONG} GROUP BY ALL) GROUP BY ALL"""),
}
_TRADE_STEPS = """sig AS MATERIALIZED (SELECT method, horizon_minutes, q_t, outcome_end, median FROM pred WHERE embargo_sessions = 1 AND method IN ('momentum', 'same_time_of_day')),
nxt AS MATERIALIZED (SELECT t, segment_id, lead(t) OVER w AS entry_t, lead(open) OVER w AS entry_price FROM seg WINDOW w AS (PARTITION BY segment_id ORDER BY t)),
poss AS MATERIALIZED (SELECT s.method, s.horizon_minutes, s.q_t, n.entry_t, s.outcome_end AS exit_t, n.entry_price, x.close AS exit_price, row_number() OVER (PARTITION BY s.method, s.horizon_minutes ORDER BY s.q_t) AS i FROM sig s JOIN nxt n ON n.t = s.q_t JOIN seg x ON x.t = s.outcome_end AND x.segment_id = n.segment_id
WHERE s.median > 0 AND n.entry_t IS NOT NULL AND s.outcome_end >= n.entry_t AND x.session_index <= (SELECT max(session_index) FROM seg JOIN sig ON seg.t = sig.q_t)),
walk(method, horizon_minutes, i, last_exit, taken) AS (SELECT method, horizon_minutes, i, exit_t, true FROM poss WHERE i = 1 UNION ALL
SELECT p.method, p.horizon_minutes, p.i, CASE WHEN p.q_t >= w.last_exit THEN p.exit_t ELSE w.last_exit END, p.q_t >= w.last_exit FROM walk w JOIN poss p ON p.method = w.method AND p.horizon_minutes = w.horizon_minutes AND p.i = w.i + 1),
done AS MATERIALIZED (SELECT p.* FROM poss p JOIN walk w USING (method, horizon_minutes, i) WHERE w.taken)"""


def _with_trades(final: str) -> str:
    chain = sql("SELECT * FROM pred")
    return chain[: chain.rindex(") SELECT * FROM pred") + 1].replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _TRADE_STEPS + " " + final


ORACLE_SQL["trades"] = _with_trades("SELECT method, horizon_minutes, q_t, entry_t, exit_t, ((exit_t - q_t) / 900)::INT AS holding_bars, round(entry_price, 6) + 0.0 AS entry_price, round(exit_price, 6) + 0.0 AS exit_price, round(exit_price / entry_price - 1, 6) + 0.0 AS gross_return, round(exit_price / entry_price * ((1 - 0.0001) / (1 + 0.0001)) - 1, 6) + 0.0 AS net_return FROM done")
_EQUITY_STEPS = """, cum AS MATERIALIZED (SELECT *, exp(sum(ln(exit_price / entry_price * ((1 - 0.0001) / (1 + 0.0001)))) OVER w) AS na, exp(sum(ln(exit_price / entry_price)) OVER w) AS ga,
exp(sum(ln(exit_price / entry_price * ((1 - 0.0001) / (1 + 0.0001)))) OVER w) / (exit_price / entry_price * ((1 - 0.0001) / (1 + 0.0001))) AS nb, exp(sum(ln(exit_price / entry_price)) OVER w) / (exit_price / entry_price) AS gb
FROM done WINDOW w AS (PARTITION BY method, horizon_minutes ORDER BY q_t)),
span AS MATERIALIZED (SELECT b.t, b.session, b.close, k.method, k.horizon_minutes FROM seg b CROSS JOIN (SELECT DISTINCT method, horizon_minutes FROM sig) k
WHERE b.session BETWEEN (SELECT min(session) FROM seg JOIN sig ON seg.t = sig.q_t) AND (SELECT max(session) FROM seg JOIN sig ON seg.t = sig.q_t)),
eq AS MATERIALIZED (SELECT s.method, s.horizon_minutes, s.session, s.t, CASE WHEN c.q_t IS NULL THEN 1.0::DOUBLE WHEN s.t = c.q_t THEN nb / 1.0001 WHEN s.t < c.exit_t THEN nb / (entry_price * 1.0001) * s.close ELSE na END AS net_equity,
CASE WHEN c.q_t IS NULL THEN 1.0::DOUBLE WHEN s.t = c.q_t THEN gb WHEN s.t < c.exit_t THEN gb / entry_price * s.close ELSE ga END AS gross_equity
FROM span s ASOF LEFT JOIN cum c ON s.method = c.method AND s.horizon_minutes = c.horizon_minutes AND s.t >= c.q_t)"""


def _with_equity(final: str) -> str:
    mark = "\x00"
    return _with_trades(mark + final).replace(" " + mark, _EQUITY_STEPS + " ")


_CLUSTERS = """SELECT embargo_sessions, horizon_minutes, fold, q_session, model, loss_name AS loss, count(*) AS n, sum(v) AS total FROM (UNPIVOT (SELECT o.embargo_sessions, o.horizon_minutes, o.fold, o.q_session, o.method AS model, o.absolute_error - r.absolute_error AS absolute_error,
    o.squared_error - r.squared_error AS squared_error, o.brier - r.brier AS brier FROM sub o JOIN sub r USING (embargo_sessions, horizon_minutes, fold, q_t) WHERE r.method = 'raw_knn' AND o.method <> 'raw_knn') ON absolute_error, squared_error, brier INTO NAME loss_name VALUE v) GROUP BY ALL"""
ORACLE_SQL |= {
    "equity_curve": _with_equity("SELECT method, horizon_minutes, session, t, round(ln(gross_equity), 5) AS ln_gross_equity, round(ln(net_equity), 5) AS ln_net_equity FROM eq"),
    "trading_metrics": _with_equity("""SELECT m.method, m.horizon_minutes, coalesce(n, 0) AS n_trades, n_sessions, n_bars, round(hit, 6) + 0.0 AS hit_rate, round(avg_return, 6) + 0.0 AS average_holding_return, round(coalesce(held, 0) / n_bars, 6) + 0.0 AS time_in_market,
        round(drawdown, 6) + 0.0 AS max_drawdown, round(ln(net), 5) AS ln_net, round(sharpe, 5) AS sharpe, round(ln(1 + coalesce(turnover, 0)), 5) AS ln_turnover FROM (SELECT method, horizon_minutes, count(DISTINCT session) AS n_sessions, count(*) AS n_bars, max(1 - net_equity / peak) AS drawdown, arg_max(net_equity, t) AS net
        FROM (SELECT *, max(greatest(net_equity, 1.0)) OVER (PARTITION BY method, horizon_minutes ORDER BY t) AS peak FROM eq) GROUP BY ALL) m LEFT JOIN (SELECT method, horizon_minutes, count(*) AS n,
        avg((exit_price / entry_price * ((1 - 0.0001) / (1 + 0.0001)) - 1 > 0)::INT::DOUBLE) AS hit, avg(exit_price / entry_price * ((1 - 0.0001) / (1 + 0.0001)) - 1) AS avg_return, sum((exit_t - q_t) / 900)::BIGINT AS held FROM done GROUP BY ALL) d USING (method, horizon_minutes)
        LEFT JOIN (SELECT method, horizon_minutes, sum(nb / (entry_price * 1.0001) * (entry_price + exit_price)) AS turnover FROM cum GROUP BY ALL) u USING (method, horizon_minutes)
        LEFT JOIN (SELECT method, horizon_minutes, CASE WHEN stddev_samp(r) > 0 THEN sqrt(252) * avg(r) / stddev_samp(r) END AS sharpe FROM (SELECT *, last_value / coalesce(lag(last_value) OVER (PARTITION BY method, horizon_minutes ORDER BY session), 1.0) - 1 AS r
        FROM (SELECT method, horizon_minutes, session, arg_max(net_equity, t) AS last_value FROM eq GROUP BY ALL)) GROUP BY ALL) v USING (method, horizon_minutes)"""),
    "bootstrap_means": sql("""SELECT embargo_sessions, horizon_minutes, fold, model, loss_name AS loss, count(*) AS n_forecasts, count(DISTINCT q_session) AS n_sessions, CASE WHEN count(DISTINCT q_session) >= 2 THEN 'ok' ELSE 'insufficient_sessions' END AS status, round(avg(v), 7) + 0.0 AS mean_difference
        FROM (UNPIVOT (SELECT o.embargo_sessions, o.horizon_minutes, o.fold, o.q_session, o.method AS model, o.absolute_error - r.absolute_error AS absolute_error, o.squared_error - r.squared_error AS squared_error, o.brier - r.brier AS brier
        FROM sub o JOIN sub r USING (embargo_sessions, horizon_minutes, fold, q_t) WHERE r.method = 'raw_knn' AND o.method <> 'raw_knn') ON absolute_error, squared_error, brier INTO NAME loss_name VALUE v) GROUP BY ALL"""),
    "multiplicities": sql(f"SELECT * FROM ({oracle.multiplicities('(' + _CLUSTERS + ')', 10, CONFIG.random_state)})"),
    "bootstrap_ci": sql(oracle.intervals("(" + _CLUSTERS + ")", RESAMPLES, CONFIG.random_state)),
    "conclusion": sql(f"""SELECT CASE WHEN n < 12 THEN 'inconclusive' WHEN top_better AND folds_better THEN 'improved' WHEN top_worse AND folds_worse THEN 'not_improved' ELSE 'inconclusive' END AS outcome FROM (SELECT count(*) AS n,
        bool_and(ci_upper < 0) FILTER (fold = 0) AS top_better, bool_and(mean_difference < 0) FILTER (fold > 0) AS folds_better, bool_and(ci_lower > 0) FILTER (fold = 0) AS top_worse, bool_and(mean_difference > 0) FILTER (fold > 0) AS folds_worse
        FROM ({oracle.intervals("(" + _CLUSTERS + ")", RESAMPLES, CONFIG.random_state)}) WHERE model = 'momentum' AND loss = 'absolute_error' AND embargo_sessions = 1)"""),
    "query_coverage": sql("SELECT q_session, count(DISTINCT q_t) AS queries, min(q_t) AS first_t, max(q_t) AS last_t FROM pred GROUP BY q_session"),
}
ORACLE_SQL = {name: _tied(text) for name, text in ORACLE_SQL.items()}

"""Oracle SQL (DuckDB) for the registered queries: one chain of named steps, of which each query takes what it needs."""

from __future__ import annotations

import re

# name -> SQL body; the numbers equal those of registry.CONFIG
STEPS = {
    "ticks": "SELECT epoch_us(ts) // 900000000 AS slot, ts, value FROM events",
    "bars": """SELECT (slot + 1) * 900 AS t, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
        count(*)::DOUBLE AS volume, avg(value) AS vwap, ((slot * 900) // 86400 - 19723)::INT AS session_index,
        (((slot * 900) % 86400) // 60)::INT AS minute_of_session, DATE '2024-01-01' + ((slot * 900) // 86400 - 19723)::INT AS session FROM ticks GROUP BY slot""",
    "grid": """SELECT (19723 + s) * 86400 + (k + 1) * 900 AS t, s::INT AS session_index, (k * 15)::INT AS minute_of_session, DATE '2024-01-01' + s::INT AS session
        FROM range(0, 30) a(s), range(0, 96) b(k)""",
    "seg": """SELECT * EXCLUDE (flag), (sum(flag) OVER (ORDER BY t) - 1)::BIGINT AS segment_id FROM (SELECT *, CASE WHEN session_index = lag(session_index) OVER (ORDER BY t)
        AND t - lag(t) OVER (ORDER BY t) = 900 THEN 0 ELSE 1 END AS flag FROM bars)""",
    "logr": "SELECT *, ln(close / lag(close) OVER (PARTITION BY session_index, segment_id ORDER BY t)) AS log_return FROM seg",
    "feat": """SELECT *, (close - session_vwap) / close AS vwap_distance FROM (SELECT *,
        CASE WHEN count(log_return) OVER w = 4 THEN stddev_samp(log_return) OVER w END AS realized_volatility, (high - low) / close AS range_fraction,
        sum(vwap * volume) OVER d / nullif(sum(volume) OVER d, 0) AS session_vwap
        FROM logr WINDOW w AS (PARTITION BY session_index, segment_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW),
        d AS (PARTITION BY session_index ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "lab": """SELECT *, lead(close, 1) OVER w / close - 1 AS r15, lead(close, 2) OVER w / close - 1 AS r30, lead(close, 4) OVER w / close - 1 AS r60,
        lead(t, 1) OVER w AS e15, lead(t, 2) OVER w AS e30, lead(t, 4) OVER w AS e60, close / lag(close, 4) OVER w - 1 AS recent_return
        FROM feat WINDOW w AS (PARTITION BY segment_id ORDER BY t)""",
    "keyed": "SELECT *, strftime(session, '%G-W%V') AS own_refit FROM lab",
    "blocks": """SELECT *, n_train_sessions >= 10 AS accepted FROM (SELECT own_refit AS refit_id, min(t) AS first_t, max(t) AS last_t, count(*) AS n_bars,
        row_number() OVER (ORDER BY min(t)) AS block, coalesce(sum(count(DISTINCT session)) OVER (ORDER BY min(t) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_train_sessions
        FROM keyed GROUP BY own_refit)""",
    "panel0": """SELECT k.*, b.refit_id, k.t < b.first_t AS is_train FROM keyed k JOIN blocks b ON k.t <= b.last_t WHERE b.accepted""",
    "slotmed": "SELECT refit_id, minute_of_session, median(volume) AS m, mad(volume) AS d FROM panel0 WHERE is_train GROUP BY ALL",
    "slots": "SELECT *, CASE WHEN 1.4826 * d > 0 THEN 1.4826 * d ELSE greatest(abs(m), 1.0) END AS s FROM slotmed",
    "panel1": "SELECT p.*, (p.volume - s.m) / s.s AS volume_surprise FROM panel0 p LEFT JOIN slots s USING (refit_id, minute_of_session)",
    "stat": """SELECT refit_id, feature, avg(v) AS mean, stddev_pop(v) AS sd, count(v) AS n, CASE WHEN stddev_pop(v) > 2.220446049250313e-16 * greatest(abs(avg(v)), 1.0) THEN stddev_pop(v) ELSE 1.0 END AS scale
        FROM (UNPIVOT (SELECT refit_id, log_return, realized_volatility, range_fraction, volume_surprise, vwap_distance FROM panel1 WHERE is_train)
        ON log_return, realized_volatility, range_fraction, volume_surprise, vwap_distance INTO NAME feature VALUE v) GROUP BY ALL""",
    "wide": "SELECT refit_id, "
    + ", ".join(f"max(mean) FILTER (feature = '{f}') AS m{k}, max(scale) FILTER (feature = '{f}') AS s{k}" for k, f in enumerate(["log_return", "realized_volatility", "range_fraction", "volume_surprise", "vwap_distance"]))
    + " FROM stat GROUP BY refit_id",
    "panel": "SELECT p.*, "
    + ", ".join(f"({f} - m{k}) / s{k} AS z{k}" for k, f in enumerate(["log_return", "realized_volatility", "range_fraction", "volume_surprise", "vwap_distance"]))
    + " FROM panel1 p JOIN wide USING (refit_id)",
    "ctx0": """SELECT *, CASE WHEN z0 IS NOT NULL AND z1 IS NOT NULL AND z2 IS NOT NULL AND z3 IS NOT NULL AND z4 IS NOT NULL THEN 1 ELSE 0 END AS whole FROM panel""",
    "ctx": """SELECT * FROM (SELECT *, sum(whole) OVER w AS n_whole, flatten(list([z0, z1, z2, z3, z4]) OVER w) AS vec, min(t) OVER w AS context_start
        FROM ctx0 WINDOW w AS (PARTITION BY refit_id, segment_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE n_whole = 4""",
    "q": """SELECT refit_id, t AS q_t, session_index AS q_session, session AS q_date, minute_of_session AS q_minute, vec AS q_vec, recent_return, r15 AS a15, r30 AS a30, r60 AS a60, e15 AS qe15, e30 AS qe30, e60 AS qe60
        FROM ctx WHERE NOT is_train AND r15 IS NOT NULL AND r30 IS NOT NULL AND r60 IS NOT NULL AND recent_return IS NOT NULL""",
    "c": "SELECT refit_id, t AS c_t, session_index AS c_session, minute_of_session AS c_minute, vec AS c_vec, r15, r30, r60, e60 FROM ctx WHERE e60 IS NOT NULL",
    "emb": "SELECT unnest([0, 1, 5]) AS embargo_sessions",
    "same": """SELECT q.refit_id, q_t, embargo_sessions, c_t, r15, r30, r60 FROM q JOIN c ON q.refit_id = c.refit_id AND q_minute = c_minute AND e60 <= q_t AND c_t < q_t
        CROSS JOIN emb WHERE embargo_sessions = 0 OR q_session - c_session > embargo_sessions""",
    "common": "SELECT refit_id, q_t FROM same GROUP BY ALL HAVING count(DISTINCT embargo_sessions) = 3",
    "cq": "SELECT q.* FROM q SEMI JOIN common USING (refit_id, q_t)",
    "pairs": "SELECT q.refit_id, q_t, c_t, c_session, q_session - c_session AS gap, q_vec, c_vec, r15, r30, r60 FROM cq q JOIN c ON q.refit_id = c.refit_id AND e60 <= q_t AND c_t < q_t",
    "pairs_e": "SELECT * FROM pairs CROSS JOIN emb WHERE embargo_sessions = 0 OR gap > embargo_sessions",
    "near": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY refit_id, q_t, embargo_sessions ORDER BY distance, c_t) AS rank FROM (SELECT * FROM (SELECT *,
        row_number() OVER (PARTITION BY refit_id, q_t, embargo_sessions, c_session ORDER BY distance, c_t) AS k FROM (SELECT refit_id, q_t, embargo_sessions, c_t, c_session, r15, r30, r60,
        list_distance(q_vec, c_vec) AS distance FROM pairs_e)) WHERE k <= 3)) WHERE rank <= 10""",
    "horizons": "SELECT unnest([15, 30, 60]) AS horizon_minutes",
    "acts": "SELECT q.refit_id, q_t, q_session, q_date, horizon_minutes, recent_return, CASE horizon_minutes WHEN 15 THEN a15 WHEN 30 THEN a30 ELSE a60 END AS actual_return, CASE horizon_minutes WHEN 15 THEN qe15 WHEN 30 THEN qe30 ELSE qe60 END AS outcome_end FROM cq q CROSS JOIN horizons",
    "same_long": "SELECT s.refit_id, s.q_t, embargo_sessions, horizon_minutes, CASE horizon_minutes WHEN 15 THEN r15 WHEN 30 THEN r30 ELSE r60 END AS r, NULL::DOUBLE AS distance FROM same s SEMI JOIN common USING (refit_id, q_t) CROSS JOIN horizons",
    "all_long": "SELECT refit_id, q_t, embargo_sessions, horizon_minutes, CASE horizon_minutes WHEN 15 THEN r15 WHEN 30 THEN r30 ELSE r60 END AS r, NULL::DOUBLE AS distance FROM pairs_e CROSS JOIN horizons",
    "near_long": "SELECT refit_id, q_t, embargo_sessions, horizon_minutes, CASE horizon_minutes WHEN 15 THEN r15 WHEN 30 THEN r30 ELSE r60 END AS r, distance FROM near CROSS JOIN horizons",
    "f_mom": """SELECT refit_id, q_t, embargo_sessions, horizon_minutes, 'momentum' AS method, m AS mean, m AS median, CASE WHEN m > 0 THEN 1.0::DOUBLE WHEN m < 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS probability_up,
        NULL::DOUBLE AS q10, NULL::DOUBLE AS q25, NULL::DOUBLE AS q75, NULL::DOUBLE AS q90, NULL::DOUBLE AS return_std, 0::BIGINT AS effective_neighbor_count, NULL::DOUBLE AS distance_mean, NULL::DOUBLE AS distance_min,
        NULL::DOUBLE AS distance_max, actual_return, NULL::DOUBLE AS realized_percentile FROM (SELECT *, exp(ln(1 + recent_return) * (horizon_minutes / 15) / 4) - 1 AS m FROM acts) CROSS JOIN emb""",
    "folds": """SELECT session, ntile(3) OVER (ORDER BY session)::INT AS fold FROM (SELECT DISTINCT k.session FROM keyed k JOIN blocks b ON k.own_refit = b.refit_id WHERE b.accepted)""",
    "pred": "SELECT p.*, a.q_session, a.outcome_end, f.fold FROM (SELECT * FROM f_same UNION ALL SELECT * FROM f_near UNION ALL SELECT * FROM f_mom) p JOIN (SELECT refit_id, q_t, horizon_minutes, q_session, q_date, outcome_end FROM acts) a USING (refit_id, q_t, horizon_minutes) JOIN folds f ON f.session = a.q_date",
    "loss": "SELECT *, abs(median - actual_return) AS absolute_error, (median - actual_return) * (median - actual_return) AS squared_error, (probability_up - (actual_return > 0)::INT::DOUBLE) * (probability_up - (actual_return > 0)::INT::DOUBLE) AS brier FROM pred",
    "sub": "SELECT * EXCLUDE (fold), unnest([0, fold]) AS fold FROM loss",
}


def _forecast(source: str, method: str) -> str:
    return f"""SELECT refit_id, q_t, embargo_sessions, horizon_minutes, '{method}' AS method, avg(r) AS mean, quantile_cont(r, 0.5) AS median, avg((r > 0)::INT::DOUBLE) AS probability_up,
        quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.25) AS q25, quantile_cont(r, 0.75) AS q75, quantile_cont(r, 0.9) AS q90, stddev_pop(r) AS return_std, count(r) AS effective_neighbor_count,
        avg(distance) AS distance_mean, min(distance) AS distance_min, max(distance) AS distance_max, any_value(actual_return) AS actual_return, avg((r <= actual_return)::INT::DOUBLE) AS realized_percentile
        FROM {source} JOIN (SELECT refit_id, q_t, horizon_minutes, actual_return FROM acts) USING (refit_id, q_t, horizon_minutes) GROUP BY ALL"""


STEPS |= {"f_same": _forecast("same_long", "same_time_of_day"), "f_all": _forecast("all_long", "unconditional"), "f_near": _forecast("near_long", "raw_knn")}


_P = lambda n, more="true": f"(q_t // 900) % 97 = {n} AND {more}"
_N = lambda n, more="true": f"(q_t // 900) % 89 = {n} AND {more}"
# forecasts and neighbours with the faults that registry.planted_predictions and planted_neighbors put into them
STEPS |= {
    "fitend": "SELECT refit_id, max(t) AS fit_end FROM panel0 WHERE is_train GROUP BY refit_id",
    "pzero": "SELECT p.*, refit_id AS query_model_id, q_t AS latest_feature_t, fit_end, first_t AS refit_block_start FROM pred p JOIN fitend USING (refit_id) JOIN (SELECT refit_id, first_t FROM blocks) USING (refit_id)",
    "pone": f"""SELECT * REPLACE (CASE WHEN {_P(2, "method = 'raw_knn' AND horizon_minutes = 30")} THEN actual_return + 1 WHEN {_P(3, "method = 'momentum'")} THEN 'infinity'::DOUBLE ELSE actual_return END AS actual_return,
        CASE WHEN {_P(4, "method = 'raw_knn'")} THEN 1.5 ELSE probability_up END AS probability_up, CASE WHEN {_P(5, "method = 'raw_knn' AND embargo_sessions = 0")} THEN fold - 10 ELSE fold END AS fold,
        CASE WHEN {_P(6, "method = 'raw_knn' AND embargo_sessions = 1")} THEN q_session + 1000 ELSE q_session END AS q_session, CASE WHEN {_P(7)} THEN 'other' ELSE query_model_id END AS query_model_id,
        CASE WHEN {_P(8)} THEN q_t + 1 ELSE latest_feature_t END AS latest_feature_t, CASE WHEN {_P(9)} THEN refit_block_start ELSE fit_end END AS fit_end,
        CASE WHEN {_P(10, "method = 'raw_knn'")} THEN effective_neighbor_count + 1 ELSE effective_neighbor_count END AS effective_neighbor_count)
        FROM pzero WHERE NOT ({_P(1, "method = 'momentum' AND horizon_minutes = 15 AND embargo_sessions = 0")})""",
    "pplant": f"SELECT * FROM pone UNION ALL SELECT * FROM pone WHERE {_P(11, "method = 'raw_knn' AND embargo_sessions = 0")}",
    "nzero": """SELECT n.*, l.session_index AS c_session, l.e15, l.e30, l.e60, k.session_index AS query_session_index, fit_end, refit_id AS query_model_id, refit_id AS neighbor_model_id FROM (
        SELECT refit_id, q_t, embargo_sessions, 'raw_knn' AS method, c_t, rank, distance, r15, r30, r60 FROM near UNION ALL
        SELECT refit_id, q_t, embargo_sessions, 'same_time_of_day', c_t, row_number() OVER (PARTITION BY refit_id, q_t, embargo_sessions ORDER BY c_t), NULL, r15, r30, r60 FROM same SEMI JOIN common USING (refit_id, q_t)) n
        JOIN lab l ON l.t = c_t JOIN lab k ON k.t = q_t JOIN fitend USING (refit_id)""",
    "none1": f"""SELECT * REPLACE (CASE WHEN {_N(1, "rank = 1")} THEN r30 + 1 ELSE r30 END AS r30, CASE WHEN {_N(2, "rank = 2")} THEN q_t + 60 ELSE e60 END AS e60,
        CASE WHEN {_N(3, "rank = 1 AND embargo_sessions = 5")} THEN query_session_index - 5 ELSE c_session END AS c_session, CASE WHEN {_N(4, "rank = 3")} THEN q_t ELSE fit_end END AS fit_end,
        CASE WHEN {_N(5, "rank = 1")} THEN 'other' ELSE neighbor_model_id END AS neighbor_model_id, CASE WHEN {_N(6, "rank = 1")} THEN q_t ELSE c_t END AS c_t) FROM nzero""",
    "nplant": f"SELECT * FROM none1 UNION ALL SELECT * FROM none1 WHERE {_N(7, "rank <= 4 AND method = 'raw_knn'")}",
    "nsum": """SELECT refit_id, q_t, embargo_sessions, method, horizon_minutes, count(v) AS s_n, avg(v) AS s_mean, quantile_cont(v, 0.5) AS s_median, quantile_cont(v, 0.1) AS s_q10, min(distance) AS s_near, max(distance) AS s_far
        FROM (SELECT *, CASE horizon_minutes WHEN 15 THEN r15 WHEN 30 THEN r30 ELSE r60 END AS v FROM nplant CROSS JOIN horizons) GROUP BY ALL""",
}


def _counts(checks: dict[str, str], name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS {name}, count(*)::BIGINT AS n FROM ({rows})" for k, rows in checks.items())


def _split(column: str, by: str) -> str:
    return f"SELECT 1 FROM pplant GROUP BY {by} HAVING count(DISTINCT coalesce({column}::VARCHAR, 'null')) > 1"


def cohorts_planted() -> str:
    """Counts of cohort violations over the planted forecasts."""
    return _counts({
        "duplicates": "SELECT 1 FROM pplant GROUP BY embargo_sessions, q_t, horizon_minutes, method HAVING count(*) > 1",
        "unequal_methods": """SELECT 1 FROM (SELECT embargo_sessions, horizon_minutes, q_t, count(DISTINCT method) AS n FROM pplant GROUP BY ALL) JOIN (SELECT embargo_sessions, horizon_minutes, count(DISTINCT method) AS every FROM pplant GROUP BY ALL)
            USING (embargo_sessions, horizon_minutes) WHERE n <> every""",
        "outcomes_disagree": _split("actual_return", "embargo_sessions, q_t, horizon_minutes"), "sessions_disagree": _split("q_session", "embargo_sessions, q_t"), "folds_disagree": _split("fold", "embargo_sessions, q_t"),
        "session_in_two_folds": _split("fold", "embargo_sessions, q_session"), "missing_identity": "SELECT 1 FROM pplant WHERE q_t IS NULL OR actual_return IS NULL",
        "bad_integers": "SELECT 1 FROM pplant WHERE embargo_sessions < 0 OR fold < 1 OR horizon_minutes < 1", "outcome_not_finite": "SELECT 1 FROM pplant WHERE NOT isfinite(actual_return)",
        "probability_out_of_range": "SELECT 1 FROM pplant WHERE probability_up < 0 OR probability_up > 1",
        "embargoes_unpaired": "SELECT 1 FROM pplant GROUP BY q_t, horizon_minutes, method HAVING count(DISTINCT embargo_sessions) <> (SELECT count(DISTINCT embargo_sessions) FROM pplant)",
    }, "violation")


def audit_planted(k: int, cap: int) -> str:
    """Counts of audit violations over the planted forecasts and neighbours."""
    key = "refit_id, q_t, embargo_sessions, method"
    near = lambda a, b: f"NOT coalesce({a} IS NOT DISTINCT FROM {b} OR abs({a} - {b}) <= 1e-12 * greatest(1, abs({b})), false)"
    differs = " OR ".join(f"n.{x} IS DISTINCT FROM l.{x}" for x in ("r15", "r30", "r60", "e15", "e30", "e60"))
    return _counts({
        "fit_not_before_block": "SELECT 1 FROM pplant WHERE fit_end >= refit_block_start", "fit_not_before_query": "SELECT 1 FROM nplant WHERE fit_end >= q_t", "feature_after_query": "SELECT 1 FROM pplant WHERE latest_feature_t > q_t",
        "wrong_model": "SELECT 1 FROM pplant WHERE query_model_id <> refit_id UNION ALL SELECT 1 FROM nplant WHERE query_model_id <> neighbor_model_id", "neighbor_not_before_query": "SELECT 1 FROM nplant WHERE c_t >= q_t",
        "neighbor_outcome_unknown": "SELECT 1 FROM nplant WHERE e60 > q_t", "embargo_broken": "SELECT 1 FROM nplant WHERE embargo_sessions > 0 AND c_session >= query_session_index - embargo_sessions",
        "outcome_differs": "SELECT 1 FROM pplant p LEFT JOIN lab l ON l.t = p.q_t WHERE CASE horizon_minutes WHEN 15 THEN r15 WHEN 30 THEN r30 ELSE r60 END IS DISTINCT FROM actual_return",
        "neighbor_outcome_differs": f"SELECT 1 FROM nplant n LEFT JOIN lab l ON l.t = n.c_t WHERE {differs}", "neighbor_twice": f"SELECT 1 FROM nplant GROUP BY {key}, c_t HAVING count(*) > 1",
        "too_many_neighbors": f"SELECT 1 FROM nplant WHERE method = 'raw_knn' GROUP BY {key} HAVING count(*) > {k}", "session_cap_broken": f"SELECT 1 FROM nplant WHERE method = 'raw_knn' GROUP BY {key}, c_session HAVING count(*) > {cap}",
        "summary_differs": f"""SELECT 1 FROM pplant LEFT JOIN nsum USING ({key}, horizon_minutes) WHERE method <> 'momentum' AND (s_n IS NULL OR s_n <> effective_neighbor_count
            OR {near("s_mean", "mean")} OR {near("s_median", "median")} OR {near("s_q10", "q10")} OR {near("s_near", "distance_min")} OR {near("s_far", "distance_max")})""",
    }, "violation")


def prefix_planted(end: int) -> str:
    """Rows lost and gained against a run on bars up to ``end``, with rows of the longer run changed and removed."""
    columns = "refit_id, q_t, embargo_sessions, method, horizon_minutes, effective_neighbor_count, outcome_end, median, probability_up, q10, q90, actual_return, distance_mean"
    early = f"SELECT {columns} FROM pred SEMI JOIN (SELECT refit_id, q_t FROM cq WHERE qe60 <= {end}) USING (refit_id, q_t)"
    later = f"""SELECT {columns.replace("median", "CASE WHEN (q_t // 900) % 53 = 2 AND horizon_minutes = 15 THEN median + 1 ELSE median END AS median")} FROM pred
        WHERE NOT ((q_t // 900) % 53 = 1 AND method = 'raw_knn') AND q_t <= (SELECT max(q_t) FROM cq WHERE qe60 <= {end})"""
    return _counts({"missing": f"({early}) EXCEPT ALL ({later})", "added": f"({later}) EXCEPT ALL ({early})"}, "difference")


_CELL = "embargo_sessions, horizon_minutes, fold"


def multiplicities(clusters: str, resamples: int, seed: int) -> str:
    """The draws of operators.bootstrap in SQL: one nested step for each number that the generator takes in."""
    prime = (1 << 31) - 1

    def step(rows: str, number: str, more: str = "") -> str:
        taken = f"SELECT * EXCLUDE (x), ((x + {number}) % {prime} * 48271 + 11) % {prime} AS x0 FROM (SELECT *{more} FROM ({rows}))"
        return f"SELECT * EXCLUDE (x0, y), y * y % {prime} * x0 % {prime} AS x FROM (SELECT *, x0 * x0 % {prime} AS y FROM ({taken}))"

    rows = f"SELECT {_CELL}, count(DISTINCT q_session) AS size, 0::BIGINT AS x FROM {clusters} GROUP BY ALL HAVING count(DISTINCT q_session) > 1"
    for number in (str(seed), "embargo_sessions", "horizon_minutes", "fold"):
        rows = step(rows, number)
    rows = step(rows, "draw", f", unnest(range(0, {resamples})) AS draw")
    rows = step(rows, "place", ", unnest(range(0, size)) AS place")
    numbered = f"SELECT {_CELL}, q_session, row_number() OVER (PARTITION BY {_CELL} ORDER BY q_session) - 1 AS i FROM (SELECT DISTINCT {_CELL}, q_session FROM {clusters})"
    return f"SELECT {_CELL}, draw, q_session, count(*) AS m FROM (SELECT {_CELL}, draw, x % size AS i FROM ({rows})) JOIN ({numbered}) USING ({_CELL}, i) GROUP BY ALL"


def intervals(clusters: str, resamples: int, seed: int) -> str:
    """Mean differences and 95 per cent percentile intervals."""
    return f"""SELECT {_CELL}, model, loss, n_forecasts, n_sessions, CASE WHEN n_sessions >= 2 THEN 'ok' ELSE 'insufficient_sessions' END AS status, round(mean_difference, 7) + 0.0 AS mean_difference, round(lo, 7) + 0.0 AS ci_lower, round(hi, 7) + 0.0 AS ci_upper
        FROM (SELECT {_CELL}, model, loss, sum(n)::BIGINT AS n_forecasts, count(*) AS n_sessions, sum(total) / sum(n) AS mean_difference FROM {clusters} GROUP BY ALL)
        LEFT JOIN (SELECT {_CELL}, model, loss, quantile_cont(ratio, 0.025) AS lo, quantile_cont(ratio, 0.975) AS hi FROM (SELECT {_CELL}, model, loss, draw, sum(m * total) / sum(m * n) AS ratio
        FROM {clusters} JOIN ({multiplicities(clusters, resamples, seed)}) USING ({_CELL}, q_session) GROUP BY ALL) GROUP BY ALL) USING ({_CELL}, model, loss)"""


def metrics(source: str, keys: str) -> str:
    """SQL of the metric table with tie-averaged rank correlation."""
    return f"""SELECT {keys}, n_forecasts, n_sessions, query_start, query_end, round(mae, 8) + 0.0 AS mae, round(rmse, 8) + 0.0 AS rmse, round(mse, 8) + 0.0 AS mean_signed_error, round(brier, 8) + 0.0 AS brier,
        round(log_loss, 6) + 0.0 AS log_loss, n_intervals, round(w, 8) + 0.0 AS interval_10_90_width, round(cov, 8) + 0.0 AS interval_10_90_coverage, round(nc, 6) + 0.0 AS effective_neighbor_count_mean,
        round(CASE WHEN sa > 0 AND sp > 0 THEN c / (sa * sp) END, 6) + 0.0 AS spearman FROM (SELECT {keys}, count(*) AS n_forecasts, count(DISTINCT q_session) AS n_sessions, min(q_t) AS query_start, max(q_t) AS query_end,
        avg(absolute_error) AS mae, sqrt(avg(squared_error)) AS rmse, avg(median - actual_return) AS mse, avg(brier) AS brier,
        avg(-CASE WHEN actual_return > 0 THEN ln(greatest(1e-12, least(1 - 1e-12, probability_up))) ELSE ln(1 - greatest(1e-12, least(1 - 1e-12, probability_up))) END) AS log_loss,
        count(q10) AS n_intervals, avg(q90 - q10) AS w, avg((actual_return >= q10 AND actual_return <= q90)::INT::DOUBLE) FILTER (q10 IS NOT NULL) AS cov, avg(effective_neighbor_count) AS nc,
        covar_pop(ra, rp) AS c, stddev_pop(ra) AS sa, stddev_pop(rp) AS sp FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY actual_return) + (count(*) OVER (PARTITION BY {keys}, actual_return) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY {keys} ORDER BY median) + (count(*) OVER (PARTITION BY {keys}, median) - 1) / 2.0 AS rp FROM {source}) GROUP BY {keys})"""


def sql(final: str) -> str:
    """WITH chain of the steps that ``final`` needs, in order."""
    need, todo = set(), [final]
    while todo:
        words = set(re.findall(r"\b[a-z_0-9]+\b", todo.pop()))
        for name in words & set(STEPS) - need:
            need.add(name)
            todo.append(STEPS[name])
    chain = ", ".join(f"{name} AS MATERIALIZED ({STEPS[name]})" for name in _ordered(need))
    return f"WITH {chain} {final}" if chain else final


def _ordered(need: set[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for other in sorted(set(re.findall(r"\b[a-z_0-9]+\b", STEPS[name])) & need - {name}):
            visit(other)
        out.append(name)

    for name in sorted(need):
        visit(name)
    return out

"""Artifact audit: batteries of violation counts, all zero for a sound run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded

CHECKS = (
    "fit_not_before_block", "fit_not_before_query", "feature_after_query", "wrong_model", "neighbor_not_before_query", "neighbor_outcome_unknown",
    "embargo_broken", "outcome_differs", "neighbor_outcome_differs", "neighbor_twice", "too_many_neighbors", "session_cap_broken", "summary_differs",
)


#: Methods whose cohorts are capped nearest neighbours.
RETRIEVAL = ("raw_knn", "hmm_current", "hmm_trajectory")


def violations(bars: DataFrame, predictions: DataFrame, neighbors: DataFrame, horizons: list[int], k: int, cap: int) -> DataFrame:
    """(violation, n) over the forecasts and the neighbours of all methods of a walk-forward run.

    ``bars`` has t, return_{h}m and outcome_end_{h}m, recomputed from canonical bars.
    """
    longest = max(horizons)
    key = ["refit_id", "q_t", "embargo_sessions", "method"]
    bars = bars.select(F.col("t"), *(F.col(f"return_{h}m").alias(f"b_return_{h}m") for h in horizons), *(F.col(f"outcome_end_{h}m").alias(f"b_outcome_end_{h}m") for h in horizons))
    p = predictions.join(bars.withColumnRenamed("t", "q_t"), "q_t", "left")
    own = F.coalesce(*(F.when(F.col("horizon_minutes") == h, F.col(f"b_return_{h}m")) for h in horizons))
    n = neighbors.join(bars.withColumnRenamed("t", "c_t"), "c_t", "left")
    differs = " or ".join(f"not (return_{h}m <=> b_return_{h}m) or not (outcome_end_{h}m <=> b_outcome_end_{h}m)" for h in horizons)
    capped = neighbors.where(F.col("method").isin(*RETRIEVAL))
    cohorts = predictions.where("method <> 'momentum'")
    values = [x for h in horizons for x in (F.lit(h), F.col(f"return_{h}m"))]
    long = neighbors.select(*key, "distance", F.explode(F.create_map(*values)).alias("horizon_minutes", "v"))
    summary = long.groupBy(*key, "horizon_minutes").agg(
        F.count("v").alias("s_n"), F.avg("v").alias("s_mean"), F.percentile("v", F.lit(0.5)).alias("s_median"), F.percentile("v", F.lit(0.1)).alias("s_q10"), F.min("distance").alias("s_near"), F.max("distance").alias("s_far")
    )
    far = lambda a, b: f"not ({a} <=> {b} or abs({a} - {b}) <= 1e-12 * greatest(1, abs({b})))"
    broken = " or ".join(["s_n is null", "s_n <> effective_neighbor_count", *(f"coalesce({far(a, b)}, true)" for a, b in (("s_mean", "mean"), ("s_median", "median"), ("s_q10", "q10"), ("s_near", "distance_min"), ("s_far", "distance_max")))])
    rows = {
        "fit_not_before_block": predictions.where("fit_end >= refit_block_start"),
        "fit_not_before_query": neighbors.where("fit_end >= q_t"),
        "feature_after_query": predictions.where("latest_feature_t > q_t"),
        "wrong_model": predictions.where("query_model_id <> refit_id").select("q_t").unionByName(neighbors.where("query_model_id <> neighbor_model_id or query_model_id <> refit_id").select("q_t")),
        "neighbor_not_before_query": neighbors.where("c_t >= q_t"),
        "neighbor_outcome_unknown": neighbors.where(f"outcome_end_{longest}m > q_t"),
        "embargo_broken": neighbors.where("embargo_sessions > 0 and c_session >= query_session_index - embargo_sessions"),
        "outcome_differs": p.where(~own.eqNullSafe(F.col("actual_return"))),
        "neighbor_outcome_differs": n.where(differs),
        "neighbor_twice": neighbors.groupBy(*key, "c_t").count().where("count > 1"),
        "too_many_neighbors": capped.groupBy(*key).count().where(F.col("count") > k),
        "session_cap_broken": capped.groupBy(*key, "c_session").count().where(F.col("count") > cap),
        "summary_differs": cohorts.join(summary, [*key, "horizon_minutes"], "left").where(broken),
    }
    out = None
    for name in CHECKS:
        one = rows[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def prefix_differences(prefix: DataFrame, whole: DataFrame) -> DataFrame:
    """(difference, n): rows that a longer run lost or gained up to the end of a shorter one; folds may move."""
    columns = ["refit_id", "q_t", "embargo_sessions", "method", "horizon_minutes", "effective_neighbor_count", "outcome_end"]
    values = [rounded(F.col(c), 10).alias(c) for c in ("median", "probability_up", "q10", "q90", "actual_return", "distance_mean")]
    a = prefix.select(*columns, *values)
    last = prefix.agg(F.max("q_t").alias("_last"))
    b = whole.join(F.broadcast(last), F.col("q_t") <= F.col("_last")).select(*columns, *values)  # one row
    count = lambda name, x, y: x.exceptAll(y).agg(F.count("*").alias("n")).select(F.lit(name).alias("difference"), "n")
    return count("missing", a, b).unionByName(count("added", b, a))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Set equality of two tables, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()

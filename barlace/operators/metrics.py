"""Forecast metrics, calibration, subtotals, paired differences and cohort checks.

``predictions`` rows: embargo_sessions, refit_id, q_t, q_session, fold, method,
horizon_minutes, median, probability_up, q10, q90, return_std,
effective_neighbor_count, distance_mean/min/max, actual_return.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite, log_loss


def losses(predictions: DataFrame) -> DataFrame:
    """Adds absolute, squared and Brier loss of each row."""
    error = F.col("median") - F.col("actual_return")
    up = (F.col("actual_return") > 0).cast("double")
    return predictions.withColumns({"absolute_error": F.abs(error), "squared_error": error * error, "brier": (F.col("probability_up") - up) * (F.col("probability_up") - up)})


def _average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties averaged."""
    order, same = W.partitionBy(*keys).orderBy(value), W.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count("*").over(same) - 1) / 2.0


def spearman(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spearman): null for one row or a constant side."""
    ranked = predictions.select(*keys, _average_rank("actual_return", keys).alias("ra"), _average_rank("median", keys).alias("rp"))
    sums = ranked.groupBy(*keys).agg(F.covar_pop("ra", "rp").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rp").alias("sp"))
    return sums.select(*keys, F.when((F.col("sa") > 0) & (F.col("sp") > 0), F.try_divide(F.col("c"), F.col("sa") * F.col("sp"))).alias("spearman"))


def metric_columns() -> list[Column]:
    interval = finite(F.col("q10")) & finite(F.col("q90"))
    inside = (F.col("actual_return") >= F.col("q10")) & (F.col("actual_return") <= F.col("q90"))
    return [
        F.count("*").alias("n_forecasts"), F.count_distinct("q_session").alias("n_sessions"),
        F.min("q_t").alias("query_start"), F.max("q_t").alias("query_end"),
        F.avg("absolute_error").alias("mae"), F.sqrt(F.avg("squared_error")).alias("rmse"),
        F.avg(F.col("median") - F.col("actual_return")).alias("mean_signed_error"), F.avg("brier").alias("brier"),
        F.avg(log_loss(F.col("probability_up"), F.col("actual_return") > 0)).alias("log_loss"),
        F.count(F.when(interval, 1)).alias("n_intervals"),
        F.avg(F.when(interval, F.col("q90") - F.col("q10"))).alias("interval_10_90_width"),
        F.avg(F.when(interval, inside.cast("double"))).alias("interval_10_90_coverage"),
        F.avg("return_std").alias("neighbor_return_std_mean"), F.avg("effective_neighbor_count").alias("effective_neighbor_count_mean"),
        F.avg("distance_mean").alias("distance_mean"), F.avg("distance_min").alias("distance_min_mean"), F.avg("distance_max").alias("distance_max_mean"),
    ]


def metric_table(predictions: DataFrame, keys: list[str]) -> DataFrame:
    table = losses(predictions).groupBy(*keys).agg(*metric_columns())
    return table.join(spearman(predictions, keys), keys)


def calibration(predictions: DataFrame, keys: list[str] = ("method", "horizon_minutes")) -> DataFrame:
    """Ten bins of P(up) for each method and horizon, empty ones too; the last bin holds 1."""
    keys = list(keys)
    binned = predictions.withColumn("bin", F.least((F.col("probability_up") * 10).cast("int"), F.lit(9)))
    counts = binned.groupBy(*keys, "bin").agg(
        F.count("*").alias("n_forecasts"), F.count_distinct("q_session").alias("n_sessions"),
        F.avg("probability_up").alias("mean_probability_up"), F.avg((F.col("actual_return") > 0).cast("double")).alias("observed_up_frequency"),
    )
    dense = predictions.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return dense.join(counts, [*keys, "bin"], "left").withColumns({
        "bin_lower": F.col("bin") / 10, "bin_upper": (F.col("bin") + 1) / 10,
        "n_forecasts": F.coalesce("n_forecasts", F.lit(0)), "n_sessions": F.coalesce("n_sessions", F.lit(0)),
    })


def with_subtotals(predictions: DataFrame) -> DataFrame:
    """Each row in its fold and in fold 0, the aggregate."""
    return predictions.withColumn("fold", F.explode(F.array(F.lit(0), F.col("fold").cast("int"))))


def sensitivity(predictions: DataFrame) -> DataFrame:
    """Metrics by embargo, fold (0: all), method and horizon."""
    return metric_table(with_subtotals(predictions), ["embargo_sessions", "fold", "method", "horizon_minutes"])


def paired_differences(predictions: DataFrame, reference: str = "raw_knn") -> DataFrame:
    """Mean loss of the reference less that of each control, on equal queries."""
    rows = losses(predictions).select("embargo_sessions", "q_t", "q_session", "horizon_minutes", "method", "absolute_error", "squared_error")
    own = rows.where(F.col("method") == reference).drop("method").withColumnsRenamed({"absolute_error": "ra", "squared_error": "rs"})
    others = rows.where(F.col("method") != reference).drop("q_session")
    paired = own.join(others, ["embargo_sessions", "q_t", "horizon_minutes"])
    return paired.groupBy("embargo_sessions", "horizon_minutes", F.col("method").alias("control")).agg(
        F.count("*").alias("n_forecasts"), F.count_distinct("q_session").alias("n_sessions"),
        F.avg(F.col("ra") - F.col("absolute_error")).alias("mean_absolute_error_difference"),
        F.avg(F.col("rs") - F.col("squared_error")).alias("mean_squared_error_difference"),
    )


def cohort_violations(predictions: DataFrame) -> DataFrame:
    """(violation, n): what forbids a paired evaluation; all zero for a sound table."""
    keys = ["embargo_sessions", "q_t", "horizon_minutes", "method"]
    p = predictions
    distinct = lambda column, *by: p.groupBy(*by).agg(F.count_distinct(F.coalesce(F.col(column).cast("string"), F.lit("null"))).alias("n")).where("n > 1")
    methods = p.groupBy("embargo_sessions", "horizon_minutes", "q_t").agg(F.count_distinct("method").alias("n"))
    most = p.groupBy("embargo_sessions", "horizon_minutes").agg(F.count_distinct("method").alias("all_methods"))
    variants = p.agg(F.count_distinct("embargo_sessions").alias("variants"))
    across = p.groupBy("q_t", "horizon_minutes", "method").agg(F.count_distinct("embargo_sessions").alias("n"))
    checks = {
        "duplicates": p.groupBy(*keys).count().where("count > 1"),
        "unequal_methods": methods.join(most, ["embargo_sessions", "horizon_minutes"]).where("n <> all_methods"),
        "outcomes_disagree": distinct("actual_return", "embargo_sessions", "q_t", "horizon_minutes"),
        "sessions_disagree": distinct("q_session", "embargo_sessions", "q_t"),
        "folds_disagree": distinct("fold", "embargo_sessions", "q_t"),
        "session_in_two_folds": distinct("fold", "embargo_sessions", "q_session"),
        "missing_identity": p.where("embargo_sessions is null or q_t is null or q_session is null or horizon_minutes is null or method is null or fold is null or actual_return is null"),
        "bad_integers": p.where("embargo_sessions < 0 or fold < 1 or horizon_minutes < 1"),
        "outcome_not_finite": p.where(~finite(F.col("actual_return"))),
        "probability_out_of_range": p.where("probability_up < 0 or probability_up > 1"),
        "embargoes_unpaired": across.join(F.broadcast(variants)).where("n <> variants"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


class CohortError(ValueError):
    pass


def require_cohorts(predictions: DataFrame) -> None:
    """Raises unless the table is fit for paired evaluation; unpaired rows are never dropped silently."""
    faults = [f"{r['violation']}: {r['n']}" for r in cohort_violations(predictions).where("n > 0").collect()]  # eleven rows
    if predictions.isEmpty():
        faults.append("evaluation requires at least one forecast")
    if faults:
        raise CohortError("; ".join(sorted(faults)))

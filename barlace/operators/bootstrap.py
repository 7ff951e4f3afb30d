"""Paired whole-session bootstrap of loss differences.

Sessions are pre-aggregated to sums and counts.  Draws come from a counter-based
generator in integer arithmetic: the pick of a cell, resample and position is a
function of these numbers and the seed alone.  So executors draw side by side, a lost
task draws the same again, and plain SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import losses, with_subtotals

MODELS = ("hmm_current", "hmm_trajectory")
LOSSES = ("absolute_error", "squared_error", "brier")
CELL = ["embargo_sessions", "horizon_minutes", "fold"]


def cluster_sums(predictions: DataFrame, models: tuple[str, ...] = MODELS, reference: str = "raw_knn") -> DataFrame:
    """(embargo, horizon, fold, session, model, loss, total, n): sums of model less reference; fold 0 is all."""
    rows = losses(with_subtotals(predictions)).select(*CELL, "q_t", "q_session", "method", *LOSSES)
    pair = rows.where(F.col("method").isin(*models)).withColumnRenamed("method", "model").join(
        rows.where(F.col("method") == reference).select(*CELL, "q_t", *(F.col(x).alias(f"r_{x}") for x in LOSSES)), [*CELL, "q_t"]
    )
    return (
        pair.select(*CELL, "q_session", "model", F.explode(F.create_map(*(y for x in LOSSES for y in (F.lit(x), F.col(x) - F.col(f"r_{x}"))))).alias("loss", "d"))
        .groupBy(*CELL, "q_session", "model", "loss")
        .agg(F.sum("d").alias("total"), F.count("*").alias("n"))
    )


#: Modulus of the generator, a prime, and the numbers of its steps; the fifth power permutes the residues.
PRIME, FACTOR, TERM = (1 << 31) - 1, 48271, 11


def _mixed(frame: DataFrame, *numbers: Column) -> DataFrame:
    for number in numbers:  # a column each, so no state is written out twice
        frame = frame.withColumn("_take", number.cast("long")).withColumn("_x", F.expr(f"((_x + _take) % {PRIME} * {FACTOR} + {TERM}) % {PRIME}"))
        frame = frame.withColumn("_y", F.expr(f"_x * _x % {PRIME}")).withColumn("_x", F.expr(f"_y * _y % {PRIME} * _x % {PRIME}"))
    return frame.drop("_take", "_y")


def multiplicities(cells: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(embargo, horizon, fold, draw, session, m): whole sessions drawn with replacement, as many as a cell has.

    ``cells``: rows with cell and session.  Cells of fewer than two sessions draw nothing.
    """
    sessions = cells.select(*CELL, "q_session").distinct()
    numbered = sessions.withColumn("_i", F.row_number().over(W.partitionBy(*CELL).orderBy("q_session")) - 1)  # a calendar's sessions
    sizes = sessions.groupBy(*CELL).agg(F.count("*").alias("_n")).where("_n > 1")
    state = _mixed(sizes.withColumn("_x", F.lit(0).cast("long")), F.lit(seed), *(F.col(c) for c in CELL))
    state = _mixed(state.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))), F.col("draw"))
    picks = _mixed(state.withColumn("_k", F.explode(F.expr("sequence(0, cast(_n as int) - 1)"))), F.col("_k")).withColumn("_i", F.expr("cast(_x % _n as int)"))
    counts = picks.groupBy(*CELL, "draw", "_i").agg(F.count("*").alias("m"))
    return counts.join(numbered, [*CELL, "_i"]).select(*CELL, "draw", "q_session", "m")


def bootstrap_intervals(sums: DataFrame, draws: DataFrame, confidence: float, resamples: int, reference: str = "raw_knn") -> DataFrame:
    """Mean difference and percentile interval for each cell, model and loss."""
    alpha = (1 - confidence) / 2
    keys = [*CELL, "model", "loss"]
    whole = sums.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean_difference"), F.sum("n").alias("n_forecasts"), F.count_distinct("q_session").alias("n_sessions"))
    ratios = sums.join(draws, [*CELL, "q_session"]).groupBy(*keys, "draw").agg((F.sum(F.col("m") * F.col("total")) / F.sum(F.col("m") * F.col("n"))).alias("ratio"))
    limits = ratios.groupBy(*keys).agg(F.percentile("ratio", F.lit(alpha)).alias("ci_lower"), F.percentile("ratio", F.lit(1 - alpha)).alias("ci_upper"))
    return whole.join(limits, keys, "left").withColumns({
        "reference": F.lit(reference), "confidence": F.lit(confidence), "n_resamples": F.lit(resamples),
        "status": F.when(F.col("n_sessions") >= 2, "ok").otherwise("insufficient_sessions"),
    })


def paired_session_bootstrap(predictions: DataFrame, resamples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    from .metrics import require_cohorts

    require_cohorts(predictions)
    from ..plans.store import keep

    sums = keep(cluster_sums(predictions), "sums")
    draws = multiplicities(sums, resamples, seed)
    return bootstrap_intervals(sums, draws, confidence, resamples).orderBy("embargo_sessions", "fold", "horizon_minutes", "model", "loss")


def conclusion(intervals: DataFrame, horizons: list[int], n_folds: int, synthetic: bool = False) -> DataFrame:
    """One row (outcome): improved, not_improved, inconclusive or synthetic, from absolute-error rows of one model and embargo."""
    spark = intervals.sparkSession
    if synthetic:
        return spark.createDataFrame([("synthetic",)], "outcome string")
    cells = len(horizons) * (n_folds + 1)
    top, low = F.col("fold") == 0, F.col("fold") > 0
    every = lambda rows, ok: F.coalesce(F.bool_and(F.when(rows, F.coalesce(ok, F.lit(False)))), F.lit(False))
    known = intervals.agg(
        F.count("*").alias("n"), F.count_distinct("fold", "horizon_minutes").alias("cells"),
        F.coalesce(F.bool_and(F.col("fold").between(0, n_folds) & F.col("horizon_minutes").isin(*horizons)), F.lit(False)).alias("expected"),
        every(top, (F.col("status") == "ok") & F.col("ci_lower").isNotNull() & F.col("ci_upper").isNotNull()).alias("sound"),
        every(top, F.col("ci_upper") < 0).alias("top_better"), every(low, F.col("mean_difference") < 0).alias("folds_better"),
        every(top, F.col("ci_lower") > 0).alias("top_worse"), every(low, F.col("mean_difference") > 0).alias("folds_worse"),
    )
    complete = (F.col("n") == cells) & (F.col("cells") == cells) & F.col("expected") & F.col("sound")
    return known.select(
        F.when(complete & F.col("top_better") & F.col("folds_better"), "improved")
        .when(complete & F.col("top_worse") & F.col("folds_worse"), "not_improved")
        .otherwise("inconclusive").alias("outcome")
    )

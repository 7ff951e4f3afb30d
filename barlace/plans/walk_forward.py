"""Walk-forward evaluation as one lazily composed plan; the refit block is a column, not a loop.

Blocks are numbered in time.  A bar of block b belongs to the panel of every
later accepted block, as training if b is earlier: an equi-join on block numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import refit_key
from ..operators import bars as ops
from ..operators import hmm, preprocessing
from ..operators import retrieval as rt
from .config import Config
from .store import keep

KEYS = ["refit_id", "q_t", "embargo_sessions"]


class NoEvaluableQueries(RuntimeError):
    pass


@dataclass
class WalkForward:
    """Tables of one evaluation; panel, contexts and common queries are kept, the rest runs when used."""

    config: Config
    bars: DataFrame  # with features, labels, recent_return, block
    blocks: DataFrame  # block, refit_id, first_t, last_t, n_train_sessions, accepted
    panel: DataFrame  # standardized rows by refit
    contexts: DataFrame  # rows with a context vector
    queries: DataFrame
    candidates: DataFrame
    folds: DataFrame  # session, fold
    common: DataFrame | None = None  # queries of the common cohort, once they are known

    @property
    def horizons(self) -> list[int]:
        return list(self.config.horizons_minutes)


def refit_blocks(bars: DataFrame, frequency: str, min_sessions: int) -> DataFrame:
    """(block, refit_id, first_t, last_t, n_bars, n_train_sessions, accepted), one row per block in time order."""
    keyed = bars.withColumn("refit_id", refit_key(F.col("session"), frequency))
    found = keyed.groupBy("refit_id").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n_bars"), F.count_distinct("session").alias("_sessions"))
    order = W.partitionBy(F.lit(0)).orderBy("first_t")  # one row per block
    return (
        found.withColumn("block", F.row_number().over(order))
        .withColumn("n_train_sessions", F.coalesce(F.sum("_sessions").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("accepted", F.col("n_train_sessions") >= min_sessions)
        .drop("_sessions")
    )


def fold_map(bars: DataFrame, blocks: DataFrame, frequency: str, n_folds: int) -> DataFrame:
    """(session, fold): chronological near-equal folds of the sessions of accepted blocks."""
    planned = bars.select("session").distinct().withColumn("refit_id", refit_key(F.col("session"), frequency)).join(blocks.where("accepted").select("refit_id"), "refit_id")
    order = W.partitionBy(F.lit(0)).orderBy("session")  # one row per session
    n = W.partitionBy(F.lit(0))
    numbered = planned.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(n)})
    # the first n mod folds folds have one session more
    small = F.floor(F.col("_n") / F.least(F.lit(n_folds), F.col("_n")))
    more = F.col("_n") % F.least(F.lit(n_folds), F.col("_n"))
    edge = more * (small + 1)
    fold = F.when(F.col("_k") < edge, F.floor(F.col("_k") / (small + 1))).otherwise(more + F.floor((F.col("_k") - edge) / small))
    return numbered.select("session", (fold + 1).cast("int").alias("fold"))


def plan(bars: DataFrame, config: Config) -> WalkForward:
    """``bars``: validated bars with session columns and segment_id."""
    columns = config.features.columns
    rows = ops.causal_features(bars, config.features.realized_vol_window)
    rows = ops.recent_return(ops.forward_labels(rows, config.horizon_bars), config.context_bars)
    wf = config.walk_forward
    blocks = refit_blocks(bars, wf.refit_frequency, wf.min_training_sessions)
    rows = rows.withColumn("own_refit", refit_key(F.col("session"), wf.refit_frequency)).join(
        blocks.select(F.col("refit_id").alias("own_refit"), "block", F.max("block").over(W.partitionBy(F.lit(0))).alias("_last")), "own_refit"
    )
    later = rows.withColumn("_in", F.explode(F.sequence(F.col("block"), F.col("_last")))).drop("_last")
    accepted = blocks.where("accepted").select(F.col("block").alias("_in"), "refit_id")
    panel = later.join(accepted, "_in").withColumn("is_train", F.col("block") < F.col("_in")).drop("_in")
    if "volume_surprise" in columns:
        panel = preprocessing.with_surprise(panel, preprocessing.volume_statistics(panel))
    panel = preprocessing.standardized(panel, preprocessing.scaler_statistics(panel, columns), columns)
    panel = keep(panel, "panel")  # every method reads it
    known = reduce(lambda a, b: a & b, (F.col(f"return_{h}m").isNotNull() for h in config.horizons_minutes))
    made = ops.contexts(panel, columns, config.context_bars, by=["refit_id"]).where("context is not null")
    made = keep(made, "contexts")
    horizons = config.horizons_minutes
    queries = made.where(~F.col("is_train") & known & F.col("recent_return").isNotNull()).select(
        "refit_id", F.col("t").alias("q_t"), F.col("session").alias("q_date"), F.col("session_index").alias("q_session"), F.col("minute_of_session").alias("q_minute"),
        "context_start", F.col("context").alias("q_vector"), "recent_return", *(F.col(f"return_{h}m").alias(f"actual_{h}m") for h in horizons), *(F.col(f"outcome_end_{h}m").alias(f"q_outcome_{h}m") for h in horizons),
    )
    candidates = made.where(F.col(f"outcome_end_{max(horizons)}m").isNotNull()).select(
        "refit_id", F.col("t").alias("c_t"), F.col("session_index").alias("c_session"), F.col("minute_of_session").alias("c_minute"), F.col("context").alias("c_vector"),
        F.col("context_start").alias("c_start"), F.col(f"outcome_end_{max(horizons)}m").alias("c_known"), *(f"return_{h}m" for h in horizons), *(f"outcome_end_{h}m" for h in horizons),
    )
    return WalkForward(config, rows.drop("_last"), blocks, panel, made, queries, candidates, fold_map(bars, blocks, wf.refit_frequency, wf.n_folds))


def returns(w: WalkForward) -> list[str]:
    return [f"return_{h}m" for h in w.horizons]


def same_time_pairs(w: WalkForward) -> DataFrame:
    q = w.queries.select("refit_id", "q_t", "q_session", "q_minute")
    c = w.candidates.select("refit_id", "c_t", "c_session", "c_minute", "c_known", *returns(w))
    return rt.by_embargo(rt.available_pairs(q, c, returns(w), same_minute=True), w.config.embargoes)


def common_queries(w: WalkForward) -> DataFrame:
    """Queries whose same-time cohort is non-empty under every embargo."""
    if w.common is not None:
        return w.common
    whole = same_time_pairs(w).groupBy("refit_id", "q_t").agg(F.count_distinct("embargo_sessions").alias("n")).where(F.col("n") == len(w.config.embargoes))
    w.common = keep(w.queries.join(whole.select("refit_id", "q_t"), ["refit_id", "q_t"], "left_semi"), "queries")
    return w.common


def unconditional_pairs(w: WalkForward, queries: DataFrame) -> DataFrame:
    c = w.candidates.select("refit_id", "c_t", "c_session", "c_known", *returns(w))
    return rt.by_embargo(rt.available_pairs(queries.select("refit_id", "q_t", "q_session"), c, returns(w)), w.config.embargoes)


def neighbor_pairs(w: WalkForward, queries: DataFrame, query_vectors: str = "q_vector", candidates: DataFrame | None = None, width: int | None = None) -> DataFrame:
    """Capped nearest neighbours for each embargo: refit, q_t, embargo, c_t, c_session, distance, rank, returns.

    Distances are computed once for all embargoes, vectors leave before the next
    shuffle, and the cap of a session, on which no embargo has a say, comes before the
    pairs are multiplied by the embargoes.
    """
    r = w.config.retrieval
    if candidates is None:
        width = w.config.context_bars * len(w.config.features.columns)
    c = (w.candidates if candidates is None else candidates).select("refit_id", "c_t", "c_session", "c_known", "c_vector")
    pairs = rt.available_pairs(queries.select("refit_id", "q_t", "q_session", F.col(query_vectors).alias("q_vector")), c, ["q_vector", "c_vector"])
    near = rt.capped(rt.with_distance(pairs, "q_vector", "c_vector", r.distance, width), r.max_neighbors_per_session, ["refit_id", "q_t"], "c_session")
    chosen = rt.nearest(rt.by_embargo(near, w.config.embargoes), r.k, KEYS)
    labels = w.candidates.select("refit_id", "c_t", *returns(w))
    return chosen.join(labels, ["refit_id", "c_t"])


def trajectories(w: WalkForward, models: DataFrame, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(queries, candidates) vectors in posterior space: (refit_id, t, current, trajectory)."""
    posterior = hmm.filter_refits(w.panel, w.config.features.columns, models, seconds)
    c = w.config.context_bars
    rows = w.panel.select("refit_id", "t", "segment_id").join(posterior, ["refit_id", "t"], "left")
    run = W.partitionBy("refit_id", "segment_id").orderBy("t").rowsBetween(-(c - 1), 0)
    return rows.withColumn("_p", F.collect_list("posterior").over(run)).where((F.size("_p") == c) & F.col("posterior").isNotNull()).select(
        "refit_id", "t", F.col("posterior").alias("current"), F.flatten("_p").alias("trajectory")
    )


METHODS = ("unconditional", "same_time_of_day", "raw_knn", "momentum")


def forecasts(w: WalkForward, models: DataFrame | None = None, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Predictions of the named methods for the common queries, and of the two latent methods with ``models``.

    A refit whose model failed is left out for every method, so cohorts stay paired.
    """
    queries = modelled(common_queries(w), models)
    own = queries.select("refit_id", "q_t")
    hs = w.horizons
    makers = {
        "unconditional": lambda: rt.cohort_forecast(unconditional_pairs(w, queries), queries, "unconditional", hs, KEYS),
        "same_time_of_day": lambda: rt.cohort_forecast(same_time_pairs(w).join(own, ["refit_id", "q_t"], "left_semi"), queries, "same_time_of_day", hs, KEYS),
        "raw_knn": lambda: rt.cohort_forecast(neighbor_pairs(w, queries), queries, "raw_knn", hs, KEYS, "distance"),
        "momentum": lambda: rt.momentum_forecast(queries.withColumn("embargo_sessions", F.explode(F.lit(w.config.embargoes).cast("array<int>"))), w.config.horizon_bars, w.config.context_bars, KEYS),
    }
    parts = [makers[m]() for m in methods]
    if models is not None:
        parts += [rt.cohort_forecast(neighbor_pairs(w, q, "q_latent", c, width), queries, method, hs, KEYS, "distance") for method, q, c, width in latent_sides(w, queries, models)]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    about = queries.select("refit_id", "q_t", "q_date", "q_session", "q_minute", "context_start", F.explode(F.create_map(*(x for h in hs for x in (F.lit(h), F.col(f"q_outcome_{h}m"))))).alias("horizon_minutes", "outcome_end"))
    limits = w.blocks.select("refit_id", F.col("first_t").alias("refit_block_start"))
    cut = w.panel.where("is_train").groupBy("refit_id").agg(F.max("t").alias("fit_end"))
    return (
        out.join(about, ["refit_id", "q_t", "horizon_minutes"])
        .join(w.folds.withColumnRenamed("session", "q_date"), "q_date")
        .join(limits, "refit_id")
        .join(cut, "refit_id")
        .withColumns({"latest_feature_t": F.col("q_t"), "query_model_id": F.col("refit_id")})
    )


def fit_models(w: WalkForward) -> DataFrame:
    hmm.check_input(w.panel, w.config.features.columns)
    return hmm.fit_refits(w.panel, w.config.features.columns, w.config.hmm)


def latent_sides(w: WalkForward, queries: DataFrame, models: DataFrame):
    """(method, queries with q_latent, candidates, vector width) of the two methods in posterior space."""
    latent, states = trajectories(w, models, w.config.bar_minutes * 60), w.config.hmm.n_states
    for method, vector, width in (("hmm_current", "current", states), ("hmm_trajectory", "trajectory", states * w.config.context_bars)):
        q = queries.join(latent.select("refit_id", F.col("t").alias("q_t"), F.col(vector).alias("q_latent")), ["refit_id", "q_t"])
        c = w.candidates.drop("c_vector").join(latent.select("refit_id", F.col("t").alias("c_t"), F.col(vector).alias("c_vector")), ["refit_id", "c_t"])
        yield method, q, c, width


def modelled(queries: DataFrame, models: DataFrame | None) -> DataFrame:
    """The queries that are forecast: those of refits whose model was accepted."""
    return queries if models is None else queries.join(models.where("status = 'accepted'").select("refit_id"), "refit_id", "left_semi")


def neighbor_audit(w: WalkForward, queries: DataFrame, models: DataFrame | None = None, methods: tuple[str, ...] = ("unconditional", "same_time_of_day", "raw_knn")) -> DataFrame:
    """One row per forecast query, embargo, method and member of its cohort, with the member's outcomes.

    Cohorts without distances are ranked by time.  Momentum has no cohort.
    """
    queries = modelled(queries, models)
    own = queries.select("refit_id", "q_t")
    by_time = lambda pairs: pairs.select(*KEYS, "c_t", "c_session", F.lit(None).cast("double").alias("distance"), F.row_number().over(W.partitionBy(*KEYS).orderBy("c_t")).alias("rank"), *returns(w))
    makers = {
        "unconditional": lambda: by_time(unconditional_pairs(w, queries)),
        "same_time_of_day": lambda: by_time(same_time_pairs(w).join(own, ["refit_id", "q_t"], "left_semi")),
        "raw_knn": lambda: neighbor_pairs(w, queries),
    }
    parts = [(m, makers[m]()) for m in methods]
    if models is not None:
        parts += [(method, neighbor_pairs(w, q, "q_latent", c, width)) for method, q, c, width in latent_sides(w, queries, models)]
    shape = [*KEYS, "c_t", "c_session", "distance", "rank", *returns(w)]
    rows = reduce(lambda a, b: a.unionByName(b), (part.select(*shape, F.lit(method).alias("method")) for method, part in parts))
    about = w.candidates.select("refit_id", "c_t", "c_start", *(f"outcome_end_{h}m" for h in w.horizons))
    q = queries.select("refit_id", "q_t", F.col("q_session").alias("query_session_index"))
    cut = w.panel.where("is_train").groupBy("refit_id").agg(F.max("t").alias("fit_end"))
    known = {"query_model_id": F.col("refit_id"), "neighbor_model_id": F.col("refit_id")}
    return rows.join(about, ["refit_id", "c_t"]).join(q, ["refit_id", "q_t"]).join(cut, "refit_id").withColumns(known)


def skipped_blocks(w: WalkForward, models: DataFrame | None, queries: DataFrame) -> DataFrame:
    """(refit_id, reason) of blocks without forecasts."""
    few = w.blocks.where("not accepted").select("refit_id", F.lit("insufficient_training_sessions").alias("reason"))
    on = w.blocks.where("accepted").select("refit_id")
    out = few
    if models is not None:
        good = models.where("status = 'accepted'").select("refit_id")
        out = out.unionByName(on.join(good, "refit_id", "left_anti").withColumn("reason", F.lit("hmm_fit_failed")))
        on = on.join(good, "refit_id", "left_semi")
    return out.unionByName(on.join(queries.select("refit_id").distinct(), "refit_id", "left_anti").withColumn("reason", F.lit("no_common_eligible_queries")))


def examples(w: WalkForward, queries: DataFrame, neighbors: DataFrame, nearest: int = 3) -> DataFrame:
    """Contexts of the first query per refit and its nearest neighbours, step by step, closes relative to the first."""
    first = queries.groupBy("refit_id").agg(F.min("q_t").alias("q_t"))
    primary = neighbors.where((F.col("embargo_sessions") == w.config.retrieval.embargo_sessions) & (F.col("rank") <= nearest)).join(first, ["refit_id", "q_t"], "left_semi")
    ends = first.select("refit_id", "q_t", F.lit("query").alias("role"), F.lit(0).alias("rank"), F.col("q_t").alias("end_t")).unionByName(
        primary.select("refit_id", "q_t", F.lit("neighbor").alias("role"), "rank", F.col("c_t").alias("end_t"))
    )
    n, width = w.config.context_bars, w.config.bar_minutes * 60
    steps = ends.withColumn("context_step", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("t", F.col("end_t") - (n - 1 - F.col("context_step")) * width)
    rows = steps.join(w.panel.select("refit_id", "t", "close", *w.config.features.columns), ["refit_id", "t"])
    base = F.first("close").over(W.partitionBy("refit_id", "q_t", "role", "rank").orderBy("context_step"))
    return rows.withColumn("normalized_close", F.col("close") / base - 1)

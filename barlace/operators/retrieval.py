"""Availability join, exact capped nearest neighbours, and empirical forecasts.

The join of queries and past candidates is an equi-join: a query is repeated
for each session up to its own, and meets that session's candidates only.  So
it is dealt by (refit, session), never nested-loop, and large sessions can be
split by the adaptive skew join.  Whatever embargo is asked for is a filter on
``gap``, the sessions between query and candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import DISTANCES, hard_sign, momentum

if TYPE_CHECKING:
    import pandas as pd

SUMMARY = ["mean", "median", "probability_up", "q10", "q25", "q75", "q90", "return_std", "effective_neighbor_count", "distance_mean", "distance_min", "distance_max"]


def available_pairs(queries: DataFrame, candidates: DataFrame, carry: list[str] = (), same_minute: bool = False) -> DataFrame:
    """Pairs whose longest outcome was known at the query: (refit_id, q_t, c_t, c_session, gap, carried columns).

    queries: refit_id, q_t, q_session[, q_minute, ...]; candidates: refit_id,
    c_t, c_session, c_known[, c_minute, ...].
    """
    reach = queries.withColumn("c_session", F.explode(F.sequence(F.lit(0), F.col("q_session"))))
    keys = ["refit_id", "c_session"]
    if same_minute:
        reach, candidates, keys = reach.withColumn("minute", F.col("q_minute")), candidates.withColumnRenamed("c_minute", "minute"), [*keys, "minute"]
    pairs = reach.join(candidates, keys).where("c_known <= q_t and c_t < q_t")
    return pairs.select("refit_id", "q_t", "c_t", "c_session", (F.col("q_session") - F.col("c_session")).alias("gap"), *carry)


def allowed(embargo: Column, gap: Column) -> Column:
    """No embargo keeps the query's own session; a positive one drops it and as many before."""
    return (embargo == 0) | (gap > embargo)


def by_embargo(pairs: DataFrame, embargoes: list[int]) -> DataFrame:
    """Each pair once for every embargo that allows it."""
    return pairs.withColumn("embargo_sessions", F.explode(F.lit(embargoes).cast("array<int>"))).where(allowed(F.col("embargo_sessions"), F.col("gap")))


def capped(pairs: DataFrame, cap: int, keys: list[str], group: str, order: list[str] = ("distance", "c_t")) -> DataFrame:
    """The ``cap`` nearest of each group of a key; ties go to the earlier candidate."""
    if cap < 1:
        raise ValueError("cap is 1 or more")
    own = W.partitionBy(*keys, group).orderBy(*order)
    return pairs.withColumn("_in_group", F.row_number().over(own)).where(F.col("_in_group") <= cap).drop("_in_group")


def nearest(pairs: DataFrame, k: int, keys: list[str], order: list[str] = ("distance", "c_t")) -> DataFrame:
    """The k nearest per key, with ``rank``."""
    if k < 1:
        raise ValueError("k is 1 or more")
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def capped_nearest(pairs: DataFrame, k: int, cap: int, keys: list[str], group: str = "c_session", order: list[str] = ("distance", "c_t")) -> DataFrame:
    """The k nearest per key, at most ``cap`` of each group.

    Both filters are on row_number, so Spark drops rows before it shuffles.  The
    cap drops only rows that the greedy choice would skip, so both agree.
    """
    return nearest(capped(pairs, cap, keys, group, order), k, keys, order)


def with_distance(pairs: DataFrame, a: str, b: str, metric: str, width: int | None = None) -> DataFrame:
    """Adds the distance of two vectors and drops them, so that they stay out of later shuffles."""
    return pairs.withColumn("distance", DISTANCES[metric](F.col(a), F.col(b), width)).drop(a, b)


#: Items and queries of a block: at most so many vectors of either side meet in one task.
BLOCK_ROWS = 8192
#: Numbers of the largest array of differences within a task.
CHUNK_CELLS = 1 << 22


def _block_pairs(queries: np.ndarray, items: np.ndarray, metric: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, distances) for runs of queries against all items of a block, element by element, so equal vectors tie."""
    norms = [np.sqrt((x * x).sum(axis=1)) for x in (queries, items)]
    step = max(1, CHUNK_CELLS // max(1, items.size))
    for first in range(0, len(queries), step):
        some = queries[first : first + step, None, :]
        if metric == "euclidean":
            yield first, np.sqrt(((some - items[None]) ** 2).sum(axis=2))
            continue
        a, b = norms[0][first : first + step, None], norms[1][None]
        whole = a * b
        similarity = np.divide((some * items[None]).sum(axis=2), whole, out=np.zeros_like(whole), where=whole > 0)
        yield first, np.where((a == 0) & (b == 0), 0.0, np.where(whole == 0, 1.0, 1 - np.clip(similarity, -1, 1)))


def exact_knn(queries: DataFrame, items: DataFrame, k: int, cap: int, metric: str = "euclidean") -> DataFrame:
    """Neighbours of (q, qv) among (id, grp, v): (q, id, grp, distance, rank); the item itself does not count.

    Queries are a stated set.  Both sides are dealt by a hash into blocks of about
    BLOCK_ROWS rows, as many as a count asks for; each block of queries meets each
    block of items in a task of its own, which keeps the ``cap`` nearest of each group.
    So no task holds more than two blocks, and only what the cap leaves is shuffled.
    """
    if metric not in DISTANCES:
        raise ValueError(f"unknown distance {metric}")
    spread = lambda table, name: (max(1, -(-table.count() // BLOCK_ROWS)), F.xxhash64(name))
    (n_q, by_q), (n_i, by_i) = spread(queries, "q"), spread(items, "id")
    deal = lambda n, by: F.pmod(by, F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("q", "qv", deal(n_q, by_q).alias("bq"), all_of(n_i).alias("bi"))
    right = items.select("id", "grp", "v", deal(n_i, by_i).alias("bi"), all_of(n_q).alias("bq"))
    kind = dict(queries.dtypes)["q"], dict(items.dtypes)["id"], dict(items.dtypes)["grp"]

    def best(some: pd.DataFrame, every: pd.DataFrame) -> pd.DataFrame:
        import pandas as pd

        parts = []
        if len(some) and len(every):
            every = every.sort_values("id", kind="stable").reset_index(drop=True)
            for first, distances in _block_pairs(np.stack(some["qv"].to_numpy()), np.stack(every["v"].to_numpy()), metric):
                rows = np.repeat(np.arange(len(distances)), len(every))
                near = pd.DataFrame({"q": some["q"].to_numpy()[first + rows], "id": np.tile(every["id"].to_numpy(), len(distances)), "grp": np.tile(every["grp"].to_numpy(), len(distances)), "distance": distances.ravel()})
                near = near[near["q"] != near["id"]].sort_values("distance", kind="stable")
                parts.append(near[near.groupby(["q", "grp"], dropna=False).cumcount() < cap])
        return pd.concat(parts) if parts else pd.DataFrame({"q": [], "id": [], "grp": [], "distance": []})

    found = left.groupBy("bq", "bi").cogroup(right.groupBy("bq", "bi")).applyInPandas(best, f"q {kind[0]}, id {kind[1]}, grp {kind[2]}, distance double")
    return capped_nearest(found, k, cap, ["q"], "grp", ["distance", "id"])


def summary_columns(value: str, distance: str | None = None) -> list[Column]:
    """Aggregates of an empirical forecast distribution; quantiles are exact and interpolated."""
    q = lambda p: F.percentile(value, F.lit(p))
    far = [F.avg(distance), F.min(distance), F.max(distance)] if distance else [F.lit(None).cast("double")] * 3
    return [
        F.avg(value).alias("mean"), q(0.5).alias("median"), F.avg((F.col(value) > 0).cast("double")).alias("probability_up"),
        q(0.1).alias("q10"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.9).alias("q90"),
        F.stddev_pop(value).alias("return_std"), F.count(value).alias("effective_neighbor_count"),
        *(x.alias(f"distance_{n}") for x, n in zip(far, ("mean", "min", "max"), strict=True)),
    ]


def long_returns(rows: DataFrame, horizons: list[int], prefix: str = "") -> DataFrame:
    """One row per horizon: horizon_minutes and the return of that horizon as ``historical``."""
    pairs = [x for h in horizons for x in (F.lit(h), F.col(f"{prefix}return_{h}m"))]
    return rows.select("*", F.explode(F.create_map(*pairs)).alias("horizon_minutes", "historical"))


def cohort_forecast(cohort: DataFrame, queries: DataFrame, method: str, horizons: list[int], keys: list[str], distance: str | None = None) -> DataFrame:
    """Forecast rows from cohort rows that carry return_{h}m; ``queries`` has q_t and actual_{h}m."""
    actual = queries.select(*(k for k in keys if k != "embargo_sessions"), F.explode(F.create_map(*(x for h in horizons for x in (F.lit(h), F.col(f"actual_{h}m"))))).alias("horizon_minutes", "actual_return"))
    rows = long_returns(cohort, horizons).join(actual, [*(k for k in keys if k != "embargo_sessions"), "horizon_minutes"])
    return rows.groupBy(*keys, "horizon_minutes").agg(
        *summary_columns("historical", distance),
        F.first("actual_return").alias("actual_return"),
        F.avg((F.col("historical") <= F.col("actual_return")).cast("double")).alias("realized_percentile"),
    ).withColumn("method", F.lit(method))


def momentum_forecast(queries: DataFrame, horizon_bars: dict[int, int], context_bars: int, keys: list[str]) -> DataFrame:
    """Point forecast by extrapolation of the trailing return; no distribution, no neighbours."""
    rows = queries.select(*keys, "recent_return", F.explode(F.array(*(
        F.struct(F.lit(h).alias("horizon_minutes"), momentum(F.col("recent_return"), steps, context_bars).alias("median"), F.col(f"actual_{h}m").alias("actual_return"))
        for h, steps in horizon_bars.items()
    ))).alias("x")).select(*keys, "x.*")
    none = F.lit(None).cast("double")
    return rows.withColumns({
        "mean": F.col("median"), "probability_up": hard_sign(F.col("median")), **dict.fromkeys(["q10", "q25", "q75", "q90", "return_std"], none),
        "effective_neighbor_count": F.lit(0).cast("long"), **dict.fromkeys(["distance_mean", "distance_min", "distance_max", "realized_percentile"], none), "method": F.lit("momentum"),
    })

"""Long/flat trade simulation from forecasts.

A signal enters at the next bar's open and leaves at its outcome's close, both
in its own segment.  So trades of one track (method, horizon) can only overlap
within a session: the greedy choice is a fold over one session's sorted signals,
and only the compounding runs over sessions, on one row per session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import finite

TRACK = ["method", "horizon_minutes"]


class TradingInputError(ValueError):
    pass


def checked(bars: DataFrame, signals: DataFrame) -> None:
    """Raises unless bars are unique with sound prices and each signal is unique and stands on a bar."""
    bad = ~finite(F.col("open")) | ~finite(F.col("close")) | (F.col("open") <= 0) | (F.col("close") <= 0)
    b = bars.agg((F.count("*") - F.count_distinct("t")).alias("twice"), F.count(F.when(bad, 1)).alias("bad")).first()
    if b["twice"]:
        raise TradingInputError("bars must be unique in time")
    if b["bad"]:
        raise TradingInputError("open and close must be finite and positive")
    if not signals.groupBy(*TRACK, "q_t").count().where("count > 1").isEmpty():
        raise TradingInputError("one prediction per method, horizon and query")
    if not signals.select(F.col("q_t").alias("t")).join(bars.select("t"), "t", "left_anti").isEmpty():
        raise TradingInputError("query timestamps must exist in the bars")


def run_segments(bars: DataFrame, seconds: int) -> DataFrame:
    """Adds run: bars that follow each other without any gap, numbered within their session, and the next bar of the run."""
    own = W.partitionBy("session").orderBy("t")
    together = (F.col("t") - F.lag("t").over(own) == seconds) & (F.col("segment_id") == F.lag("segment_id").over(own))
    out = bars.withColumn("_new", F.when(F.coalesce(together, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("_new").over(own)).drop("_new")
    chain = W.partitionBy("session", "run").orderBy("t")
    return out.withColumns({"next_t": F.lead("t").over(chain), "next_open": F.lead("open").over(chain)})


def span_bars(bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Bars of the sessions from the first to the last query's."""
    limits = signals.select(F.col("q_t").alias("t")).join(bars.select("t", "session"), "t").agg(F.min("session").alias("_a"), F.max("session").alias("_b"))
    return bars.join(F.broadcast(limits), F.col("session").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")  # one row


def trades(bars: DataFrame, signals: DataFrame, threshold: float, bps_per_side: float, seconds: int) -> DataFrame:
    """Executed round trips with compounding net cash.  ``signals``: method, horizon_minutes, q_t, outcome_end, median."""
    c = bps_per_side / 10_000
    ready = run_segments(bars, seconds)
    entry = ready.select(F.col("t").alias("q_t"), "session", "run", F.col("next_t").alias("entry_t"), F.col("next_open").alias("entry_price")).where("entry_t is not null")
    leave = span_bars(ready, signals).select(F.col("t").alias("outcome_end"), "session", "run", F.col("close").alias("exit_price"))
    possible = signals.where(F.col("median") > threshold).join(entry, "q_t").join(leave, ["outcome_end", "session", "run"]).where("outcome_end >= entry_t")
    # greedy by session: a signal at or after the last exit trades
    one = F.struct("q_t", "outcome_end", "entry_t", "entry_price", "exit_price")
    kept = "aggregate(_s, named_struct('last', -9223372036854775807L, 'kept', filter(_s, x -> false)), (a, x) -> if(x.q_t < a.last, a, named_struct('last', x.outcome_end, 'kept', array_append(a.kept, x))), a -> a.kept)"
    chosen = possible.groupBy(*TRACK, "session").agg(F.sort_array(F.collect_list(one)).alias("_s")).select(*TRACK, "session", F.explode(F.expr(kept)).alias("x")).select(*TRACK, "session", "x.*")
    chosen = chosen.withColumns({
        "gross_return": F.col("exit_price") / F.col("entry_price") - 1,
        "net_return": F.col("exit_price") / F.col("entry_price") * ((1 - c) / (1 + c)) - 1,
        "holding_bars": ((F.col("outcome_end") - F.col("q_t")) / seconds).cast("int"),
    })
    return compounded(chosen, c)


def compounded(chosen: DataFrame, c: float) -> DataFrame:
    """Adds cash before and after each trade; across sessions by a product over one row per session."""
    inner = W.partitionBy(*TRACK, "session").orderBy("q_t").rowsBetween(W.unboundedPreceding, 0)
    grown = chosen.withColumns({"_ln": F.sum(F.log1p("net_return")).over(inner), "_lg": F.sum(F.log1p("gross_return")).over(inner)})
    days = W.partitionBy(*TRACK).orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    totals = chosen.groupBy(*TRACK, "session").agg(F.sum(F.log1p("net_return")).alias("_n"), F.sum(F.log1p("gross_return")).alias("_g"))
    before = totals.select(*TRACK, "session", F.coalesce(F.sum("_n").over(days), F.lit(0.0)).alias("_bn"), F.coalesce(F.sum("_g").over(days), F.lit(0.0)).alias("_bg"))
    out = grown.join(before, [*TRACK, "session"]).withColumns({
        "net_equity_after": F.exp(F.col("_bn") + F.col("_ln")), "net_equity_before": F.exp(F.col("_bn") + F.col("_ln") - F.log1p("net_return")),
        "gross_equity_after": F.exp(F.col("_bg") + F.col("_lg")), "gross_equity_before": F.exp(F.col("_bg") + F.col("_lg") - F.log1p("gross_return")),
    })
    units = F.col("net_equity_before") / (F.col("entry_price") * (1 + c))
    out = out.withColumn("net_units", units).withColumns({"entry_notional": F.col("net_units") * F.col("entry_price"), "exit_notional": F.col("net_units") * F.col("exit_price")})
    return out.withColumns({"entry_cost": F.col("entry_notional") * c, "exit_cost": F.col("exit_notional") * c, "costs": (F.col("entry_notional") + F.col("exit_notional")) * c}).drop("_ln", "_lg", "_bn", "_bg")


def equity(bars: DataFrame, signals: DataFrame, done: DataFrame) -> DataFrame:
    """(method, horizon, session, t, gross_equity, net_equity) for each bar of the span: marks while held, cash elsewhere."""
    span = span_bars(bars, signals).select("t", "session", "close")
    tracks = signals.select(*TRACK).distinct()
    grid = span.withColumn("_one", F.lit(1)).join(F.broadcast(tracks.withColumn("_one", F.lit(1))), "_one").drop("_one")  # a handful of tracks
    held = done.select(*TRACK, "session", "q_t", "entry_t", "outcome_end", "entry_price", "net_units", "entry_notional", "net_equity_after", "gross_equity_before", "gross_equity_after")
    rows = grid.join(held, [*TRACK, "session"], "left").withColumn("_in", (F.col("t") >= F.col("q_t")) & (F.col("t") <= F.col("outcome_end")))
    # at most one trade covers a bar, but a trade may begin on the bar at which another ends: the later one marks the fee
    best = W.partitionBy(*TRACK, "session", "t").orderBy(F.desc_nulls_last(F.when(F.col("_in"), F.col("q_t"))))
    rows = rows.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    inside = F.coalesce(F.col("_in"), F.lit(False))
    net = F.when(inside, F.when(F.col("t") == F.col("q_t"), F.col("entry_notional")).when(F.col("t") == F.col("outcome_end"), F.col("net_equity_after")).otherwise(F.col("net_units") * F.col("close")))
    gross = F.when(inside, F.when(F.col("t") == F.col("q_t"), F.col("gross_equity_before")).otherwise(F.col("gross_equity_before") / F.col("entry_price") * F.col("close")))
    marked = rows.select(*TRACK, "session", "t", net.alias("_net"), gross.alias("_gross"))
    ends = done.groupBy(*TRACK, "session").agg(F.max_by("net_equity_after", "q_t").alias("_dn"), F.max_by("gross_equity_after", "q_t").alias("_dg"))
    days = W.partitionBy(*TRACK).orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    sessions = span.select("session").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(tracks.withColumn("_one", F.lit(1))), "_one").drop("_one")
    opening = sessions.join(ends, [*TRACK, "session"], "left").select(
        *TRACK, "session", F.coalesce(F.last("_dn", True).over(days), F.lit(1.0)).alias("_on"), F.coalesce(F.last("_dg", True).over(days), F.lit(1.0)).alias("_og")
    )
    closes = done.select(*TRACK, "session", F.col("outcome_end").alias("t"), F.col("net_equity_after").alias("_cn"), F.col("gross_equity_after").alias("_cg"))
    own = W.partitionBy(*TRACK, "session").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    flat = marked.join(closes, [*TRACK, "session", "t"], "left").join(opening, [*TRACK, "session"])
    return flat.select(
        *TRACK, "session", "t",
        F.coalesce("_gross", F.last("_cg", True).over(own), "_og").alias("gross_equity"), F.coalesce("_net", F.last("_cn", True).over(own), "_on").alias("net_equity"),
    )


def trading_metrics(marks: DataFrame, done: DataFrame, bps_per_side: float) -> DataFrame:
    """Return, last equity, Sharpe (252 days), drawdown, hit rate, turnover and time in market of each track, with or without trades.

    The equity stands beside the return because ``equity - 1`` has no digits left of an equity near 0.
    """
    daily = marks.groupBy(*TRACK, "session").agg(F.max_by("net_equity", "t").alias("close"), F.max(F.greatest("net_equity", F.lit(1.0))).alias("day_peak"), F.count("*").alias("bars"))
    days = W.partitionBy(*TRACK).orderBy("session")
    before = days.rowsBetween(W.unboundedPreceding, -1)
    daily = daily.withColumns({"r": F.col("close") / F.coalesce(F.lag("close").over(days), F.lit(1.0)) - 1, "peak_before": F.coalesce(F.max("day_peak").over(before), F.lit(1.0))})
    own = W.partitionBy(*TRACK, "session").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    drop = marks.join(daily.select(*TRACK, "session", "peak_before"), [*TRACK, "session"]).withColumn("peak", F.greatest("peak_before", F.max(F.greatest("net_equity", F.lit(1.0))).over(own)))
    worst = drop.groupBy(*TRACK).agg(F.max(1 - F.col("net_equity") / F.col("peak")).alias("max_drawdown"), F.max_by("gross_equity", "t").alias("_gross"), F.max_by("net_equity", "t").alias("_net"))
    table = daily.groupBy(*TRACK).agg(F.count("*").alias("n_sessions"), F.sum("bars").alias("n_bars"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_std"))
    sums = done.groupBy(*TRACK).agg(
        F.count("*").alias("n_trades"), F.avg((F.col("net_return") > 0).cast("double")).alias("hit_rate"), F.avg("net_return").alias("average_holding_return"),
        F.sum(F.col("entry_notional") + F.col("exit_notional")).alias("turnover"), F.sum("holding_bars").alias("_held"),
    )
    out = table.join(worst, TRACK).join(sums, TRACK, "left")
    return out.select(
        *TRACK, F.coalesce("n_trades", F.lit(0)).alias("n_trades"), "n_sessions", "n_bars",
        (F.col("_gross") - 1).alias("gross_return"), (F.col("_net") - 1).alias("net_return"), F.col("_net").alias("net_equity"),
        F.when(F.col("_std") > 0, F.sqrt(F.lit(252.0)) * F.try_divide(F.col("_mean"), F.col("_std"))).alias("sharpe"), "max_drawdown", "hit_rate", "average_holding_return",
        F.coalesce("turnover", F.lit(0.0)).alias("turnover"), (F.coalesce("_held", F.lit(0)) / F.col("n_bars")).alias("time_in_market"), F.lit(bps_per_side).alias("bps_per_side"),
    )

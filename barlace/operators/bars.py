"""Validation, segments, window features and labels of bars.

All functions take bars with ``t`` (bar end, epoch seconds), ``session``,
``session_index``, ``minute_of_session`` and prices.  ``by`` names further key
columns, such as a symbol: windows are dealt by them and by session or segment,
so no window spans the whole table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, masked
from ..plans.config import Config

PRICES = ("open", "high", "low", "close")
REQUIRED = ["timestamp", *PRICES, "volume"]
#: How each rule that bars can break is put into words.
WORDING = {
    "repeated_column": "column {column} stands more than once",
    "absent_column": "column {column} is not there",
    "not_numeric": "column {column} holds no numbers",
    "not_a_time": "column {column} holds no times",
    "no_rows": "there are no bars",
    "time_absent": "{rows} bars have no time",
    "time_repeated": "{rows} bars repeat the time of another",
    "price": "{column}: {rows} values are not finite or not above zero",
    "volume": "{column}: {rows} values are not finite or below zero",
    "enclosure": "{rows} bars whose low and high do not enclose open and close",
    "foreign_symbol": "{rows} bars are of another symbol than {detail}",
    "off_grid": "{rows} bars end at no time of the session grid",
    "coverage": "session {detail} holds too few of its bars",
}


@dataclass(frozen=True)
class Fault:
    """A broken rule, with the column, the number of rows or the detail that it concerns."""

    rule: str
    column: str | None = None
    rows: int | None = None
    detail: str | None = None

    def __str__(self) -> str:
        return WORDING[self.rule].format(column=self.column, rows=self.rows, detail=self.detail)


@dataclass
class QualityReport:
    number_of_bars: int = 0
    number_of_sessions: int = 0
    scheduled_session_count: int = 0
    duplicate_timestamps: int = 0
    ohlc_consistency_violations: int = 0
    date_range: dict = field(default_factory=dict)
    missing_bars_by_session: dict = field(default_factory=dict)
    session_coverage: dict = field(default_factory=dict)
    largest_timestamp_gaps: list = field(default_factory=list)
    errors: list = field(default_factory=list)


class BarDataError(ValueError):
    """Rejected bars: the faults found, and the report so far."""

    def __init__(self, faults: list[Fault], report: QualityReport):
        report.errors += map(str, faults)
        super().__init__("; ".join(report.errors))
        self.faults, self.report = faults, report


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1)), F.lit(0)).cast("long")


def quality_counts(bars: DataFrame) -> DataFrame:
    """One row of counters: bars, duplicates, invalid prices and volumes, OHLC violations, bounds."""
    bad_price = lambda c: ~finite(F.col(c)) | (F.col(c) <= 0)
    low, high = F.col("low"), F.col("high")
    violation = (low > high) | (F.col("open") < low) | (F.col("open") > high) | (F.col("close") < low) | (F.col("close") > high)
    return bars.agg(
        F.count("*").alias("n_bars"),
        (F.count("t") - F.count_distinct("t")).alias("n_duplicates"),
        _count_if(F.col("t").isNull()).alias("n_null_timestamps"),
        *(_count_if(bad_price(c)).alias(f"bad_{c}") for c in ("open", "high", "low", "close")),
        _count_if(~finite(F.col("volume")) | (F.col("volume") < 0)).alias("bad_volume"),
        _count_if(F.coalesce(violation, F.lit(False))).alias("ohlc_violations"),
        *([_count_if(bad_price("vwap")).alias("bad_vwap")] if "vwap" in bars.columns else []),
        F.min("t").alias("first_t"), F.max("t").alias("last_t"),
    )


def bar_gaps(bars: DataFrame, by: list[str] = ()) -> DataFrame:
    """(start_t, end_t, seconds) between neighbouring bars.

    Gaps within a session come from a window by session; those between sessions
    from the first and last bar of each, a table of one row per session.
    """
    own = W.partitionBy(*by, "session").orderBy("t")
    inside = bars.select(*by, F.lag("t").over(own).alias("start_t"), F.col("t").alias("end_t")).where("start_t is not null")
    edges = bars.groupBy(*by, "session").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    days = W.partitionBy(*by).orderBy("session") if by else W.orderBy("session")
    across = edges.select(*by, F.lag("last").over(days).alias("start_t"), F.col("first").alias("end_t")).where("start_t is not null")
    return inside.unionByName(across).withColumn("seconds", F.col("end_t") - F.col("start_t"))


def largest_gaps(bars: DataFrame, n: int = 10) -> DataFrame:
    """The n widest gaps; the earlier first among equals."""
    return bar_gaps(bars).orderBy(F.desc("seconds"), "end_t").limit(n)


def session_coverage(bars: DataFrame, grid: DataFrame) -> DataFrame:
    """(session, expected, observed, missing, coverage) for each scheduled session."""
    expected = grid.groupBy("session").agg(F.count("*").alias("expected"))
    observed = bars.select("t").join(grid.select("t", "session"), "t").groupBy("session").agg(F.count("*").alias("observed"))
    joined = expected.join(observed, "session", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return joined.withColumns({"missing": F.col("expected") - F.col("observed"), "coverage": F.col("observed") / F.col("expected")})


def off_grid(bars: DataFrame, grid: DataFrame) -> DataFrame:
    return bars.join(grid.select("t"), "t", "left_anti")


def schema_faults(bars: DataFrame) -> list[Fault]:
    """What the columns alone tell."""
    kinds = {f.name: f.dataType for f in bars.schema.fields}
    faults = [Fault("repeated_column", c) for c, n in Counter(bars.columns).items() if n > 1]
    faults += [Fault("absent_column", c) for c in REQUIRED if c not in kinds]
    numbers = [c for c in (*PRICES, "volume", "vwap") if c in kinds and not isinstance(kinds[c], T.NumericType)]
    faults += [Fault("not_numeric", c) for c in numbers]
    if "t" not in kinds and "timestamp" in kinds and not isinstance(kinds["timestamp"], T.TimestampType | T.TimestampNTZType):
        faults.append(Fault("not_a_time", "timestamp"))
    return faults


def at_bar_end(bars: DataFrame, config: Config) -> DataFrame:
    """Adds ``t``, the end of a bar in epoch seconds; times that label the start of a bar move by its length."""
    shift = config.bar_minutes if config.data.timestamp_label == "start" else 0
    moved = bars.withColumn("timestamp", F.expr(f"timestamp + interval {shift} minutes")) if shift else bars
    return moved.withColumn("t", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', cast(timestamp as timestamp_ntz))"))


def value_faults(counts: dict) -> list[Fault]:
    """What the counters of ``quality_counts`` tell about values."""
    held = {("price", c): f"bad_{c}" for c in (*PRICES, "vwap")} | {("volume", "volume"): "bad_volume", ("enclosure", None): "ohlc_violations"}
    return [Fault(rule, column, counts[name]) for (rule, column), name in held.items() if counts.get(name)]


def validate_bars(bars: DataFrame, grid: DataFrame, config: Config) -> tuple[DataFrame, QualityReport]:
    """Canonical bars with session columns and segments, or BarDataError.

    Bars are judged in three steps, each of which reports all it finds: columns,
    then times, then values, symbol, grid and coverage together.  A column ``t`` is
    taken as the end of the bar.  The file order of rows cannot be known after a
    distributed scan, so times must be unique, and are ordered here.
    """
    report = QualityReport()

    def stop_at(faults: list[Fault]) -> None:
        if faults:
            raise BarDataError(faults, report)

    stop_at(schema_faults(bars))
    bars = bars if "t" in bars.columns else at_bar_end(bars, config)
    counts = quality_counts(bars).first().asDict()
    report.number_of_bars, report.duplicate_timestamps, report.ohlc_consistency_violations = counts["n_bars"], counts["n_duplicates"], counts["ohlc_violations"]
    times = {"time_absent": "n_null_timestamps", "time_repeated": "n_duplicates"}
    stop_at([Fault("no_rows")] if not counts["n_bars"] else [Fault(rule, rows=counts[name]) for rule, name in times.items() if counts[name]])
    report.date_range = {"start": counts["first_t"], "end": counts["last_t"]}
    faults = value_faults(counts)
    if "symbol" in bars.columns:
        foreign = bars.where(~F.col("symbol").eqNullSafe(config.symbol)).count()
        faults += [Fault("foreign_symbol", "symbol", foreign, config.symbol)] if foreign else []
    if stray := off_grid(bars, grid).count():
        faults.append(Fault("off_grid", rows=stray))
    for row in session_coverage(bars, grid).orderBy("session").collect():  # one row for each scheduled session
        day = row["session"].isoformat()
        report.scheduled_session_count += 1
        report.number_of_sessions += row["observed"] > 0
        report.missing_bars_by_session[day], report.session_coverage[day] = row["missing"], row["coverage"]
        if 0 < row["observed"] < config.data.min_session_coverage * row["expected"]:
            faults.append(Fault("coverage", rows=row["observed"], detail=f"{day} ({row['observed']} of {row['expected']})"))
    stop_at(faults)
    prepared = bars.drop("session", "session_index", "minute_of_session", "segment_id").join(grid, "t")
    gaps = largest_gaps(prepared).collect()  # ten rows
    report.largest_timestamp_gaps = [{"start": g["start_t"], "end": g["end_t"], "minutes": g["seconds"] / 60} for g in gaps]
    return with_segments(prepared, config.bar_minutes), report


def with_segments(bars: DataFrame, minutes: int, by: list[str] = ()) -> DataFrame:
    """Adds segment_id: a new one at each session change and each gap.

    Islands are numbered within their session; what comes before is a running
    sum over one row per session.
    """
    own = W.partitionBy(*by, "session").orderBy("t")
    starts = F.when(F.col("t") - F.lag("t").over(own) == minutes * 60, 0).otherwise(1)
    marked = bars.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(own))
    counts = marked.groupBy(*by, "session").agg(F.sum("_start").alias("_n"))
    days = (W.partitionBy(*by) if by else W.partitionBy(F.lit(0))).orderBy("session").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(days), F.lit(0))).drop("_n")
    return marked.join(before, [*by, "session"]).withColumn("segment_id", F.col("_before") + F.col("_island") - 1).drop("_start", "_island", "_before")


def causal_features(bars: DataFrame, window: int, by: list[str] = ()) -> DataFrame:
    """log_return, realized_volatility, range_fraction, session_vwap, vwap_distance, day_of_week; warm-ups are null."""
    if lacking := sorted({"t", "session", "segment_id", "open", "high", "low", "close", "volume", *by} - set(bars.columns)):
        raise ValueError(f"prepared bars lack {', '.join(lacking)}")
    if window < 2:
        raise ValueError("a volatility needs two returns or more")
    run = W.partitionBy(*by, "session", "segment_id").orderBy("t")
    last = run.rowsBetween(-(window - 1), 0)
    day = W.partitionBy(*by, "session").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    price = F.col("vwap") if "vwap" in bars.columns else (F.col("high") + F.col("low") + F.col("close")) / 3
    value = F.when(F.col("volume") == 0, F.lit(0.0)).otherwise(masked(price * F.col("volume")))
    out = bars.withColumns({"log_return": F.log(F.col("close") / F.lag("close").over(run)), "_value": value})
    volume = F.sum("volume").over(day)
    # an unknown price makes the rest of its session unknown
    vwap = F.when((F.max(F.when(F.col("_value").isNull(), 1).otherwise(0)).over(day) == 0) & (volume > 0), F.try_divide(F.sum("_value").over(day), volume))
    return (
        out.withColumns({
            "realized_volatility": F.when(F.count("log_return").over(last) == window, F.stddev_samp("log_return").over(last)),
            "range_fraction": (F.col("high") - F.col("low")) / F.col("close"),
            "session_vwap": vwap,
            "day_of_week": F.weekday("session"),
        })
        .withColumn("vwap_distance", (F.col("close") - F.col("session_vwap")) / F.col("close"))
        .drop("_value")
    )


def forward_labels(bars: DataFrame, horizon_bars: dict[int, int], by: list[str] = ()) -> DataFrame:
    """Adds return_{h}m and outcome_end_{h}m (epoch seconds) within the segment; null where unknown."""
    run = W.partitionBy(*by, "segment_id").orderBy("t")
    columns = {}
    for minutes, steps in horizon_bars.items():
        if minutes <= 0 or steps <= 0:
            raise ValueError("horizons are positive multiples of the bar")
        columns[f"return_{minutes}m"] = F.lead("close", steps).over(run) / F.col("close") - 1
        columns[f"outcome_end_{minutes}m"] = F.lead("t", steps).over(run)
    return bars.withColumns(columns)


def recent_return(bars: DataFrame, context_bars: int, by: list[str] = ()) -> DataFrame:
    """Adds the trailing return over the context's length, within the segment."""
    run = W.partitionBy(*by, "segment_id").orderBy("t")
    return bars.withColumn("recent_return", F.col("close") / F.lag("close", context_bars).over(run) - 1)


def contexts(rows: DataFrame, columns: list[str], size: int, by: list[str] = (), name: str = "context") -> DataFrame:
    """Adds a flat, time-major vector of the last ``size`` rows of a segment, and context_start; null unless all values are finite."""
    run = W.partitionBy(*by, "segment_id").orderBy("t").rowsBetween(-(size - 1), 0)
    whole = F.lit(True)
    for c in columns:
        whole = whole & finite(F.col(c))
    step = F.when(whole, F.array(*(F.col(c).cast("double") for c in columns)))
    return rows.withColumn("_steps", F.collect_list(step).over(run)).withColumns({
        name: F.when(F.size("_steps") == size, F.flatten("_steps")),
        "context_start": F.when(F.size("_steps") == size, F.min("t").over(run)),
    }).drop("_steps")

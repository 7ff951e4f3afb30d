"""Streaming extension: bars from late ticks, and the forward filter as keyed state.

``streaming_bars`` closes a bar once the watermark passes it.  ``streaming_filter``
keeps one small vector per (key, session) and emits the posterior of each bar as
it arrives; state of finished sessions times out by event time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, minutes: int, late: str = "10 minutes") -> DataFrame:
    """Bars of a stream with ts (timestamp) and value; ticks later than ``late`` are dropped by the watermark."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", f"{minutes} minutes"))
        .agg(
            F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
            F.count("*").cast("double").alias("volume"), F.avg("value").alias("vwap"),
        )
        .select(F.col("window.end").alias("timestamp"), "open", "high", "low", "close", "volume", "vwap")
    )


def filter_step(log_prior: np.ndarray | None, x: np.ndarray, model: dict) -> np.ndarray:
    """Log posterior after one observation; ``log_prior`` is the last log posterior, None at a sequence start."""
    from ..operators.hmm import _log_densities, logs

    density = _log_densities(x[None, :], np.asarray(model["means"], float), np.asarray(model["covariances"], float))[0]
    prior = logs(model["start"]) if log_prior is None else np.logaddexp.reduce(log_prior[:, None] + logs(model["transitions"]), axis=0)
    joint = prior + density
    return joint - np.logaddexp.reduce(joint)


FILTERED = "session string, t long, posterior array<double>"


def streaming_filter(rows: DataFrame, columns: list[str], model: dict, seconds: int) -> DataFrame:
    """Posteriors of a stream of bars (session string, ts, t, features), in time order within each batch and session.

    A gap other than ``seconds`` or a missing feature starts a new sequence.
    """

    def run(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        last_t, log_p = (state.get[0], np.array(state.get[1])) if state.exists else (None, None)
        out, frame = [], pd.concat(list(frames)).sort_values("t")
        for row in frame.itertuples(index=False):
            x = np.array([getattr(row, c) for c in columns], float)
            if not np.isfinite(x).all():
                last_t = log_p = None
                continue
            log_p = filter_step(log_p if last_t is not None and row.t - last_t == seconds else None, x, model)
            last_t = row.t
            out.append((key[0], int(row.t), np.exp(log_p).tolist()))
        if last_t is not None:
            state.update((int(last_t), log_p.tolist()))
            state.setTimeoutTimestamp(max(int(last_t) * 1000 + 86_400_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session", "t", "posterior"])

    return rows.groupBy("session").applyInPandasWithState(run, FILTERED, "last_t long, log_p array<double>", "append", "EventTimeTimeout")

"""Report and sinks of a run: series behind the plots as small tables, a self-contained HTML page, null-safe JSON."""

from __future__ import annotations

import html
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a table that a page shows.
NEIGHBORS_SHOWN, TRADES_SHOWN = 12, 30


def json_safe(value):
    """Non-finite numbers become null, dates become text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [json_safe(v) for v in value]
    return value.isoformat() if hasattr(value, "isoformat") else value


def write_json(value, path: Path) -> None:
    path.write_text(json.dumps(json_safe(value), indent=2, allow_nan=False) + "\n")


def error_series(table: DataFrame) -> DataFrame:
    return table.select("method", "horizon_minutes", "mae").orderBy("method", "horizon_minutes")


def calibration_series(table: DataFrame) -> DataFrame:
    return table.where("n_forecasts > 0").select("horizon_minutes", "method", "bin", "mean_probability_up", "observed_up_frequency").orderBy("horizon_minutes", "method", "bin")


def sensitivity_series(table: DataFrame) -> DataFrame:
    return table.where("fold = 0").select("horizon_minutes", "method", "embargo_sessions", "mae").orderBy("horizon_minutes", "method", "embargo_sessions")


def histogram(values: DataFrame, column: str, bins: int = 15, by: str = "method") -> DataFrame:
    """(by, bin, lower, upper, density) over edges common to all groups."""
    limits = values.agg(F.min(column).alias("_a"), F.max(column).alias("_b"))  # one row
    placed = values.join(F.broadcast(limits)).withColumn("_w", F.when(F.col("_b") > F.col("_a"), (F.col("_b") - F.col("_a")) / bins).otherwise(F.lit(1.0)))
    placed = placed.withColumn("bin", F.least(F.floor((F.col(column) - F.col("_a")) / F.col("_w")), F.lit(bins - 1)).cast("int"))
    counts = placed.groupBy(by, "bin").agg(F.count("*").alias("n"), F.first("_a").alias("_a"), F.first("_w").alias("_w"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("_t"))
    return counts.join(totals, by).select(by, "bin", (F.col("_a") + F.col("bin") * F.col("_w")).alias("lower"), (F.col("_a") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density"))


def query_coverage(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("q_session").agg(F.count_distinct("q_t").alias("queries"), F.min("q_t").alias("first_t"), F.max("q_t").alias("last_t"))


def spread_picks(examples: DataFrame) -> DataFrame:
    """First, middle and last refit that has examples."""
    from pyspark.sql import Window as W

    refits = examples.select("refit_id").distinct()
    order, whole = W.partitionBy(F.lit(0)).orderBy("refit_id"), W.partitionBy(F.lit(0))  # one row per refit
    marked = refits.withColumns({"_k": F.row_number().over(order) - 1, "_n": F.count("*").over(whole)})
    return examples.join(marked.where("_k in (0, _n div 2, _n - 1)").select("refit_id"), "refit_id", "left_semi")


def state_tables(models: DataFrame) -> dict[str, DataFrame]:
    """Means, transitions and start probabilities of accepted models in long form."""
    good = models.where("status = 'accepted'")
    return {
        "means": good.select("refit_id", F.posexplode("means").alias("state", "m")).select("refit_id", "state", F.posexplode("m").alias("feature", "mean")),
        "transitions": good.select("refit_id", F.posexplode("transitions").alias("state", "r")).select("refit_id", "state", F.posexplode("r").alias("to", "probability")),
        "start": good.select("refit_id", F.posexplode("start").alias("state", "probability")),
    }


def _cell(value) -> str:
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "&mdash;"
    return html.escape(f"{value:.6g}" if isinstance(value, float) else str(value))


def html_table(title: str, table: DataFrame, most: int) -> str:
    rows = table.limit(most).collect()  # bounded: a page shows so many
    head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(v)}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def render(title: str, tables: dict[str, tuple[DataFrame, int]], notes: list[str] = ()) -> str:
    """One page without outside resources."""
    parts = [f"<p>{html.escape(n)}</p>" for n in notes] + [html_table(name, table, most) for name, (table, most) in tables.items()]
    style = "body{font-family:sans-serif;margin:2em}td,th{padding:2px 8px;border-bottom:1px solid #ddd;text-align:right}"
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{''.join(parts)}</body></html>"

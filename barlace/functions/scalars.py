"""Scalar and vector expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widest vectors whose terms are written out; the compiled method of wider ones would be too long to be optimised.
MOST_UNROLLED = 72
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def masked(x: Column) -> Column:
    """Null in place of a missing marker (NaN, infinity)."""
    return F.when(finite(x), x)


def epoch_seconds(ts: str) -> Column:
    """Seconds since 1970 of a zone-free timestamp, whatever the session's zone."""
    return F.expr(f"timestampdiff(SECOND, {EPOCH}, `{ts}`)")


def from_epoch(seconds: str) -> Column:
    return F.expr(f"timestampadd(SECOND, {seconds}, {EPOCH})")


def refit_key(date: Column, frequency: str) -> Column:
    """Block key of a session date: day, ISO week or month."""
    if frequency == "daily":
        return F.date_format(date, "yyyy-MM-dd")
    if frequency == "monthly":
        return F.date_format(date, "yyyy-MM")
    if frequency != "weekly":
        raise ValueError("refit frequency is daily, weekly or monthly")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def nudge(digits: int) -> float:
    """Offset that keeps decimal ties, which prices often make, away from the last bits of a sum."""
    return 1.7 * 10.0 ** -(digits + 2)


def rounded(x: Column, digits: int = 8) -> Column:
    """Rounded, the same for any order of summation, without negative zero."""
    return F.round(x + F.lit(nudge(digits)), digits) + F.lit(0.0)


def _sum(a: Column, b: Column, term, width: int | None) -> Column:
    """Sum of a term over two vectors: one generated expression for a known width, a fold else."""
    if width is None or width > MOST_UNROLLED:
        return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)
    return reduce(lambda s, x: s + x, (term(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(width)), F.lit(0.0))


def dot(a: Column, b: Column, width: int | None = None) -> Column:
    return _sum(a, b, lambda x, y: x * y, width)


def euclidean(a: Column, b: Column, width: int | None = None) -> Column:
    return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y), width))


def cosine(a: Column, b: Column, width: int | None = None) -> Column:
    """1 - similarity; 1 if one vector is zero, 0 if both are; similarity is clipped to [-1, 1]."""
    na, nb = F.sqrt(dot(a, a, width)), F.sqrt(dot(b, b, width))
    similarity = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(a, b, width), na * nb)))
    return F.when((na == 0) & (nb == 0), F.lit(0.0)).when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1 - similarity)


DISTANCES = {"euclidean": euclidean, "cosine": cosine}


def momentum(recent: Column, horizon_bars: int, context_bars: int) -> Column:
    """Trailing log return, scaled to the horizon."""
    return F.expm1(F.log1p(recent) * horizon_bars / context_bars)


def hard_sign(recent: Column) -> Column:
    """1, one half or 0 by the sign."""
    return F.when(recent > 0, F.lit(1.0)).when(recent < 0, F.lit(0.0)).otherwise(F.lit(0.5))


def log_loss(p: Column, up: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -F.when(up, F.log(q)).otherwise(F.log1p(-q))


def log_sum_exp(values: Column) -> Column:
    """ln(sum(exp(x))) of an array."""
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))

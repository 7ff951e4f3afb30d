"""Training-only seasonality and scaling, for all refits at once.

``panel`` rows carry refit_id and ``is_train``; every statistic is a grouped
aggregate of the training rows by refit, and is joined back by refit (and slot).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import masked

EPS = 2.220446049250313e-16
MAD_SCALE = 1.4826


def volume_statistics(panel: DataFrame, key: str = "refit_id") -> DataFrame:
    """(refit, minute_of_session, median, mad, scale) of finite training volumes."""
    train = panel.where("is_train").select(key, "minute_of_session", masked(F.col("volume")).alias("volume")).where("volume is not null")
    medians = train.groupBy(key, "minute_of_session").agg(F.median("volume").alias("slot_median"))
    spread = train.join(medians, [key, "minute_of_session"]).groupBy(key, "minute_of_session").agg(
        F.first("slot_median").alias("slot_median"), F.median(F.abs(F.col("volume") - F.col("slot_median"))).alias("slot_mad")
    )
    scale = F.when(F.col("slot_mad") > 0, MAD_SCALE * F.col("slot_mad")).otherwise(F.greatest(F.abs("slot_median"), F.lit(1.0)))
    return spread.withColumn("slot_scale", scale)


def with_surprise(panel: DataFrame, statistics: DataFrame, key: str = "refit_id") -> DataFrame:
    """Adds volume_surprise; null for unseen slots."""
    joined = panel.join(statistics.select(key, "minute_of_session", "slot_median", "slot_scale"), [key, "minute_of_session"], "left")
    return joined.withColumn("volume_surprise", (masked(F.col("volume")) - F.col("slot_median")) / F.col("slot_scale")).drop("slot_median", "slot_scale")


def scaler_statistics(panel: DataFrame, columns: list[str], key: str = "refit_id") -> DataFrame:
    """(refit, feature, mean, scale) in long form, over finite training values, population deviation."""
    train = panel.where("is_train").select(key, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), masked(F.col(c)))))).alias("feature", "value"))
    return (
        train.groupBy(key, "feature")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n"))
        .withColumn("scale", F.when(F.col("std") > EPS * F.greatest(F.abs("mean"), F.lit(1.0)), F.col("std")).otherwise(F.lit(1.0)))
    )


def standardized(panel: DataFrame, statistics: DataFrame, columns: list[str], key: str = "refit_id") -> DataFrame:
    """Features in standard units under their own names, what they were under raw_<name>."""
    wide = statistics.groupBy(key).agg(
        *(F.max(F.when(F.col("feature") == c, F.col(x))).alias(f"_{x}_{c}") for c in columns for x in ("mean", "scale"))
    )
    out = panel.join(wide, key).withColumns({f"raw_{c}": F.col(c) for c in columns})
    out = out.withColumns({c: (masked(F.col(c)) - F.col(f"_mean_{c}")) / F.col(f"_scale_{c}") for c in columns})
    return out.drop(*(f"_{x}_{c}" for c in columns for x in ("mean", "scale")))


def unfitted_features(statistics: DataFrame) -> DataFrame:
    """Features without a finite training value, which a fit refuses."""
    return statistics.where("n = 0").select("refit_id", "feature")

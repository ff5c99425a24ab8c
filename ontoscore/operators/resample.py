"""Cluster bootstrap whose draws are rows: intervals, ranks and superiority for all groups at once.

A draw is a weight for each family: as many slots as there are families, each filled by a hash of seed, draw and slot. Draws are joined
with the families' values and averaged, so draws, groups and families are dealt to tasks; the same draws hold for all groups, which
keeps models comparable. Nothing depends on a generator's state or on the partitioning.
"""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DRAWS, SEED = 5000, 202604


def weights(families: DataFrame, family: str, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """draw (from 0), family, weight (how often the draw holds it; families that it lacks have no row). Families are numbered by id."""
    known = families.select(family).where(F.col(family).isNotNull()).distinct()
    n = known.count()
    # a registry of families, a row each
    numbered = known.withColumn("slot", F.row_number().over(Window.orderBy(family)) - 1)
    slots = families.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("s"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), "draw", "s").cast("binary"))
    slots = slots.withColumn("slot", F.conv(F.substring(digest, 1, 7), 16, 10).cast("long") % max(n, 1))
    return slots.groupBy("draw", "slot").agg(F.count("*").alias("weight")).join(numbered, "slot").select("draw", family, "weight")


def family_values(rows: DataFrame, by: list[str], family: str, value: str) -> DataFrame:
    """by, family, x: the mean of each group in each family; null values and families don't count."""
    return rows.where(F.col(family).isNotNull()).groupBy(*by, family).agg(F.avg(F.col(value).cast("double")).alias("x")).where("x is not null")


def draw_means(values: DataFrame, by: list[str], family: str, draws: int = DRAWS, seed: int = SEED, digits: int = 9) -> DataFrame:
    """draw, by, mean: each group's mean over the families of each draw; a draw without any of a group's families has no row for it.

    values: family_values(). Means are rounded, so that equal ones are equal whatever the order of their sums.
    """
    x = weights(values, family, draws, seed).join(values, family)
    means = x.groupBy("draw", *by).agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("mean"))
    return means.withColumn("mean", F.round("mean", digits) + F.lit(0.0))


def _at(share: Column) -> Column:
    """The quantile of the group's sorted means at a share, by linear interpolation."""
    place = share * (F.col("_m") - 1)
    low = F.floor(place)
    return F.max(F.when(F.col("_rank") == low, F.col("mean") * (1 - (place - low)))) + F.coalesce(F.max(F.when(F.col("_rank") == low + 1, F.col("mean") * (place - low))), F.lit(0.0))


def intervals(values: DataFrame, by: list[str], family: str, draws: int = DRAWS, seed: int = SEED, alpha: float = 0.05, adjusted: bool = False) -> DataFrame:
    """by, families, estimate, lower, upper, share_below, acceleration of each group's mean over families.

    adjusted: the bias-corrected and accelerated interval, else the percentile one. share_below is the share of draws whose mean is below
    the estimate, kept off 0 and 1 by half a draw. The acceleration is that of the jackknife: leaving out x moves the mean by
    (x - mean) / (n - 1), so its cubes and squares are the group's third and second moment, and the acceleration is
    skewness / (6 * sqrt(n)), from one pass over the group.
    """
    skew = F.when(F.stddev_pop("x") > 0, F.skewness("x"))
    est = values.groupBy(*by).agg(F.count("*").alias("families"), (F.round(F.avg("x"), 9) + F.lit(0.0)).alias("estimate"), (F.coalesce(skew, F.lit(0.0)) / (F.lit(6.0) * F.sqrt(F.count("*")))).alias("acceleration"))
    w = Window.partitionBy(*by)
    means = draw_means(values, by, family, draws, seed).join(est, by)
    means = means.withColumns({"_rank": F.row_number().over(w.orderBy("mean", "draw")) - 1, "_m": F.count("*").over(w), "_below": F.count_if(F.col("mean") < F.col("estimate")).over(w)})
    half = F.lit(0.5) / F.col("_m")
    means = means.withColumn("share_below", F.greatest(half, F.least(F.lit(1.0) - half, F.col("_below") / F.col("_m"))))
    if adjusted:
        groups = means.groupBy(*by).agg(F.first("share_below").alias("share_below"), F.first("acceleration").alias("acceleration"))
        groups = groups.select(*by, _moved(alpha / 2)("share_below", "acceleration").alias("_low"), _moved(1 - alpha / 2)("share_below", "acceleration").alias("_high"))
        means = means.join(groups, by)
    else:
        means = means.withColumns({"_low": F.lit(alpha / 2), "_high": F.lit(1 - alpha / 2)})
    return means.groupBy(*by, "families", "estimate", "share_below", "acceleration").agg(_at(F.col("_low")).alias("lower"), _at(F.col("_high")).alias("upper"))


def _moved(share: float):
    """The share at which the sorted means are read in place of `share`; a value for each group."""

    @F.pandas_udf("double")
    def moved(below: pd.Series, acceleration: pd.Series) -> pd.Series:
        normal = NormalDist()
        z = normal.inv_cdf(share)

        def one(b: float, a: float) -> float:
            z0 = normal.inv_cdf(b)
            return normal.cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))

        return pd.Series([one(b, a) for b, a in zip(below, acceleration, strict=True)], dtype=float)

    return moved


def rank_shares(means: DataFrame, model: str, by: list[str]) -> DataFrame:
    """by, model, rank (1 is the largest mean), draws, share of the draws in which the model has the rank. Equal means go by the model's id."""
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy("draw", *by).orderBy(F.desc("mean"), model)))
    counts = ranked.groupBy(*by, model, "rank").agg(F.count("*").alias("draws"))
    return counts.withColumn("share", F.col("draws") / F.sum("draws").over(Window.partitionBy(*by, model)))


def superiority(means: DataFrame, model: str, by: list[str]) -> DataFrame:
    """by, better, worse, draws, share of the draws in which the first model's mean exceeds the second's. Models are few; draws are the rows."""
    x = means.select("draw", *by, F.col(model).alias("better"), F.col("mean").alias("x"))
    y = means.select("draw", *by, F.col(model).alias("worse"), F.col("mean").alias("y"))
    pairs = x.join(y, ["draw", *by]).where("better <> worse")
    return pairs.groupBy(*by, "better", "worse").agg(F.count("*").alias("draws"), (F.count_if(F.col("x") > F.col("y")) / F.count("*")).alias("share"))

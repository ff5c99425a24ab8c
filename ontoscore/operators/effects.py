"""Matched contrasts between prompt variants, states, sensitivity grids, intervals and attempts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontoscore.fixed import CELL_DIMENSIONS, STATES, VARIANTS, K

#: Doubles of the sensitivity grid, as arange(0.2, 0.61, 0.05) makes them.
THRESHOLDS = [float(x) for x in np.arange(0.20, 0.61, 0.05)]
LAMBDAS = [float(x) for x in np.arange(0, 3.01, 0.25)]
SUFFICIENT = 0.80


def metric_cells(metrics: DataFrame, index: DataFrame, dimensions: list[str] = CELL_DIMENSIONS) -> DataFrame:
    """Mean of each dimension by model, family, source and variant. index: the triple, model_snapshot_id, item_family_id, prompt_variant."""
    rows = metrics.join(index.select(*K, "model_snapshot_id", "item_family_id", "prompt_variant"), K)
    rows = rows.select("model_snapshot_id", "item_family_id", "extraction_source", "source_identifier", "prompt_variant", *[F.col(d).cast("int").cast("double").alias(d) if dict(rows.dtypes)[d] == "boolean" else F.col(d).cast("double").alias(d) for d in dimensions])
    keys = ["model_snapshot_id", "item_family_id", "extraction_source", "source_identifier", "prompt_variant"]
    # means first, then unpivot: the exchange carries one row per cell and task
    return rows.groupBy(*keys).agg(*[F.avg(d).alias(d) for d in dimensions]).unpivot(keys, dimensions, "dimension", "value")


def matched_deltas(cells: DataFrame, by_source: bool = True) -> DataFrame:
    """B and C less A by cell; a missing variant gives null."""
    keys = ["model_snapshot_id", "item_family_id", *(["extraction_source", "source_identifier"] if by_source else []), "dimension"]
    means = cells.groupBy(*keys).pivot("prompt_variant", VARIANTS).agg(F.avg("value"))
    return means.withColumns({"delta_explicit_minus_neutral": F.col("B_explicit") - F.col("A_neutral"), "delta_control_minus_neutral": F.col("C_hm_control") - F.col("A_neutral")})


def variant_deltas(metrics: DataFrame, dimension: str) -> DataFrame:
    """The deltas of one dimension by model and family, over all sources. Raises if a variant occurs nowhere."""
    if missing := {"model_snapshot_id", "item_family_id", "prompt_variant", "repetition_index", dimension} - set(metrics.columns):
        raise ValueError(f"delta input missing {sorted(missing)}")
    present = {r[0] for r in metrics.where(F.col("prompt_variant").isin(VARIANTS)).select("prompt_variant").distinct().collect()}  # three at most
    for v in VARIANTS:
        if v not in present:
            raise ValueError(f"missing matched variant {v}")
    value = F.col(dimension).cast("double")
    means = metrics.groupBy("model_snapshot_id", "item_family_id").pivot("prompt_variant", VARIANTS).agg(F.avg(value))
    return means.withColumns({"delta_explicit_minus_neutral": F.col("B_explicit") - F.col("A_neutral"), "delta_control_minus_neutral": F.col("C_hm_control") - F.col("A_neutral")})


def strategy_transitions(metrics: DataFrame, index: DataFrame) -> DataFrame:
    """The sorted distinct strategies by variant; nulls are left out, no observation gives an empty list."""
    rows = metrics.join(index.select(*K, "model_snapshot_id", "item_family_id", "prompt_variant"), K)
    pick = lambda v: F.array_sort(F.collect_set(F.when(F.col("prompt_variant") == v, F.col("strategy"))))
    return rows.groupBy("model_snapshot_id", "item_family_id", "extraction_source", "source_identifier").agg(*[pick(v).alias(f"{v[0]}_strategy") for v in VARIANTS])


def state(r: Column, liberal: Column, q: Column, ra: Column, la: Column, t_r: Column, t_l: Column) -> Column:
    """The first state whose condition holds; an unknown value fulfils none."""
    enough = F.coalesce((ra >= F.lit(SUFFICIENT)) & (la >= F.lit(SUFFICIENT)), F.lit(False))
    true = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(~enough, STATES[0])
        .when(true((r >= t_r) & (q == 0)), STATES[1])
        .when(true((r < t_r) & (liberal >= t_l)), STATES[2])
        .when(true((r < t_r) & (liberal < t_l)), STATES[3])
        .when(true((r >= t_r) & (q == 1)), STATES[4])
        .otherwise(STATES[5])
    )


def check_thresholds(t_r: float, t_l: float, lam: float) -> None:
    if not (0 <= t_r <= 1 and 0 <= t_l <= 1 and 0 <= lam <= 3):
        raise ValueError("thresholds must be in [0,1], lambda in [0,3]")


def add_states(metrics: DataFrame, t_r: float, t_l: float, lam: float) -> DataFrame:
    check_thresholds(t_r, t_l, lam)
    c = [F.col(x) for x in ("recognition_score", "liberal_score", "recuperative_closure_score", "recognition_assessability", "liberal_assessability")]
    return metrics.withColumns({"measurement_state": state(*c, F.lit(float(t_r)), F.lit(float(t_l))), "secondary_composite": c[0] * F.exp(F.lit(-float(lam)) * c[2])})


def threshold_sensitivity(metrics: DataFrame, thresholds: list[float] = THRESHOLDS, lambdas: list[float] = LAMBDAS) -> DataFrame:
    """Mean composite and share of each state on the grid. t_r, t_l, lambda, mean_composite, state_distribution (map).

    Responses are first reduced to the distinct values that matter, with their number: coverage scores are ratios of small counts, so
    these stay few however many responses there are, and only they meet the grid.
    """
    for t in thresholds:
        check_thresholds(t, t, 0)
    columns = ["recognition_score", "liberal_score", "recuperative_closure_score", "recognition_assessability", "liberal_assessability"]
    few = metrics.groupBy(*columns).agg(F.count("*").alias("w"))
    c = [F.col(x) for x in columns]
    grid = lambda values, name: F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)
    at = few.select("*", grid(thresholds, "t_r")).select("*", grid(thresholds, "t_l"))
    states = at.withColumn("measurement_state", state(*c, F.col("t_r"), F.col("t_l"))).groupBy("t_r", "t_l", "measurement_state").agg(F.sum("w").alias("w"))
    shares = states.groupBy("t_r", "t_l").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("measurement_state", "w")))).alias("m"), F.sum("w").alias("all"))
    shares = shares.select("t_r", "t_l", F.transform_values("m", lambda _, w: w.cast("double") / F.col("all")).alias("state_distribution"))
    composite = few.select("*", grid(lambdas, "lambda")).withColumn("x", c[0] * F.exp(-F.col("lambda") * c[2]))
    means = composite.groupBy("lambda").agg((F.sum(F.col("x") * F.col("w")) / F.nullif(F.sum(F.when(F.col("x").isNotNull(), F.col("w"))), F.lit(0))).alias("mean_composite"))
    # the two halves of the grid are parameters, a few dozen rows each
    return shares.crossJoin(F.broadcast(means))


def family_bootstrap(deltas: DataFrame, value: str, draws: int = 5000, seed: int = 202604, alpha: float = 0.05, at_least: int = 2) -> DataFrame:
    """Percentile interval of the mean over families, resampled whole: estimate, lower, upper, families, draws, seed.

    There is one value for each family, so one task holds them; families are ordered by id.
    """
    if missing := {"item_family_id", value} - set(deltas.columns):
        raise ValueError(f"bootstrap input missing {sorted(missing)}")
    means = deltas.groupBy("item_family_id").agg(F.avg(F.col(value).cast("double")).alias("x")).where("x is not null")

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("item_family_id")["x"].to_numpy()
        if len(x) < at_least:
            raise ValueError("at least two assessable item families required")
        rng = np.random.default_rng(seed)
        sims = x[rng.integers(0, len(x), (draws, len(x)))].mean(axis=1)
        return pd.DataFrame({"estimate": [x.mean()], "lower": [np.quantile(sims, alpha / 2)], "upper": [np.quantile(sims, 1 - alpha / 2)], "families": [len(x)], "draws": [draws], "seed": [seed]})

    return means.groupBy(F.lit(1).alias("one")).applyInPandas(work, "estimate double, lower double, upper double, families long, draws long, seed long")


def family_means(deltas: DataFrame, value: str) -> DataFrame:
    return deltas.groupBy("item_family_id").agg(F.avg(value).alias(value)).where(F.col(value).isNotNull())


def first_success(attempts: DataFrame) -> DataFrame:
    """The successful attempt of the lowest index of each logical run; two-phase aggregation, no sort of all attempts."""
    columns = [c for c in attempts.columns if c != "logical_run_id"]
    best = F.min_by(F.struct(*columns), F.struct("attempt_index", *[c for c in ("event_id",) if c in columns]))
    return attempts.where("status = 'succeeded'").groupBy("logical_run_id").agg(best.alias("b")).select("logical_run_id", "b.*")


def shuffled_cells(cells: DataFrame, seed: int, key: str, partition: str) -> DataFrame:
    """A random order that depends on the seed alone: order_index within each partition."""
    digest = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")).cast("binary"))
    return cells.withColumn("order_index", F.row_number().over(Window.partitionBy(partition).orderBy(digest, key)) - 1)


def stage_deltas(means: DataFrame, order: dict[str, int]) -> DataFrame:
    """value less that of the stage before, by lineage and dimension."""
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    w = Window.partitionBy("lineage", "dimension").orderBy("stage_order")
    return means.withColumn("stage_order", rank[F.col("stage")]).withColumn("delta", F.col("value") - F.lag("value").over(w))

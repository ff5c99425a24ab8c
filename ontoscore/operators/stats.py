"""Statistics of validation and reporting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Z95 = 1.959963984540054


def _d(c: Column) -> Column:
    return c.cast("double")


def precision_recall(labels: DataFrame, by: list[str], gold: str, judged: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of boolean columns by group; null where nothing can be said."""
    g, j = F.col(gold), F.col(judged)
    counts = labels.groupBy(*by).agg(F.count_if(g & j).alias("tp"), F.count_if(~g & j).alias("fp"), F.count_if(g & ~j).alias("fn"), F.count_if(~g & ~j).alias("tn"))
    part = lambda a, *b: _d(F.col(a)) / F.nullif(_d(sum((F.col(x) for x in b), F.col(a))), F.lit(0.0))
    f1 = 2.0 * F.col("tp") / F.nullif(_d(2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn"), "f1": f1})


def krippendorff_nominal(ratings: DataFrame, unit: str, value: str, by: list[str]) -> DataFrame:
    """Nominal alpha by group. Units with one rating don't count. Values of a unit are counted first, so no pairs are made."""
    cells = ratings.where(F.col(value).isNotNull()).groupBy(*by, unit, value).agg(F.count("*").alias("n"))
    sizes = F.sum("n").over(Window.partitionBy(*by, unit))
    cells = cells.withColumn("m", sizes).where("m > 1")
    agree = cells.groupBy(*by).agg(F.sum(_d(F.col("n") * (F.col("n") - 1)) / (F.col("m") - 1)).alias("same"), F.sum("n").alias("total"))
    margins = cells.groupBy(*by, value).agg(F.sum("n").alias("nv")).groupBy(*by).agg(F.sum(_d(F.col("nv") * (F.col("nv") - 1))).alias("expected"))
    x = agree.join(margins, by) if by else agree.crossJoin(margins)
    observed = 1.0 - F.col("same") / F.col("total")
    chance = 1.0 - F.col("expected") / _d(F.col("total") * (F.col("total") - 1))
    return x.select(*by, F.col("total").alias("n_pairable"), F.when(chance == 0, F.lit(None).cast("double")).otherwise(1.0 - observed / chance).alias("alpha"))


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper bound of a share."""
    p, m = _d(k) / F.nullif(_d(n), F.lit(0.0)), _d(n)
    centre = p + z * z / (2.0 * m)
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / m + z * z / (4.0 * m * m))
    return (centre - half) / (1.0 + z * z / m), (centre + half) / (1.0 + z * z / m)


def calibration(labels: DataFrame, confidence: str, correct: str) -> DataFrame:
    return labels.groupBy(confidence).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int").cast("double")).alias("share_correct"))


def adjust(tests: DataFrame, p: str, by: list[str]) -> DataFrame:
    """tests with rank, bh (Benjamini-Hochberg) and holm within each family of tests."""
    up = Window.partitionBy(*by).orderBy(F.col(p), *[c for c in tests.columns if c not in (*by, p)])
    ranked = tests.withColumn("rank", F.row_number().over(up)).withColumn("m", F.count("*").over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    grown = Window.partitionBy(*by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    bh = F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(down))
    holm = F.least(F.lit(1.0), F.max(F.col(p) * (F.col("m") - F.col("rank") + 1)).over(grown))
    return ranked.withColumns({"bh": bh, "holm": holm}).drop("m")


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns: x, y, r."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = wide.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def completion(runs: DataFrame, reps: int = 5) -> DataFrame:
    """By model: whether nine tenths of the families have four fifths of their repetitions. runs: model_snapshot_id, item_family_id, prompt_variant, n."""
    whole = runs.groupBy("model_snapshot_id", "item_family_id").agg(F.min(F.col("n") >= 0.8 * reps).alias("good"))
    out = whole.groupBy("model_snapshot_id").agg(F.count("*").alias("families"), F.count_if("good").alias("complete_families"))
    share = _d(F.col("complete_families")) / F.col("families")
    label = F.when(F.col("complete_families") < 3, "descriptive only").when(F.col("complete_families") < 16, "exploratory").otherwise("confirmatory")
    return out.withColumns({"complete": share >= 0.9, "label": label})


def partition_of(cluster: Column, shares: tuple[int, int, int] = (30, 30, 40)) -> Column:
    """Development, calibration or test by a hash of the cluster, so a cluster is never parted."""
    b = F.conv(F.substring(F.md5(cluster.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 100
    return F.when(b < shares[0], "development").when(b < shares[0] + shares[1], "calibration").otherwise("test")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def cluster_power(effect: float, families: int, reps: int = 5, sd_family: float = 0.24, sd_rep: float = 0.2, draws: int = 20000, seed: int = 20260401, critical: float = 2.069) -> dict[str, float]:
    """Share of simulated studies that find the effect, and the median half-width of their intervals."""
    rng = np.random.default_rng(seed)
    x = effect + rng.normal(0, sd_family, (draws, families)) + rng.normal(0, sd_rep / np.sqrt(reps), (draws, families))
    error = x.std(axis=1, ddof=1) / np.sqrt(families)
    return {"power": float((np.abs(x.mean(axis=1)) > critical * error).mean()), "half_width": float(np.median(critical * error))}


def discriminant_panel(scores: DataFrame) -> DataFrame:
    """scores: response_id, recognition, neoclassical, institutionalist. Whether recognition stays below both comparators, and the means."""
    below = (F.col("recognition") < F.col("neoclassical")) & (F.col("recognition") < F.col("institutionalist"))
    return scores.agg(F.count("*").alias("n"), F.count_if(below).alias("n_below"), *[F.avg(c).alias(c) for c in ("recognition", "neoclassical", "institutionalist")])


def ranks(means: DataFrame, model: str, value: str, by: list[str]) -> DataFrame:
    """Rank of each model within a replicate (1 is the largest value), and how often each model has each rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), model)
    ranked = means.withColumn("rank", F.row_number().over(w))
    return ranked.groupBy(model, "rank").agg(F.count("*").alias("n"))


def superiority(means: DataFrame, model: str, value: str, by: list[str]) -> DataFrame:
    """Share of replicates in which one model's value exceeds another's; models are few, replicates are the rows."""
    a = means.select(*by, F.col(model).alias("better"), F.col(value).alias("x"))
    b = means.select(*by, F.col(model).alias("worse"), F.col(value).alias("y"))
    pairs = a.join(b, by).where("better <> worse")
    return pairs.groupBy("better", "worse").agg(F.count("*").alias("n"), (F.count_if(F.col("x") > F.col("y")).cast("double") / F.count("*")).alias("share"))


def averages(labels: DataFrame, unit: str, gold: str, judged: str, by: list[str]) -> DataFrame:
    """Agreement on all levels in one aggregation: by, totalled (the columns of `by` that a row runs over), unit, average, tp, fp, fn, precision, recall, f1.

    average: 'unit' for one unit's own figures, 'micro' for those of the pooled counts, 'macro' for the plain mean of the units' figures
    (figures that a unit lacks don't count; no counts). totalled names columns in order, joined by commas, '' where none is.
    """
    g, j = F.col(gold), F.col(judged)
    flags = [F.grouping(c).alias(f"_over_{i}") for i, c in enumerate([*by, unit])]
    cells = labels.cube(*by, unit).agg(F.count_if(g & j).alias("tp"), F.count_if(~g & j).alias("fp"), F.count_if(g & ~j).alias("fn"), *flags)
    share = lambda a, b: _d(a) / F.nullif(_d(a + b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    cells = cells.withColumns({"precision": share(tp, fp), "recall": share(tp, fn), "f1": share(2 * tp, fp + fn)})
    over = [f"_over_{i}" for i in range(len(by))]
    totalled = F.array_join(F.array_compact(F.array(*[F.when(F.col(o) == 1, F.lit(c)) for o, c in zip(over, by, strict=True)])), ",").alias("totalled") if by else F.lit("").alias("totalled")
    kind = F.when(F.col(f"_over_{len(by)}") == 1, "micro").otherwise("unit").alias("average")
    figures = ["tp", "fp", "fn", "precision", "recall", "f1"]
    macro = cells.where(F.col(f"_over_{len(by)}") == 0).groupBy(*by, *over).agg(*[F.avg(c).alias(c) for c in figures[3:]])
    none = F.lit(None).cast("long")
    macro = macro.select(*by, totalled, F.lit(None).cast(labels.schema[unit].dataType).alias(unit), F.lit("macro").alias("average"), *[none.alias(c) for c in figures[:3]], *figures[3:])
    return cells.select(*by, totalled, unit, kind, *figures).union(macro)


def gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every two of many columns over the rows that have both, in one pass: x, y (places, x < y), n, r.

    A task sums the outer products of its rows (numbers of pairs, sums, squares, products) and hands on one row; those are summed place
    by place in a tree. r is null for fewer than two rows or without variance.
    """
    p = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q, c = (np.zeros((p, p)) for _ in range(4))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])
            there = np.isfinite(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            n += there.T @ there
            s += x.T @ there
            q += (x * x).T @ there
            c += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([m.ravel().tolist()], pa.list_(pa.float64())) for m in (n, s, q, c)], names=["n", "s", "q", "c"])

    wide = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = wide.mapInArrow(run, "n array<double>, s array<double>, q array<double>, c array<double>")
    cells = parts.select(F.posexplode(F.arrays_zip("n", "s", "q", "c")).alias("at", "m")).groupBy("at").agg(*[F.sum(f"m.{k}").alias(k) for k in ("n", "s", "q", "c")])
    cells = cells.withColumns({"x": F.floor(F.col("at") / p).cast("int"), "y": (F.col("at") % p).cast("int")})
    # of the other column of a pair, sums stand at the mirrored place
    both = cells.where("x < y").join(cells.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("s").alias("t"), F.col("q").alias("u")), ["x", "y"])
    n, spread = F.col("n"), lambda s, q: F.greatest(F.lit(0.0), F.col("n") * F.col(q) - F.col(s) * F.col(s))
    least = F.lit(1e-12) * n * n
    sound_ = (n > 1) & (spread("s", "q") > least) & (spread("t", "u") > least)
    r = (n * F.col("c") - F.col("s") * F.col("t")) / F.sqrt(spread("s", "q") * spread("t", "u"))
    return both.select("x", "y", n.cast("long").alias("n"), F.when(sound_, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def traits_by_methods(scores: DataFrame, unit: str, method: str, methods: list[str], traits: list[str]) -> DataFrame:
    """The multi-trait multi-method matrix: x_trait, x_method, y_trait, y_method, kind, n, r for each two of traits times methods.

    kind: 'reliability' (one trait by two methods), 'traits' (two traits by one method) or 'both differ'. A unit's score by a method is
    its first that is not null.
    """
    columns = [(t, m) for m in methods for t in traits]
    wide = scores.groupBy(unit).agg(*[F.first(F.when(F.col(method) == m, F.col(t)), ignorenulls=True).alias(f"c{i}") for i, (t, m) in enumerate(columns)])
    names = F.array(*[F.struct(F.lit(t).alias("trait"), F.lit(m).alias("method")) for t, m in columns])
    x, y = names[F.col("x")], names[F.col("y")]
    kind = F.when(x["trait"] == y["trait"], "reliability").when(x["method"] == y["method"], "traits").otherwise("both differ")
    found = gram(wide, [f"c{i}" for i in range(len(columns))])
    return found.select(x["trait"].alias("x_trait"), x["method"].alias("x_method"), y["trait"].alias("y_trait"), y["method"].alias("y_method"), kind.alias("kind"), "n", "r")


def robustness_levels(counts: DataFrame, minima: list[float], axes: list[str]) -> DataFrame:
    """Mean gated score by dimension and minimum assessability, for each subset of axes (sources, strata) at once: feature_group,
    opportunity_class, minimum, axes (null where totalled), totalled (as in averages()), n_scored, mean_score.

    counts: dimension_counts() with the axes; an axis that is null is a value of its own, told by `totalled`.
    """
    planned, assessable = _d(F.col("planned_n")), _d(F.col("assessable_n"))
    each = counts.withColumn("minimum", F.explode(F.array(*[F.lit(float(m)) for m in minima])))
    value = F.when(assessable / planned >= F.col("minimum"), _d(F.col("true_n")) / F.nullif(assessable, F.lit(0.0)))
    fixed = ["feature_group", "opportunity_class", "minimum"]
    subsets = [[F.col(a) for k, a in enumerate(axes) if bits >> k & 1] for bits in range(1 << len(axes))]
    each = each.withColumn("value", value)
    sets = [[*map(F.col, fixed), *s] for s in subsets]
    flags = [F.grouping(a).alias(f"_over_{i}") for i, a in enumerate(axes)]
    out = each.groupingSets(sets, *fixed, *axes).agg(F.count("value").alias("n_scored"), F.avg("value").alias("mean_score"), *flags)
    totalled = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_over_{i}") == 1, F.lit(a)) for i, a in enumerate(axes)])), ",")
    return out.select(*fixed, *axes, totalled.alias("totalled"), "n_scored", "mean_score")


def robustness(counts: DataFrame, minima: list[float]) -> DataFrame:
    """Mean gated score and number of scored extractions by dimension, for several minimum assessabilities at once. counts: dimension_counts()."""
    planned, assessable = _d(F.col("planned_n")), _d(F.col("assessable_n"))
    each = counts.withColumn("minimum", F.explode(F.array(*[F.lit(float(m)) for m in minima])))
    value = F.when(assessable / planned >= F.col("minimum"), _d(F.col("true_n")) / F.nullif(assessable, F.lit(0.0)))
    return each.groupBy("feature_group", "opportunity_class", "minimum").agg(F.count(value).alias("n_scored"), F.avg(value).alias("mean_score"))


def design_matrix(rows: DataFrame, outcome: str, factors: dict[str, list[str]], groups: list[str]) -> DataFrame:
    """The rows of a mixed-effects model for a host's solver: groups, y, and a 0/1 column for each level of a factor but its first."""
    of = lambda f, level: F.coalesce(F.col(f) == level, F.lit(False)).cast("int").alias(f"{f}_{level}")
    columns = [of(f, level) for f, levels in factors.items() for level in levels[1:]]
    return rows.where(F.col(outcome).isNotNull()).select(*groups, F.col(outcome).cast("double").alias("y"), F.lit(1).alias("intercept"), *columns)

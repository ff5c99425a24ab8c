"""Resampling, averages, correlations and clusters against plain versions."""

import hashlib
import random
from statistics import NormalDist

import numpy as np
import pytest

from ontoscore.operators import clusters, resample, stats
from ontoscore.plans import stat_queries


def plain_weights(families, draws, seed):
    """A list of slots for each draw."""
    return [[families[int(hashlib.md5(f"{seed}:{b}:{s}".encode()).hexdigest()[:7], 16) % len(families)] for s in range(len(families))] for b in range(draws)]


def plain_bca(values, slots, alpha=0.05):
    """values: family -> x."""
    x = np.array(list(values.values()))
    sims = np.sort([round(float(np.mean([values[f] for f in draw if f in values])), 9) for draw in slots if any(f in values for f in draw)])
    estimate, b, n = round(float(x.mean()), 9), len(sims), len(x)
    z0 = NormalDist().inv_cdf(min(max((sims < estimate).mean(), 0.5 / b), 1 - 0.5 / b))
    d = x.mean() - (x.sum() - x) / (n - 1) if n > 1 else np.zeros(1)
    a = (d**3).sum() / (6 * (d**2).sum() ** 1.5) if np.abs(d).max() > 1e-12 else 0.0
    at = [NormalDist().cdf(z0 + (z0 + z) / (1 - a * (z0 + z))) for z in (NormalDist().inv_cdf(alpha / 2), NormalDist().inv_cdf(1 - alpha / 2))]
    return n, estimate, *[float(np.quantile(sims, q)) for q in at]


def test_adjusted_intervals_of_all_groups(spark):
    sf = "/root/testdata/sf0.001"
    values = {}
    for r in stat_queries._values(spark, sf).collect():
        values.setdefault((r["model_snapshot_id"], r["feature_group"]), {})[r["item_family_id"]] = r["x"]
    slots = plain_weights(sorted({f for v in values.values() for f in v}), stat_queries.DRAWS, resample.SEED)
    got = {(r["model_snapshot_id"], r["feature_group"]): (r["families"], r["estimate"], r["lower"], r["upper"]) for r in stat_queries.adjusted_intervals(spark, sf).collect()}
    assert got.keys() == values.keys()
    for k, v in values.items():
        assert got[k] == pytest.approx(plain_bca(dict(sorted(v.items())), slots), abs=1e-7)


def test_skewed_few_and_equal_values(spark):
    """Groups that lack families, one family alone, and values that do not differ."""
    rows = [("a", f"f{i}", float(i * i)) for i in range(9)] + [("b", f"f{i}", 2.0) for i in range(9)] + [("c", "f3", 1.0), ("c", "f4", None), ("d", None, 5.0), ("e", "f1", 0.1), ("e", "f2", 0.9), ("e", "f7", 0.2)]
    values = resample.family_values(spark.createDataFrame(rows, "m string, f string, v double"), ["m"], "f", "v")
    slots = plain_weights([f"f{i}" for i in range(9)], 300, 7)
    got = {r["m"]: (r["families"], r["estimate"], r["lower"], r["upper"]) for r in resample.intervals(values, ["m"], "f", 300, 7, adjusted=True).collect()}
    assert got.keys() == {"a", "b", "c", "e"}
    for m in got:
        assert got[m] == pytest.approx(plain_bca({f: v for k, f, v in rows if k == m and v is not None}, slots), abs=1e-7)
    assert resample.intervals(values.limit(0), ["m"], "f", 300, 7).collect() == []


def test_ranks_and_superiority(spark):
    means = spark.createDataFrame([(0, "x", 1.0), (0, "y", 1.0), (0, "z", 0.5), (1, "x", 0.1), (1, "y", 0.4), (2, "z", 1.0)], "draw long, m string, mean double")
    assert {(r["m"], r["rank"]): (r["draws"], r["share"]) for r in resample.rank_shares(means, "m", []).collect()} == {("x", 1): (1, 0.5), ("y", 2): (1, 0.5), ("z", 3): (1, 0.5), ("y", 1): (1, 0.5), ("x", 2): (1, 0.5), ("z", 1): (1, 0.5)}
    got = {(r["better"], r["worse"]): (r["draws"], r["share"]) for r in resample.superiority(means, "m", []).collect()}
    assert got == {("x", "y"): (2, 0.0), ("y", "x"): (2, 0.5), ("x", "z"): (1, 1.0), ("z", "x"): (1, 0.0), ("y", "z"): (1, 1.0), ("z", "y"): (1, 0.0)}


def test_averages_tell_a_null_from_a_total(spark):
    rows = [(None, "u", True, True), (None, "u", True, False), ("s", "v", False, True), ("s", "v", True, True), ("s", "w", False, False)]
    got = stats.averages(spark.createDataFrame(rows, "s string, u string, g boolean, j boolean"), "u", "g", "j", ["s"]).collect()
    by = {(r["s"], r["totalled"], r["u"], r["average"]): (r["precision"], r["recall"], r["f1"]) for r in got}
    assert by[None, "", None, "micro"] == by[None, "", "u", "unit"] == (1.0, 0.5, pytest.approx(2 / 3))
    assert by["s", "", None, "micro"] == (0.5, 1.0, pytest.approx(2 / 3)) and by["s", "", "w", "unit"] == (None, None, None)
    assert by[None, "s", None, "micro"] == (pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3)) and by[None, "s", None, "macro"] == (0.75, 0.75, pytest.approx(2 / 3))
    assert len(got) == len(by) == 3 + 2 * 2 + 3 + 2


def test_gram_is_the_correlation_of_the_rows_that_have_both(spark):
    pick = random.Random(2)
    rows = [[None if pick.random() < 0.3 else pick.gauss(k, 1 + k) + (i if k % 2 else 0) for k in range(6)] for i in range(80)]
    for r in rows:
        r[5] = 4.0
    df = spark.createDataFrame(rows, ", ".join(f"k{i} double" for i in range(6))).repartition(5)
    got = {(r["x"], r["y"]): (r["n"], r["r"]) for r in stats.gram(df, [f"k{i}" for i in range(6)]).collect()}
    assert len(got) == 15
    for (x, y), (n, r) in got.items():
        pairs = np.array([(a[x], a[y]) for a in rows if a[x] is not None and a[y] is not None])
        assert n == len(pairs) and (r is None if y == 5 else r == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=1e-9))
    assert {r["r"] for r in stats.gram(df.limit(0), ["k0", "k1"]).collect()} <= {None}


def test_clusters_equal_plain_rounds_from_the_same_seeds(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    points = df.selectExpr("vec_id AS id", "transform(embedding, x -> cast(x as double)) AS v")
    seeds = clusters.seeds(points, 8)
    rows = sorted((r["id"], r["v"]) for r in points.collect())
    assert seeds.shape == (8, len(rows[0][1])) and {tuple(s) for s in seeds} <= {tuple(v) for _, v in rows}
    x, centres = np.array([v for _, v in rows]), seeds.copy()
    for _ in range(clusters.MOST):
        at = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[at == k].mean(axis=0) if (at == k).any() else centres[k] for k in range(8)])
        done = np.abs(moved - centres).max() <= clusters.TOLERANCE
        centres = moved
        if done:
            break
    at = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r["vec_id"]: r["cluster"] for r in stat_queries.embedding_clusters(spark, sf).collect()} == {i: int(k) for (i, _), k in zip(rows, at, strict=True)}


def test_clusters_of_odd_vectors(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [9.0, 9.0]), (4, None), (5, []), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (3, [9.0, 9.1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["cluster"]) for r in clusters.clusters(df, 2).collect()), key=str)
    by = dict(got)
    assert len(got) == 9 and by[1] == by[2] != by[3] and all(by[k] is None for k in (4, 5, 6, 7, 8))
    assert len({r["cluster"] for r in clusters.clusters(df, 50).collect()}) == 4
    assert clusters.clusters(df.limit(0), 3).collect() == []
    assert {r["cluster"] for r in clusters.clusters(df.where("vec_id = 4"), 3).collect()} == {None}

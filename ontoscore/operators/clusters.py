"""Clusters of embeddings: k-means in DataFrames, from seeds that depend on the data and a seed alone.

Seeds are oversampled in rounds: a vector is taken with a chance in proportion to its squared distance from those taken before, by a hash
of its id and the round. Candidates, a few times k, are weighted by the vectors next to them and cut down to k on the driver, the one that
lowers the weighted distance most first. Assignment reads vectors in Arrow batches against the centres, which are k rows whatever the
data; what leaves a task is one sum for each centre. Rounds end when no centre moves by more than a tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, OVER, TOLERANCE, MOST = 5, 2.0, 1e-9, 100


def _finite(vector: Column) -> Column:
    """Whether a vector can be compared: not null or empty, all components known and finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & good, F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width) if len(column) else np.zeros((0, width))


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre (the first of equals) and its squared distance, computed as differences, a block of rows at a time."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x))
    step = max(1, (1 << 22) // max(1, centres.size))
    for i in range(0, len(x), step):
        d = ((x[i : i + step, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
        at[i : i + step], far[i : i + step] = d.argmin(axis=1), d.min(axis=1)
    return at, far


def assigned(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """id, cluster, distance (squared) of each point."""
    width = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, far = nearest(matrix(b.column("v"), width), centres)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at, pa.int32()), pa.array(far)], names=["id", "cluster", "distance"])

    return points.select("id", "v").mapInArrow(run, "id long, cluster int, distance double")


def _sums(points: DataFrame, centres: np.ndarray) -> list[tuple[int, int, float, list[float]]]:
    """cluster, points, distance and sum of the vectors of each centre that has any: at most k rows, pre-summed in each task."""
    k, width = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, total = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, width))
        for b in batches:
            x = matrix(b.column("v"), width)
            at, d = nearest(x, centres)
            n += np.bincount(at, minlength=k)
            far += np.bincount(at, d, k)
            for i in range(width):
                total[:, i] += np.bincount(at, x[:, i], k)
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(n[there]), pa.array(far[there]), pa.array(total[there].tolist(), pa.list_(pa.float64()))], names=["cluster", "n", "far", "total"])

    parts = points.select("v").mapInArrow(run, "cluster int, n long, far double, total array<double>")
    heads = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("far").alias("far"))
    sums = parts.select("cluster", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
    return [tuple(r) for r in heads.join(sums, "cluster").select("cluster", "n", "far", "total").collect()]


def _chance(seed: int, turn: int) -> Column:
    """A number in [0, 1) from the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(turn)), "id").cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def seeds(points: DataFrame, k: int, seed: int = 1, rounds: int = ROUNDS, over: float = OVER) -> np.ndarray:
    """k centres (fewer if there are fewer different vectors) among the points. Equal vectors count as one candidate."""
    first = points.orderBy(_chance(seed, 0), "id").limit(1).select("v").collect()
    if not first:
        return np.zeros((0, 0))
    taken = np.array([first[0]["v"]], float)
    for turn in range(1, rounds + 1):
        far = assigned(points, taken)
        total = far.agg(F.sum("distance")).first()[0]
        if not total:
            break
        chosen = far.where(_chance(seed, turn) < F.col("distance") * float(over * k / total))  # over * k rows expected
        new = [r["v"] for r in points.join(chosen.select("id"), "id", "left_semi").select("v").distinct().collect()]
        taken = np.unique(np.concatenate([taken, np.array(new, float).reshape(-1, taken.shape[1])]), axis=0)
    weight = np.zeros(len(taken))
    for cluster, n, _, _ in _sums(points, taken):
        weight[cluster] = n
    chosen = [int(np.lexsort((np.arange(len(taken)), -weight))[0])]
    far = ((taken - taken[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k and (far * weight).max() > 0:
        gain = [(weight * (far - np.minimum(far, ((taken - c) ** 2).sum(axis=1)))).sum() for c in taken]
        chosen.append(int(np.argmax(gain)))
        far = np.minimum(far, ((taken - taken[chosen[-1]]) ** 2).sum(axis=1))
    return taken[sorted(chosen)]


def lloyd(points: DataFrame, centres: np.ndarray, tolerance: float = TOLERANCE, most: int = MOST) -> tuple[np.ndarray, int]:
    """Centres after assignment and update in turns until none moves by more than the tolerance, and the rounds; empty clusters keep theirs."""
    for turn in range(1, most + 1):
        moved = centres.copy()
        for cluster, n, _, total in _sums(points, centres):
            moved[cluster] = np.array(total) / n
        shift = float(np.abs(moved - centres).max(initial=0.0))
        centres = moved
        if shift <= tolerance:
            return centres, turn
    return centres, most


def clusters(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", seed: int = 1) -> DataFrame:
    """key, cluster (null where the vector takes no part), distance (squared) of each row whose key is known.

    Vectors that are null or empty or hold a null or non-finite component take no part, nor do those of another length than most
    vectors have (the larger of equals). Rows of one key are points each. Runs jobs for each round.
    """
    known = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    sizes = known.where(_finite(F.col("v"))).groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    none = lambda df: df.select(F.col("id").alias(key), F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    if not sizes:
        return none(known)
    takes_part = _finite(F.col("v")) & (F.size("v") == sizes[0]["w"])
    points = known.where(takes_part)
    centres, _ = lloyd(points, seeds(points, k, seed))
    return assigned(points, centres).withColumnRenamed("id", key).union(none(known.where(~F.coalesce(takes_part, F.lit(False)))))

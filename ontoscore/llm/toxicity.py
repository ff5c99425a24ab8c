"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(threshold_k - x.w): all ordered thresholds share the weights w of hashed words. The fit sees a bounded sample of
labelled texts, each class weighted to its share of all labels, so that chances mean the same at every size; scoring goes over every
text in one pass, without a shuffle. The output is the expected severity, the sum over k of P(grade > k), with the chances of each
grade.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import PLAIN, chunks, materialise, record, text_buffer, words

BITS = 20
#: Lengths of the word beginnings that are features too, in bytes; inflected words share them.
HEADS = (5, 6)
#: Labelled texts of each class that the fit sees at most.
SAMPLE = 3000
#: Labelled texts of the sample that a word must be in, and how many standard errors its share must differ between the classes by.
SUPPORT = 5
EVIDENCE = 4.5
#: A text is toxic from this chance of a grade above 0.
THRESHOLD = 0.5


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (row, feature) of a buffer and how often each occurs. Features are hashed words and their first HEADS bytes.

    A-Z counts as a-z; white space and ASCII punctuation part words. known: only features with a true entry.
    """
    _, _, h, first, *heads = words(data, offsets, fold=True, between=PLAIN, heads=HEADS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first)).astype(np.uint64) << np.uint64(bits)
    keys = []
    for x in (h, *heads):
        place = x >> np.uint64(64 - bits)
        keep = x != 0 if known is None else (x != 0) & known[place]
        keys.append(row[keep] | place[keep])
    keys, times = np.unique(np.concatenate(keys), return_counts=True)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64), times


@dataclass
class Model:
    """weights: by hashed word; thresholds: ascending."""

    weights: np.ndarray
    thresholds: np.ndarray

    def packed(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """What scoring needs, without the zeros: a few thousand numbers."""
        used = np.flatnonzero(self.weights)
        return len(self.weights), used.astype(np.int32), self.weights[used], self.thresholds

    @staticmethod
    def unpacked(width: int, used: np.ndarray, values: np.ndarray, thresholds: np.ndarray) -> Model:
        weights = np.zeros(width)
        weights[used] = values
        return Model(weights, thresholds)

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ... by row."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, rows: np.ndarray, words_: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(rows, self.weights[words_], n)


def fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, levels: int, width: int, penalty: float = 3e-6, rounds: int = 300, rate: float = 0.1, counts: np.ndarray | None = None) -> Model:
    """Maximum likelihood with an L2 penalty, by full-batch Adam. rows, cols: the ones of the feature matrix; counts: texts that a row stands for (1)."""
    n = len(grades)
    weight = (np.ones(n) if counts is None else counts) / (n if counts is None else max(counts.sum(), 1e-9))
    present = np.unique(grades)
    if n == 0 or len(present) < 2:  # nothing to tell apart: everything gets the one grade that is known
        only = int(present[0]) if len(present) else 0
        return Model(np.zeros(width), np.where(np.arange(levels - 1) < only, -30.0, 30.0))
    support = np.bincount(cols, minlength=width)
    above = np.bincount(cols[grades[rows] > present[0]], minlength=width)
    n1 = max(1, int((grades > present[0]).sum()))
    share = support / n
    error = np.sqrt(np.maximum(share * (1 - share) * (1 / n1 + 1 / max(1, n - n1)), 1e-12))
    used = np.flatnonzero((support >= SUPPORT) & (np.abs(above / n1 - (support - above) / max(1, n - n1)) >= EVIDENCE * error))
    place = np.full(width, -1)
    place[used] = np.arange(len(used))
    keep = place[cols] >= 0
    rows, cols = rows[keep], place[cols[keep]]
    w, base, steps = np.zeros(len(used)), np.array([0.0]), np.zeros(max(0, levels - 2))
    share = np.array([np.clip(weight[grades <= k].sum(), 0.01, 0.99) for k in range(levels - 1)])
    start = np.maximum.accumulate(np.log(share / (1 - share)))
    base[0] = start[0]
    steps[:] = np.log(np.maximum(np.diff(start), 1e-2))
    params = [w, base, steps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, rounds + 1):
        cuts = np.concatenate([base, base + np.cumsum(np.exp(steps))])
        s = np.bincount(rows, w[cols], n)
        low = np.concatenate([[-np.inf], cuts])[grades]
        high = np.concatenate([cuts, [np.inf]])[grades]
        a, b = 1 / (1 + np.exp(np.clip(s - high, -60, 60))), 1 / (1 + np.exp(np.clip(s - low, -60, 60)))  # P(<= grade), P(< grade)
        da, db = a * (1 - a), b * (1 - b)
        p = np.maximum(a - b, 1e-9)
        ds = (da - db) / p * weight  # of the negative log likelihood by s
        gw = np.bincount(cols, ds[rows], len(w)) + penalty * w
        gc = np.zeros(levels - 1)
        up, down = grades < levels - 1, grades > 0
        np.add.at(gc, grades[up], -(da / p * weight)[up])
        np.add.at(gc, grades[down] - 1, (db / p * weight)[down])
        tail = np.cumsum(gc[::-1])[::-1]
        gs = tail[1:] * np.exp(steps)
        for i, g in enumerate((gw, tail[:1], gs)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    full = np.zeros(width)
    full[used] = w
    return Model(full, np.concatenate([base, base + np.cumsum(np.exp(steps))]))


def _sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bits: int, sample: int) -> tuple[DataFrame, np.ndarray]:
    """(id, label, cols, times) of the sampled texts, in shared storage, and how many labelled ids a sampled one of each class stands for.

    At most `sample` labelled ids of each class are taken; their features stay on the executors.
    """
    known = labels.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    part = [known.where((F.col("label") > 0) == bool(k)).orderBy(F.xxhash64("id"), "id").limit(sample) for k in range(2)]
    sizes_of = {int(r["toxic"]): r["count"] for r in known.groupBy((F.col("label") > 0).alias("toxic")).count().collect()}
    chosen = F.broadcast(part[0].union(part[1]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    schema = pa.schema([("id", pa.int64()), ("label", pa.int32()), ("cols", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in chunks(offsets):
                row, col, times = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits)
                cut, part = np.searchsorted(row, np.arange(1, j - i)), batch.slice(i, j - i)
                yield record(schema, id=part.column("id").to_pylist(), label=part.column("label").to_pylist(), cols=[x.astype(np.int32) for x in np.split(col, cut)], times=[x.astype(np.int32) for x in np.split(times, cut)])

    # repeated rows of one id: one of them stands for it
    sampled = texts.mapInArrow(run, "id long, label int, cols array<int>, times array<int>").dropDuplicates(["id"])
    share = np.array([max(1.0, sizes_of.get(k, 0) / max(1, sample)) for k in range(2)])
    return materialise(sampled, "sampled"), share


def _chosen(sampled: DataFrame, n1: int, n0: int) -> DataFrame:
    """col, used, marks: the features that tell the classes apart, as fit() takes them (used), and those that mark the toxic class."""
    of_class = lambda k: F.count_if((F.col("label") > 0) == bool(k))
    counts = sampled.select("label", F.explode("cols").alias("col")).groupBy("col").agg(of_class(1).alias("df1"), of_class(0).alias("df0"))
    total, share = F.col("df1") + F.col("df0"), (F.col("df1") + F.col("df0")) / F.lit(float(n1 + n0))
    error = F.sqrt(F.greatest(share * (1 - share) * F.lit(1 / n1 + 1 / n0), F.lit(1e-12)))
    used = (total >= SUPPORT) & (F.abs(F.col("df1") / F.lit(float(n1)) - F.col("df0") / F.lit(float(n0))) >= EVIDENCE * error)
    ratio = F.log((F.col("df1") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("df0") + 0.5) / F.lit(n0 + 1.0))
    marks = (ratio > float(np.log(5))) & (F.col("df1") >= SUPPORT)
    return counts.select("col", used.alias("used"), marks.alias("marks")).where("used or marks")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", bits: int = BITS, sample: int = SAMPLE) -> Model:
    """A model of three grades. Conflicting labels of an id count as the larger; null labels and ids are left out.

    Labels of 0 and less are not toxic; labels of 2 and more are severe (grade 2). Where there are none of those labels are binary, and a
    toxic text is severe if words that mark the class occur in it more often than in the median one. What tells the classes apart is counted on the executors; the driver gets only those features of the sampled texts, however long they are.
    """
    grade = F.col(label_col).cast("int")  # greatest() and least() pass over nulls
    grade = F.when(grade.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(2), grade)))
    plain = labels.select(F.col(label_id).cast("long").alias("id"), grade.alias("label"))
    sampled, share = _sampled(docs, plain, id_col, text_col, bits, sample)
    sizes = {r["label"]: r["count"] for r in sampled.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0) + sizes.get(2, 0), sizes.get(0, 0)
    if not n1 or not n0:  # nothing to tell apart
        grades = np.full(n1 + n0, 1 if n1 else 0)
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), grades, 3, 1 << bits)
    each = sampled.select("id", F.inline(F.arrays_zip("cols", "times"))).withColumnRenamed("cols", "col").join(F.broadcast(_chosen(sampled, n1, n0)), "col")
    kept = each.groupBy("id").agg(F.sum(F.when(F.col("marks"), F.col("times")).otherwise(0)).alias("load"), F.sort_array(F.collect_list(F.when(F.col("used"), F.col("col")))).alias("cols"))
    got = sampled.select("id", "label").join(kept, "id", "left").select("id", "label", F.coalesce("load", F.lit(0)).alias("load"), F.coalesce("cols", F.array().cast("array<int>")).alias("cols")).toArrow().sort_by("id").combine_chunks()
    label, load = got.column("label").to_numpy().astype(np.int64), got.column("load").to_numpy()
    lists = pa.concat_arrays(got.column("cols").chunks)
    rows = np.repeat(np.arange(len(label), dtype=np.int32), pa.compute.list_value_length(lists).to_numpy())
    grades = label if (label == 2).any() else np.where(label == 1, 1 + (load > np.median(load[label == 1])), 0)
    return fit(rows, lists.flatten().to_numpy(), grades, 3, 1 << bits, counts=share[(label > 0).astype(int)])


def _score(model, bits: int, threshold: float, act):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpacked(*model.value)
        known = own.weights != 0
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            chance = np.zeros((batch.num_rows, len(own.thresholds)))
            for i, j in chunks(offsets):
                row, col, _ = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], bits, known)
                chance[i:j] = own.chances(own.scores(row, col, j - i))
            yield act(batch, chance, chance[:, 0] >= threshold)

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, severity (expected grade), p_any, p_severe, toxic. A null text has no words; null ids stay null.

    Long texts are cut into words a MB at a time and scored whole; repeated rows are scored each; an empty table gives an empty result;
    other columns are ignored.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("p_any", pa.float64()), ("p_severe", pa.float64()), ("toxic", pa.bool_())])

    def act(batch: pa.RecordBatch, chance: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(chance.sum(1)), pa.array(chance[:, 0]), pa.array(chance[:, -1]), pa.array(toxic)], schema=kind)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model.packed()), bits, threshold, act), "doc_id long, severity double, p_any double, p_severe double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not toxic, all columns kept whatever their names; rows with null or empty texts and null ids stay, repeated ones each."""

    def act(batch: pa.RecordBatch, chance: np.ndarray, toxic: np.ndarray) -> pa.RecordBatch:
        return batch.filter(pa.array(~toxic))

    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model.packed()), bits, threshold, act), docs.schema)

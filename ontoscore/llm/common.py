"""Helpers shared by the training-data operators: shared storage, row keys, and vectorised hashing of bytes and words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one vectorised step handles at once; bounds the worker's memory.
CHUNK = 1 << 20
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, on a local master only, a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="ontoscore-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as compressed Parquet in the shared folder and read it back; cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Deletes tables that materialise() wrote and nothing reads any more."""
    for df in written:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


# ---------------------------------------------------------------- columns


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def with_row_key(df: DataFrame, *cols: str) -> DataFrame:
    """Adds k1, k2: 128 bits that identify a row's values, nulls told from values; never null. Repeated rows share a key."""
    parts = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return df.withColumn("k1", F.xxhash64(F.lit(1), *parts)).withColumn("k2", F.xxhash64(F.lit(2), *reversed(parts)))


def resize(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, F.octet_length(F.coalesce(F.col(column), F.lit(""))))


def ranked(rows: DataFrame, by: list[str], order: list[str], keep: dict[str, Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Written: by, keep, and the row's rank (long, from 1) within `by` under that name; sums: for a kept column, the name of its sum over earlier rows.

    Rows are dealt by ranges of by and order (nulls first), and counted in each range, so that rows with one value of `by` may be any
    share of all. Rows that are equal in by and order have ranks in no certain order.
    """
    sums = sums or {}
    w = Window.partitionBy(*by, "_part")
    parts = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    parts = materialise(parts.select(*by, *[c.alias(k) for k, c in keep.items()], F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "ranges")
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = parts.groupBy(*by, "_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    counts = counts.select(*by, "_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("_n", *[f"_{c}" for c in sums])])
    above = w.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.join(counts, [*by, "_part"]).select(
        *by, *keep, (F.col("_n") + F.row_number().over(w.orderBy("_at"))).alias(name), *[(F.col(f"_{c}") + F.coalesce(F.sum(c).over(above), F.lit(0))).alias(as_) for c, as_ in sums.items()]
    )
    found = materialise(found, "ranked")
    discard(parts)
    return found


# ---------------------------------------------------------------- arrow


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of rows with about `most` bytes together, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


FLAT = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def flat_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a DDL string of plain types; needs no session, so workers can call it."""
    return pa.schema([(name, FLAT[kind]) for name, kind in (x.split() for x in ddl.split(","))])


def record(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK * 2:
        return _powers(BASE, n), _powers(BASE_INV, n)
    if not _POW:
        _POW.update(up=_powers(BASE, CHUNK * 2), down=_powers(BASE_INV, CHUNK * 2))
    return _POW["up"][:n], _POW["down"][:n]


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums modulo 2**64; (P[j] - P[i]) * down[i] identifies values[i:j]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def gram_hash(values: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    sums = prefix_hash(values)
    return mix((sums[k:] - sums[:-k]) * powers(len(values))[1][: len(values) - k + 1])


#: White space and ASCII punctuation.
PLAIN = SPACE.copy()
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


#: Bytes from which a word is hashed by itself.
LONG_WORD = 512
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of words, eight bytes at a time, each step mixing what came before; words of up to eight bytes and one length never clash.

    Unlike a polynomial modulo 2**64 no structure of long words (such as a sequence and its complement) makes them meet. Words of
    LONG_WORD bytes and more are hashed by XXH3.
    """
    plain = np.concatenate([FOLD[data] if fold else data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", plain, strides=(1,))
    size = (ends - starts).astype(np.uint64)
    out = mix(size * np.uint64(BASE) + np.uint64(1))
    left = np.flatnonzero(size < LONG_WORD)
    at = 0
    while len(left):
        rest = size[left] - np.uint64(at)
        block = eight[starts[left] + at] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * np.minimum(rest, np.uint64(8))))
        held = out[left]
        out[left] = mix(held ^ block) + held * np.uint64(BASE)
        at += 8
        left = left[rest > 8]
    for k in np.flatnonzero(size >= LONG_WORD).tolist():
        out[k] = xxh3_64_intdigest(plain[starts[k] : ends[k]].tobytes())
    return out


def words(data: np.ndarray, offsets: np.ndarray, fold: bool, between: np.ndarray = SPACE, heads: tuple[int, ...] = (), strong: bool = False) -> tuple[np.ndarray, ...]:
    """Words [^\\x20\\x09-\\x0D]+ of the rows in a buffer: starts, ends, 64-bit hashes, and the first word of each row (len + 1).

    fold: hash A-Z as a-z. strong: hashes by word_ids(), for what is known by its hash alone. between: the bytes that part words. heads: also, for each length, hashes of the words' first bytes (0 for
    words that are no longer). Words never cross rows. Long rows are hashed in parts, so memory follows the words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), *[np.zeros(0, np.uint64) for _ in heads]
    solid = ~between[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if strong:
        return starts, ends, word_ids(data, starts, ends, fold), np.searchsorted(starts, offsets)
    hashes, table, i = np.empty(len(starts), np.uint64), FOLDED if fold else BYTE, 0
    begun = [np.zeros(len(starts), np.uint64) for _ in heads]
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        sums, down = prefix_hash(table[data[lo:hi]]), powers(hi - lo)[1]
        hashes[i:j] = mix((sums[ends[i:j] - lo] - sums[starts[i:j] - lo]) * down[starts[i:j] - lo] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        for out, size in zip(begun, heads, strict=True):
            long = np.flatnonzero(ends[i:j] - starts[i:j] > size) + i
            out[long] = mix((sums[starts[long] - lo + size] - sums[starts[long] - lo]) * down[starts[long] - lo] + np.uint64(size << 32))
        i = j
    return starts, ends, hashes, np.searchsorted(starts, offsets), *begun


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x

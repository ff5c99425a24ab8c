"""Candidate search for repeated windows: the windows of W units (bytes or words) that occur more than once are brought
together without moving all text.

Each window belongs to the least hash among its k-grams (its anchor); equal windows have equal anchors, so only runs of windows
whose anchor occurs twice can hold a repeat. A first pass ships anchors alone; a second one ships the text of candidate runs,
equal segments combined where they are made. An anchor with many runs is hot: its runs are cut into pieces of PIECE windows that
are grouped by the bytes all windows of the piece share, so what only touches a frequent passage falls away from it and what lies
in it combines to one row. Those bytes follow from each window's own leftmost anchor, so equal windows meet whatever run they are
in. Pieces on the edges of a passage differ with what stands beside it; a group of them that is crowded parts into single windows, each
named by 128 bits of all its bytes, so that equal windows still meet and no group grows with the number of documents. No run is
dropped or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import gram_hash, materialise, record, sliding_min, text_buffer, with_row_key, words

POSITION = np.uint64((1 << 24) - 1)
#: Units of one text that are looked at together; longer texts are cut into parts that overlap by W - 1.
PART = 1 << 20
#: Windows of a run in one row.
MOST = 8192
PIECE = 8
#: An anchor with more runs, or more units in them, than this is hot; so one task sorts some MB for an anchor at most.
HOT, HOT_UNITS = 4000, 4 << 20
#: A group of pieces of hot runs with more rows than this is crowded. A run that isn't hot shares its group with fewer.
CROWDED = 8000
#: Parts in which pieces look up the windows they hold; crowded groups, eight bytes each, that are broadcast at most.
SALTS, SENT = 16, 1 << 20

RUNS = "k1 long, k2 long, id long, h long, s0 int, n int, a int, c int"
#: kind 0: places of a run (h, run) in documents; 1: pieces (g, fp), of which a run that isn't hot is one (run: 1 for those of hot
#: runs, else 0); 2: pieces of a hot run.
SEGMENTS = "kind int, h long, run long, g long, fp long, k1 long, k2 long, id long, s0 int, n int, copies long, seg binary"


class Unit:
    """How a text is cut: bytes, or words [^\\x20\\x09-\\x0D]+."""

    def __init__(self, name: str, window: int, k: int):
        self.name, self.window, self.k = name, window, k
        self.bytes = 1 if name == "byte" else 6  # about

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Values to hash, the first unit of each row (len + 1), and starts and ends of the units in data (None: bytes)."""
        if self.name == "byte":
            from ontoscore.llm.common import BYTE

            return BYTE[data], offsets, None, None
        starts, ends, h, first = words(data, offsets, fold=False)
        return h, first, starts, ends


def runs_of(values: np.ndarray, first: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows with one anchor hash: row, first window (in the row), windows, hash, anchor (-1: several), anchors."""
    W, k = unit.window, unit.k
    out = []
    i, rows = 0, len(first) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(first, first[i] + PART, "right")) - 1)
        lo, hi = int(first[i]), int(first[j])
        if hi - lo < W:  # no window; a chunk of empty rows has no units at all
            i = j
            continue
        step = PART if j == i + 1 else hi - lo
        for at in range(lo, hi - W + 1, step):
            end = min(hi, at + step + W - 1)
            grams = gram_hash(values[at:end], k)
            if end - at < W:
                continue
            a = (sliding_min((grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64), W - k + 1) & POSITION).astype(np.int64)
            bound = first[i : j + 1] - at
            row = np.searchsorted(bound, np.arange(len(a)), "right") - 1
            keep = np.flatnonzero(np.arange(len(a)) + W <= bound[row + 1])
            if not len(keep):
                continue
            row, a, h = row[keep], a[keep], grams[a[keep]]
            new = np.ones(len(keep), bool)
            new[1:] = (np.diff(keep) != 1) | (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            moved = np.zeros(len(keep), np.int64)
            moved[1:] = (a[1:] != a[:-1]) & ~new[1:]
            begin = np.flatnonzero(new)
            n = np.diff(np.append(begin, len(keep)))
            c = np.add.reduceat(moved, begin) + 1
            base = first[i + row[begin]]
            out.append((i + row[begin], keep[begin] + at - base, n, h[begin], np.where(c == 1, a[begin] + at - base, -1), c))
        i = j
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _find(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RUNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            k1, k2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "id"))
            i = 0
            while i < len(ids):  # a few MB at a time
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + 4 * PART, "right")) - 1)
                part = offsets[i : j + 1]
                values, first, _, _ = unit.hashes(data[part[0] : part[-1]], part - part[0])
                row, s0, n, h, a, c = runs_of(values, first, unit)
                if len(row):
                    yield record(schema, k1=k1[i + row], k2=k2[i + row], id=ids[i + row], h=h.view(np.int64), s0=s0.astype(np.int32), n=n.astype(np.int32), a=a.astype(np.int32), c=c.astype(np.int32))
                i = j

    return run


def fingerprint(b: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(b) - (1 << 63)


def leftmost(unit: Unit, seg: bytes, h: int, n: int) -> list[int]:
    """For each of the n windows of a segment with the anchor hash h, the first place in it where that stands."""
    values, *_ = unit.hashes(np.frombuffer(seg, np.uint8), np.array([0, len(seg)]))
    at = np.flatnonzero((gram_hash(values, unit.k) & ~POSITION) == (np.array([h]).view(np.uint64) & ~POSITION))
    return at[np.searchsorted(at, np.arange(n))].tolist()


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENTS))
    W = unit.window

    def pieces(run: dict, seg: bytes) -> Iterator[tuple[int | None, int, int]]:
        """(first unit of the shared part, or None: by hash; first window; windows)"""
        s0, end = run["s0"], run["s0"] + run["n"]
        if not run["hot"]:
            for s in range(s0, end, MOST):
                yield None, s, min(MOST, end - s)
            return
        places = None if run["a"] >= 0 else leftmost(unit, seg, run["h"], run["n"])
        s = s0
        while s < end:
            a = run["a"] if places is None else s0 + places[s - s0]
            j = (a - s) // PIECE  # windows a - 8j - 7 .. a - 8j; later ones up to a have no anchor before a either
            stop = min(end, a - PIECE * j + 1)
            yield a - PIECE * j, s, stop - s
            s = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple[int, int], list] = {}
        known: dict[tuple[int, int], list] = {}
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, known, rows, held
            rows += [(1, 0, v[4], g, fp, 0, 0, v[1], 0, v[2], v[0], v[3]) for (g, fp), v in made.items()]
            out = record(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))
            made, known, rows, held = {}, {}, [], 0
            return out

        for batch in batches:
            texts, all_runs = batch.column("text"), batch.column("runs")
            k1, k2, ids = (batch.column(c).to_pylist() for c in ("k1", "k2", "id"))
            for x in range(batch.num_rows):
                text = (texts[x].as_py() or "").encode()
                if unit.name == "byte":
                    at = None
                else:
                    split = text.split()
                    text = b" ".join(split)
                    at = np.zeros(len(split) + 1, np.int64)
                    np.cumsum([len(w) + 1 for w in split], out=at[1:])
                    at = at.tolist()

                def units(i: int, j: int, text: bytes = text, at: list | None = at) -> bytes:
                    return text[i:j] if at is None else text[at[i] : at[j] - 1]

                for r in all_runs[x].as_py():
                    s0, h = r["s0"], r["h"]
                    whole = [(s, min(MOST, s0 + r["n"] - s)) for s in range(s0, s0 + r["n"], MOST)]
                    for first, n in whole:
                        whole_run = units(first, first + n + W - 1)
                        name = (h, fingerprint(whole_run))
                        parts = known.get(name)
                        if parts is None:
                            parts = known[name] = []
                            for core, s, m in pieces(r | {"s0": first, "n": n}, whole_run):
                                seg = units(s, s + m + W - 1)
                                if core is None:
                                    key = name
                                else:
                                    key = (fingerprint(units(core, core + W - PIECE + 1)), fingerprint(seg))
                                    rows.append((2, *name, *key, 0, 0, 0, s - first, m, 0, None))
                                    held += 150
                                if key not in made:
                                    made[key] = [0, ids[x], m, seg, int(core is not None)]
                                    held += len(seg) + 200
                                parts.append(key)
                        for key in parts:
                            piece = made[key]
                            piece[0] += 1
                            piece[1] = min(piece[1], ids[x])
                        rows.append((0, *name, 0, 0, k1[x], k2[x], ids[x], first, n, 1, None))
                        held += 150
                    if held > 24 << 20:
                        yield flush()
        if rows:
            yield flush()

    return run


def candidates(docs: DataFrame, unit: Unit, by_document: bool) -> tuple[DataFrame, DataFrame]:
    """docs: k1, k2, id (long, never null), text. Returns (docs with keys, segments).

    by_document: a repeat counts only between different ids; else within a text too. Segments of kind 1 hold text (copies: how often
    it occurs, id: the least id that has it; made once in each batch), those of kind 0 say where runs lie (k1, k2, s0: first window, n windows).
    """
    runs = materialise(docs.select("k1", "k2", "id", "text").mapInArrow(_find(unit), RUNS), "runs")
    again = F.min("id") < F.max("id") if by_document else F.sum("c") >= 2
    known = runs.groupBy("h").agg(again.alias("again"), F.count("*").alias("runs_n"), F.sum(F.col("n").cast("long") + unit.window).alias("units")).where("again")
    known = known.select("h", ((F.col("runs_n") > HOT) | (F.col("units") > HOT_UNITS // unit.bytes)).alias("hot"))
    wanted = runs.join(known, "h").groupBy("k1", "k2").agg(F.collect_set(F.struct("h", "s0", "n", "a", "hot")).alias("runs"))
    cut = docs.join(wanted, ["k1", "k2"]).select("k1", "k2", "id", "text", "runs")
    return docs, materialise(cut.mapInArrow(_cut(unit), SEGMENTS), "segments")


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """k1, k2, id (null: the largest long), doc_id, text (null: empty) of a table; rest: the other columns too, as one struct."""
    others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.lit(0).alias("none")]).alias("rest")] if rest else []
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *others)
    return with_row_key(plain, "doc_id", "text").select("k1", "k2", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "doc_id", "text", *["rest"] * rest)


def groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[dict]]:
    """Merges the equal segments of rows sorted by g, fp and yields lists of them that hold whole groups, of about `most` bytes."""
    batch: list[dict] = []
    held, last = 0, None
    for rows in batches:
        for r in rows.to_pylist():
            key = (r["g"], r["fp"])
            if last is not None and key == (last["g"], last["fp"]):
                last["copies"] += r["copies"]
                last["id"] = min(last["id"], r["id"])
                continue
            if last is not None and r["g"] != last["g"] and held > most:
                yield batch
                batch, held = [], 0
            batch.append(r)
            held += len(r["seg"])
            last = r
    if batch:
        yield batch


PARTED = "g long, fp long, at int, w1 long, w2 long, copies long, id long"


def _part(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PARTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                cut = r["seg"] if unit.name == "byte" else r["seg"].split(b" ")
                for at in range(r["n"]):
                    window = cut[at : at + unit.window]
                    name = xxhash.xxh3_128_intdigest(window if unit.name == "byte" else b" ".join(window))
                    rows.append((r["g"], r["fp"], at, (name >> 64) - (1 << 63), (name & (1 << 64) - 1) - (1 << 63), r["copies"], r["id"]))
            if rows:
                yield record(schema, **dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True)))

    return run


def parted(pieces: DataFrame, unit: Unit) -> DataFrame:
    """g, fp, at, copies, first_id: the windows (at: place in the piece) of crowded pieces that occur more than once.

    Only names of windows move. A window that most pieces of a group hold is counted where they lie, and looked up in SALTS parts.
    """
    windows = materialise(pieces.mapInArrow(_part(unit), PARTED), "windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("all"), F.min("id").alias("first_id")).where(F.col("all") > 1)
    again = again.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = windows.select("g", "fp", "at", "w1", "w2", F.pmod("fp", F.lit(SALTS)).cast("long").alias("salt"))
    return own.join(again, ["w1", "w2", "salt"]).select("g", "fp", "at", F.col("all").alias("copies"), "first_id").distinct()


RESULTS = "g long, fp long, spans array<struct<s:int,n:int>>, copies long, first_id long"


def resolved(segments: DataFrame, unit: Unit, work: Callable[[list[dict]], list[list[tuple[int, int]]]], most: int) -> DataFrame:
    """For each distinct segment the spans of its windows that `work` finds repeated elsewhere in its group, its copies and least id (at: null);
    for segments of crowded groups a row for each window that occurs more than once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RESULTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, most):
            spans = work(group)
            kept = [(r["g"], r["fp"], [{"s": s, "n": n} for s, n in x], r["copies"], r["id"]) for r, x in zip(group, spans, strict=True) if x or r["copies"] > 1]
            if kept:
                yield record(schema, **dict(zip(schema.names, map(list, zip(*kept, strict=True)), strict=True)))

    text = segments.where("kind = 1").select("g", "fp", "run", "n", "copies", "id", "seg")
    crowded = materialise(segments.where("kind = 1 AND run = 1").groupBy("g", "run").count().where(F.col("count") > CROWDED).select("g", "run"), "crowded")
    many, windows = crowded.count(), None
    if many:
        crowded = F.broadcast(crowded) if many <= SENT else crowded
        windows = parted(text.join(crowded, ["g", "run"], "left_semi"), unit)
        text = text.join(crowded, ["g", "run"], "left_anti")
    found = text.drop("run").repartition("g").sortWithinPartitions("g", "fp").mapInArrow(run, RESULTS).withColumn("at", F.lit(None).cast("int"))
    if windows is None:
        return found
    none = F.array().cast("array<struct<s:int,n:int>>")
    return found.unionByName(windows.withColumn("spans", none))


def spans_of(segments: DataFrame, found: DataFrame, whole: Callable[[Column, Column], Column]) -> DataFrame:
    """k1, k2, spans: the repeated windows of each document. whole(id, piece): whether all of a piece (copies, first_id) is repeated in a document."""
    found = materialise(found, "resolved")  # it is joined twice
    piece = lambda off, n: F.array(F.struct(off.alias("off"), n.alias("n"), "spans", "copies", "first_id"))
    cut = segments.where("kind = 2").select("h", "run", "g", "fp", "s0", "n").distinct().join(found, ["g", "fp"])
    off, n = F.col("s0") + F.coalesce("at", F.lit(0)), F.when(F.col("at").isNull(), F.col("n")).otherwise(1)
    hot = cut.groupBy("h", "run").agg(F.flatten(F.collect_list(piece(off, n))).alias("pieces"))
    plain = found.where("at IS NULL").select(F.col("g").alias("h"), F.col("fp").alias("run"), piece(F.lit(0), F.lit(-1)).alias("pieces"))
    places = segments.where("kind = 0").select("h", "run", "k1", "k2", "id", "s0", "n")

    def placed(x: Column) -> Column:
        at = F.col("s0") + x["off"]
        every = F.array(F.struct(at.cast("int").alias("s"), F.when(x["n"] < 0, F.col("n")).otherwise(x["n"]).cast("int").alias("n")))
        return F.when(whole(F.col("id"), x), every).otherwise(F.transform(x["spans"], lambda y: F.struct((at + y["s"]).cast("int").alias("s"), y["n"].cast("int").alias("n"))))

    joined = places.join(plain.unionByName(hot), ["h", "run"]).select("k1", "k2", F.flatten(F.transform("pieces", placed)).alias("spans")).where(F.size("spans") > 0)
    return joined.groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))

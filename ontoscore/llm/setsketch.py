"""Near-duplicate documents by SetSketch registers.

A document's set (word shingles, hashed to 64 bits) becomes M registers: the least of an exponential variate over the set, on a
scale spaced by powers of B and truncated. Sketches of parts merge by maximum. Documents with equal sets are one node. Bands of
registers bring nodes together; inside a bucket every node is compared with the few leaders that the bucket has so far, by the
maximum-likelihood estimate of the Jaccard similarity from the numbers of larger, equal and smaller registers. A node and the leader
it is closest to are confirmed on full sets, which connects most of what belongs together with one set sent for each node. What
may still be linked lies in different components that are near a common leader (the Jaccard distance obeys the triangle inequality,
so two linked nodes of a bucket always are): only nodes of such components are compared with each other, across components. No
pair of nodes is left out but those whose estimate lies far (over four standard errors) below the threshold or that are connected
already. Large buckets, leaders with many nodes and large components are split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import chunks, discard, gram_hash, materialise, mix, record, text_buffer, with_row_key, words
from ontoscore.llm.graph import components

SHINGLE = 5
PERCENT = 80
M = 128
B = 1.001
LIMIT = (1 << 16) - 2
BAND = 4
#: An estimate has a standard error of 0.04 at most; one this far below the threshold rules a link out.
SLACK = 0.16
#: Nodes of a family that one task holds; larger families are compared block by block.
BLOCK = 4000
#: Nodes of a bucket, and of a leader, that one task takes; more are split over several.
PART = 2000
#: Leaders that a node's set is compared with at first.
TRIES = 2

_SEED = mix(np.arange(1, 2 * M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
MULTIPLY, ADD = _SEED[:M] | np.uint64(1), _SEED[M:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a buffer; a text with fewer words is one shingle, one without words none."""
    _, _, h, first = words(data, offsets, fold=True, strong=True)
    grams = gram_hash(h, width)
    out = []
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            out.append(np.unique(grams[lo : hi - width + 1]))
        elif hi > lo:
            out.append(gram_hash(h[lo:hi], hi - lo))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (len(sets) x M, uint16) of nonempty sets."""
    low = np.empty((len(sets), M), np.uint64)
    sizes = np.array([len(s) for s in sets])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    values = np.concatenate(sets)
    for i, j in chunks(begin, 1024):
        least = np.full((j - i, M), ~np.uint64(0))
        for at in range(begin[i], begin[j], 1024):
            part = values[at : min(at + 1024, begin[j])]
            scaled = MULTIPLY[:, None] * part[None, :] + ADD[:, None]
            row0 = int(np.searchsorted(begin[i : j + 1], at, "right")) - 1
            row1 = int(np.searchsorted(begin[i : j + 1], at + len(part), "left"))
            cuts = np.maximum(begin[i + row0 : i + row1] - at, 0)
            got = np.minimum.reduceat(scaled, cuts, axis=1).T
            least[row0:row1] = np.minimum(least[row0:row1], got)
        low[i:j] = least
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, LIMIT).astype(np.uint16)


def likely(a: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of a sketch and others, sizes of the sets known.

    With u, v the shares of the sizes, a register of the first is larger with chance u - vJ and smaller with chance v - uJ (to the
    first order in B - 1); the likelihood of the three counts has its maximum at a root of a quadratic.
    """
    more, less = (a > others).sum(1), (a < others).sum(1)
    same = M - more - less
    u = n / (n + sizes)
    v = 1 - u
    p = M * u * v
    q = same * (u * u + v * v) + more * v * v + less * u * u
    return (q - np.sqrt(np.maximum(q * q - 4 * p * same * u * v, 0))) / (2 * p)


SKETCH = "k1 long, k2 long, doc_id long, node long, n long, regs binary"


def _sketch(width: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    from xxhash import xxh3_64_intdigest

    schema = to_arrow_schema(StructType.fromDDL(SKETCH))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in chunks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                full = [k for k, s in enumerate(sets) if len(s)]
                regs: list[bytes | None] = [None] * len(sets)
                if full:
                    for k, r in zip(full, registers([sets[k] for k in full]), strict=True):
                        regs[k] = r.tobytes()
                nodes = [xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None for s in sets]
                part = batch.slice(i, j - i)
                yield record(schema, k1=part.column("k1").to_pylist(), k2=part.column("k2").to_pylist(), doc_id=part.column("doc_id").to_pylist(), node=nodes, n=[len(s) for s in sets], regs=regs)

    return run


EDGES = "u long, v long, close boolean, bucket long"


class Leaders:
    """The leaders of a bucket, their registers in one growing matrix. Those that edges have joined are of one group."""

    def __init__(self):
        self.nodes: list[int] = []
        self.group: list[int] = []
        self.regs, self.sizes = np.empty((4, M), np.uint16), np.empty(4, np.int64)

    def similar(self, regs: np.ndarray, n: int) -> np.ndarray:
        k = len(self.nodes)
        return likely(regs, n, self.regs[:k], self.sizes[:k])

    def add(self, node: int, regs: np.ndarray, n: int, group: int) -> None:
        k = len(self.nodes)
        if k == len(self.sizes):
            self.regs, self.sizes = np.concatenate([self.regs, np.empty_like(self.regs)]), np.concatenate([self.sizes, np.empty_like(self.sizes)])
        self.regs[k], self.sizes[k] = regs, n
        self.nodes.append(node)
        self.group.append(group)


def _families(percent: int):
    """Rows sorted by bucket and salt, leaders of other parts (kind 0) first: edges that join each node with the leaders it is near.

    The closest leader that a node is plausible with is marked; of leaders that edges have joined one gets an edge. A node that is
    plausible with none leads too; leaders of buckets that are split are also told (v null). A node is within 1 - plausible of its
    leader, a node linked to it within 1 - percent/100 of it, so within their sum of the leader.
    """
    plausible = percent / 100 - SLACK
    near = max(0.02, percent / 100 + plausible - 1 - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaders, foreign = None, Leaders(), 0
        for batch in batches:
            out: list[tuple] = []
            for bucket, salt, kind, node, n, regs, split in zip(*(batch.column(c).to_pylist() for c in ("bucket", "salt", "kind", "node", "n", "regs", "split")), strict=True):
                regs = np.frombuffer(regs, np.uint16)
                if (bucket, salt) != at:
                    at, leaders, foreign = (bucket, salt), Leaders(), 0
                if kind == 0:  # the node is compared with leaders of other parts; within its own part it has been
                    leaders.add(node, regs, n, len(leaders.nodes))
                    foreign += 1
                    continue
                est = leaders.similar(regs, n) if leaders.nodes else np.zeros(0)
                mine: dict[int, int] = {}
                if len(est):
                    if foreign and node in leaders.nodes:
                        est[leaders.nodes.index(node)] = -1.0
                    best = int(est.argmax())
                    for k in np.flatnonzero(est >= near).tolist():
                        if k == best or leaders.group[k] != leaders.group[best]:
                            mine.setdefault(leaders.group[k], k)
                    out += [(node, leaders.nodes[k], k == best and est[k] >= plausible, None) for k in mine.values()]
                    if len(mine) > 1:
                        one = min(mine)
                        leaders.group = [one if g in mine else g for g in leaders.group]
                if not foreign and (not len(est) or est.max() < plausible):
                    leaders.add(node, regs, n, min(mine) if mine else len(leaders.nodes))
                    if split:
                        out.append((node, None, False, bucket))
            if out:
                u, v, close, buckets = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array([bool(c) for c in close]), pa.array(buckets, pa.int64())], names=["u", "v", "close", "bucket"])

    return run


def _stars(percent: int):
    """Rows sorted by leader and salt, the leader's set (kind 0) first: the nodes whose sets are similar to it, as links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for kind, v, node, items in zip(*(batch.column(c) for c in ("kind", "v", "node", "items")), strict=True):
                items = np.frombuffer(items.as_buffer(), np.uint64)
                if kind.as_py() == 0:
                    own = items.copy()
                    continue
                if similar(own, items, percent):
                    us.append(node.as_py())
                    vs.append(v.as_py())
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of percent/100 or more."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links(percent: int):
    """Rows sorted by task: confirmed links that connect the nodes of a task that are of different components."""
    plausible = percent / 100 - SLACK

    def confirm(rows: list[dict]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(r["items"], np.uint64) for r in rows]
        sizes = np.array([len(s) for s in sets])
        sketches = np.array([np.frombuffer(r["regs"], np.uint16) for r in rows])
        side = np.array([r["side"] for r in rows])
        root = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
        out = []
        for x in range(1, len(rows)):
            few = np.minimum(sizes[:x], sizes[x]) * 100 >= percent * np.maximum(sizes[:x], sizes[x])
            if side[x] >= 0:  # two blocks: only pairs across
                few &= side[:x] != side[x]
            few &= root[:x] != root[x]
            near = np.flatnonzero(few)
            if not len(near):
                continue
            est = likely(sketches[x], int(sizes[x]), sketches[near], sizes[near])
            order = np.argsort(-est, kind="stable")
            for y in near[order[est[order] >= plausible]].tolist():
                if root[y] != root[x] and similar(sets[x], sets[y], percent):
                    out.append((rows[x]["node"], rows[y]["node"]))
                    root[root == root[x]] = root[y]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1 and (found := confirm(rows)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["u", "v"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] != task:
                    yield from flush()
                    task, rows = r["task"], []
                rows.append(r)
        yield from flush()

    return run


ITEMS = "node long, regs binary, items binary"


def _items(width: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ITEMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            for i, j in chunks(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                part = batch.slice(i, j - i)
                yield record(schema, items=[s.tobytes() for s in sets], **{c: part.column(c).to_pylist() for c in ("node", "regs")})

    return run


def _edges(near: DataFrame, known: DataFrame, percent: int, part: int) -> DataFrame:
    """near: node, bucket, c (nodes of the bucket). u, v, close: nodes and the leaders that they are near."""
    parts = F.ceil(F.col("c") / part)
    dealt = near.join(known.select("node", "n", "regs"), "node").withColumn("split", parts > 1).withColumn("salt", F.pmod(F.xxhash64("node", "bucket"), parts))

    def led(rows: DataFrame) -> DataFrame:
        rows = rows.select("bucket", "salt", "kind", "node", "n", "regs", "split")
        return rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind", "node").mapInArrow(_families(percent), EDGES)

    first = materialise(led(dealt.withColumn("kind", F.lit(1))), "edges")
    told = first.where("v is null").select(F.col("u").alias("node"), "bucket")
    if told.isEmpty():
        return first
    # the leaders of the parts of a split bucket meet the nodes of all its parts
    sizes = near.groupBy("bucket").agg(F.first("c").alias("c")).where(F.col("c") > part)
    leaders = told.join(sizes, "bucket").join(known.select("node", "n", "regs"), "node").withColumn("split", F.lit(True)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    again = leaders.withColumn("kind", F.lit(0)).select("bucket", "salt", "kind", "node", "n", "regs", "split").union(dealt.where("split").withColumn("kind", F.lit(1)).select("bucket", "salt", "kind", "node", "n", "regs", "split"))
    return materialise(first.where("v is not null").union(led(again)), "edges")


def _tries(edges: DataFrame) -> DataFrame:
    """Of each node's closest leaders (one in each of its buckets at most) the TRIES that most nodes have: what these don't connect is compared across components."""
    close = edges.where("close").select("u", "v").distinct()
    degree = close.groupBy("v").agg(F.count("*").alias("degree"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("degree")).alias("d"), "v"))), 1, TRIES)
    return close.join(degree, "v").groupBy("u").agg(best.alias("best")).select("u", F.explode("best").alias("x")).select("u", "x.v")


def _confirmed(pairs: DataFrame, items: DataFrame, percent: int, part: int) -> DataFrame:
    """Of distinct pairs u, v those whose sets are similar: v's set is sent once for each `part` of its pairs, u's for each pair."""
    degree = pairs.groupBy("v").agg(F.ceil(F.count("*") / part).alias("parts"))
    sets = items.select("node", "items")
    asked = pairs.join(degree, "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).alias("salt"), F.lit(1).alias("kind"), F.col("u").alias("node")).join(sets, "node")
    leaders = degree.select("v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("v").alias("node")).join(sets, "node")
    both = asked.select("v", "salt", "kind", "node", "items").union(leaders.select("v", "salt", "kind", "node", "items"))
    return both.repartition("v", "salt").sortWithinPartitions("v", "salt", "kind").mapInArrow(_stars(percent), "u long, v long")


def _across(edges: DataFrame, groups: DataFrame, items: DataFrame, percent: int, block: int) -> DataFrame | None:
    """Links between components of `groups` that edges say are near; None if there are none such. Large components meet others block by block, never themselves."""
    nodes = items.select("node").join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("comp"))
    ends = edges.select("u", "v").distinct()
    of = lambda c, name: nodes.select(F.col("node").alias(c), F.col("comp").alias(name))
    open_ = ends.join(of("u", "a"), "u").join(of("v", "b"), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    family = components(open_).select(F.col("node").alias("comp"), F.col("component").alias("family"))
    if family.isEmpty():
        return None
    placed = nodes.join(family, "comp")
    sizes = placed.groupBy("family", "comp").agg(F.count("*").alias("n")).withColumn("owner", F.when(F.col("n") * 2 >= block, F.col("comp")))
    shares = sizes.groupBy("family", "owner").agg(F.ceil(F.sum("n") / block).alias("parts"))
    same = lambda a, b: (a["family"] == b["family"]) & a["owner"].eqNullSafe(b["owner"])
    dealt = placed.join(sizes.drop("n"), ["family", "comp"])
    dealt = dealt.join(shares, same(dealt, shares)).select("node", "comp", dealt["family"], dealt["owner"], F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    # the blocks of a family; a block meets itself (side -1) and each other block (side: whether it is the first) but those of its own component
    blocks = shares.select("family", "owner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    blocks = blocks.groupBy("family").agg(F.collect_list(F.struct("owner", "part")).alias("blocks"))
    key = lambda x: F.struct(F.coalesce(x["owner"], F.lit(-(1 << 63))).alias("o"), x["part"].alias("p"))
    own = F.struct("owner", "part")
    met = F.filter("blocks", lambda x: ~F.coalesce(x["owner"] == F.col("owner"), F.lit(False)))
    pair = F.transform(met, lambda x: F.struct(F.xxhash64("family", F.least(key(own), key(x)), F.greatest(key(own), key(x))).alias("task"), F.when(key(own) == key(x), -1).when(key(own) > key(x), 0).otherwise(1).alias("side")))
    tasks = dealt.join(blocks, "family").select("node", "comp", F.inline(pair)).join(items, "node").repartition("task").sortWithinPartitions("task", "node")
    return tasks.mapInArrow(_links(percent), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK, part: int = PART) -> DataFrame:
    """One row per row of docs: doc_id, k1, k2 (a key of id and text), n_shingles, component_id, kept, n_links (of its node), component.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case. Documents whose sets of distinct `width`-word shingles have a Jaccard
    similarity of percent/100 or more are linked; n_links counts the links of a node that were confirmed on the way to its component,
    which need not be all. component_id is the least id reachable, component a name of the group (null: no words). A text with fewer
    words is one shingle; one without words (or null) is linked with nothing. A null id does not count for component_id: a component
    of null ids has a null one, and its rows are kept. Repeated rows are in one component and kept together. Long texts are taken
    whole: their sets are as long as they are. An empty table gives an empty result; other columns are ignored.
    """
    plain = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "text")
    sketches = materialise(plain.select("k1", "k2", "doc_id", "text").mapInArrow(_sketch(width), SKETCH), "sketches")
    filled = sketches.where("node is not null")
    # bands; copies combine, buckets of one node go
    bands = [F.xxhash64(F.lit(i), F.substring("regs", 1 + 2 * BAND * i, 2 * BAND)) for i in range(M // BAND)]
    band = filled.select("node", F.explode(F.array(*bands)).alias("bucket")).distinct()
    shared = band.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    near = materialise(band.join(shared, "bucket"), "buckets")
    # one row for each node that shares a bucket: its least key finds its text and registers
    members = near.select("node").distinct()
    chosen = filled.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k")).select("node", "k.k1", "k.k2").join(members, "node")
    known = materialise(filled.select("k1", "k2", "n", "regs").join(chosen, ["k1", "k2"]).dropDuplicates(["node"]), "nodes")
    edges = _edges(near, known, percent, part)
    ends = edges.where("v is not null").select(F.explode(F.array("u", "v")).alias("node")).distinct()
    items = materialise(plain.select("k1", "k2", "text").join(known.join(ends, "node"), ["k1", "k2"]).dropDuplicates(["node"]).mapInArrow(_items(width), ITEMS), "items")
    links = materialise(_confirmed(_tries(edges), items, percent, part), "links")
    groups = components(links)
    across = _across(edges.where("v is not null"), groups, items, percent, block)
    if across is not None:
        found = materialise(across, "links")
        of = lambda c, name: found.join(groups.select(F.col("node").alias(c), F.col("component").alias("x")), c, "left").withColumn(name, F.coalesce("x", F.col(c))).drop("x")
        joined = of("u", "a").join(of("v", "b"), ["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v"))
        joined = components(joined).select(F.col("node").alias("old"), F.col("component").alias("new"))
        every = groups.union(joined.select("old", "old")).distinct()
        groups = every.join(joined, every["component"] == joined["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
        links = links.union(found)
    discard(near, edges, items)
    least = filled.groupBy("node").agg(F.min("doc_id").alias("least"))
    own = least.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    whole = own.groupBy("component").agg(F.min("least").alias("component_id"))
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = own.join(whole, "component").join(degree, "node", "left").select(F.col("node").alias("of"), "component_id", "component", "n_links")
    out = sketches.join(nodes, sketches["node"] == nodes["of"], "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, but one row for each group of near-duplicates: that of the least id. Rows without words stay, repeated ones once."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    best = found.where("component is not null").groupBy("component").agg(first).select("first.k1", "first.k2")
    keys = best.union(found.where("component is null").select("k1", "k2").distinct())
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_row_key(plain, "doc_id", "text").join(keys, ["k1", "k2"]).select("k1", "k2", "row").dropDuplicates(["k1", "k2"]).select("row.*")

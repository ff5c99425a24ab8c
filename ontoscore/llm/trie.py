"""The prefix trie of conversations, built level by level, with what its nodes save when prefixes are stored once.

Every node is named by its depth and its least member. Live conversations, those that share their node with others, are grouped by
(node, next turn); the least member of a group names the child. A round takes a node down to where its members part for the first time:
up to there the levels are alike for all members (least and greatest next turn agree, none has ended), so they need no round each. A
conversation that is alone in its node leaves the rounds; the rest of it is one chain. So there are as many rounds as partings on one
path, whatever the length of conversations. What a node and its run of only children have in common is kept as one stretch; then
stretches are rolled up in reverse order of the rounds, by joins of each round with the sums of the next, and laid out as nodes.

Turns are known by 128 bits of the SHA-256 of role and text. Places in conversations are counted by ranges, so that one conversation may
hold any share of the rows; joins by node are salted by the number of its members. Between rounds everything is written to shared storage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import discard, materialise, ranked

#: Members of a node that one task joins; turns of a conversation that one task joins; bits of an id's place in a run of ids hashed at once.
MEMBERS = 50_000
TURNS = 1 << 20
RUN = 15
#: Conversations of one block of ids begin with turns of its first, as many as the id's checksum says, below FEW.
BLOCK, FEW = 100, 6
EMPTY = hashlib.sha256(b"").hexdigest()


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def places(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), k1, k2 (the turn), size (code points of its text), before (code points of earlier texts of the conversation).

    Turns are ordered by turn, null first, then by role and text; null role or text counts as empty; repeated rows are turns of their
    own. Rows without conv_id belong to no conversation and take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    kept = {"k1": _half(digest, 1), "k2": _half(digest, 17), "size": F.char_length("text").cast("long")}
    return ranked(rows, ["conv_id"], ["turn", "role", "text"], kept, "pos", {"size": "before"})


def rebuilt(own: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """Rebuilt conversations: conv_id, length, d (from 0, the place before the first turn), k1, k2, size, total (code points up to d).

    The first h turns of the block's first conversation (all if it has fewer, none if it is absent), then the conversation's own turns
    after its first h. h: crc32 of the decimal id, modulo `few`.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(few)).cast("long")
    convs = own.withColumn("h", h).groupBy("conv_id", "h").agg(F.count("*").alias("n"), F.sum(F.when(F.col("pos") <= F.col("h"), F.col("size")).otherwise(0)).alias("skipped"))
    turn = F.struct("pos", "k1", "k2", "size", "before")
    heads = own.where((F.col("pos") < few) & (F.col("conv_id") % block == 0)).groupBy(F.col("conv_id").alias("first_id")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % block).join(heads, "first_id", "left")
    none = F.array().cast("array<struct<pos:long,k1:long,k2:long,size:long,before:long>>")
    convs = convs.withColumn("head", F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), 1, F.greatest(F.lit(1), F.col("h")).cast("int"))).otherwise(none))
    convs = convs.withColumn("m", F.size("head").cast("long")).withColumn("length", F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = convs.withColumn("shift", F.aggregate("head", F.lit(0).cast("long"), lambda s, t: s + t["size"]) - F.col("skipped"))
    root = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("before")))
    first = convs.select("conv_id", "length", F.explode(F.concat(root, "head")).alias("t")).select(
        "conv_id", "length", F.col("t.pos").alias("d"), "t.k1", "t.k2", "t.size", (F.col("t.before") + F.col("t.size")).alias("total")
    )
    rest = _along(own, "pos", convs.select("conv_id", "h", "m", "shift", "length", "n"), "h", "n").where(F.col("pos") > F.col("h"))
    rest = rest.select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("m")).alias("d"), "k1", "k2", "size", (F.col("before") + F.col("size") + F.col("shift")).alias("total"))
    return first.union(rest)


def _along(turns: DataFrame, place: str, stretches: DataFrame, lo: str, hi: str) -> DataFrame:
    """turns joined with what holds from place lo to hi of their conversation; a long conversation goes to as many tasks as it fills."""
    part = lambda c: F.floor(F.col(c) / TURNS).cast("int")
    parted = stretches.withColumn("part", F.explode(F.sequence(part(lo), part(hi))))
    return turns.withColumn("part", part(place)).join(parted, ["conv_id", "part"]).drop("part")


def _by_node(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows joined with their node's row in groups; a node of many members goes to as many tasks as its members fill."""
    shares = (F.floor(F.col("n") / MEMBERS) + 1).cast("int")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("conv_id", "d"), shares).cast("int")).drop("n").join(salted, ["node", "salt"]).drop("salt")


def _big(n: int | Column) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("decimal(38,0)")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of rebuilt conversations (see rebuilt()); result as in prefix_trie(). Runs jobs for each round."""
    spark = turns.sparkSession
    least, count = turns.where("d = 0").agg(F.min("conv_id"), F.count("*")).first()
    if not count:
        return spark.createDataFrame([], NODES)
    groups = spark.createDataFrame([(least, 0, count, None)], "node long, top long, n long, parent long")
    live = turns.select("conv_id", "length", "d", "k1", "k2", "total", F.lit(least).cast("long").alias("node"), F.lit(count).cast("long").alias("n"))
    written: list[DataFrame] = []
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []  # stretches, their last levels, chains of lone conversations below them
    passing: list[DataFrame] = []

    def kept(df: DataFrame, name: str, where: list[DataFrame] = written) -> DataFrame:
        where.append(materialise(df, name))
        return where[-1]

    while not groups.isEmpty():
        alike = (F.min("k1") == F.max("k1")) & (F.min("k2") == F.max("k2")) & (F.count("*") == F.first("n"))
        levels = live.groupBy("node", "d").agg(alike.alias("alike"))
        cuts = levels.groupBy("node").agg(F.min(F.when(~F.col("alike"), F.col("d"))).alias("cut"), F.max("d").alias("last"))
        stretches = kept(groups.join(cuts, "node").select("node", "top", "n", "parent", (F.coalesce(F.col("cut"), F.col("last") + 1) - 1).alias("bottom")), "stretches")
        if rounds:
            below = _by_node(live, stretches.select("node", "n", "bottom"))
        else:  # the root alone
            below = live.withColumn("bottom", F.lit(stretches.first()["bottom"]).cast("long"))
        below = materialise(below.where("d >= bottom"), "below")
        discard(*passing)
        passing = [below]
        tails = kept(below.where("d = bottom AND (length = bottom OR conv_id = node)").select("node", "bottom", "conv_id", "length", "total"), "tails")
        step = below.where("d = bottom + 1")
        children = kept(step.groupBy("node", "bottom", "k1", "k2").agg(F.min("conv_id").alias("child"), F.count("*").alias("m"), F.max("length").alias("length")), "children")
        lone = children.where("m = 1").select(F.col("child").alias("node"), (F.col("bottom") + 1).alias("top"), F.col("node").alias("parent"), F.col("length").alias("bottom"))
        rounds.append((stretches, tails, lone))
        shared = children.where("m > 1").select("node", "k1", "k2", "child", "m", "bottom")
        groups = shared.select(F.col("child").alias("node"), (F.col("bottom") + 1).alias("top"), F.col("m").alias("n"), F.col("node").alias("parent"))
        moved = step.select("conv_id", "node", "k1", "k2", "length", "d").join(shared.drop("bottom"), ["node", "k1", "k2"])
        moved = moved.select("conv_id", F.col("child").alias("node"), F.col("m").alias("n"), F.col("d").alias("lo"), F.col("length").alias("hi"))
        live = _along(below.where("d > bottom").select("conv_id", "length", "d", "k1", "k2", "total"), "d", moved, "lo", "hi").drop("lo", "hi")
        live = kept(live, "live", passing)
    discard(*passing)

    # in reverse: leaves and savings of what hangs on the last level of each stretch; `to` is the code points up to there
    sums, done = None, []
    for stretches, tails, lone in reversed(rounds):
        hung = lone.select(F.col("parent").alias("node"), (F.col("top") - 1).alias("bottom"), F.lit(1).cast("long").alias("leaves"), _big(0).alias("part"), _big(0).alias("weight"))
        if sums is not None:
            hung = hung.union(sums)
        hung = hung.groupBy("node", "bottom").agg(F.count("*").alias("children"), F.sum("leaves").alias("leaves"), _big(F.sum("part")).alias("part"), _big(F.sum("weight")).alias("weight"))
        x = stretches.join(hung, ["node", "bottom"], "left").join(tails.where("conv_id = node").select("node", F.col("total").alias("to")), "node")
        below_it = _big(F.coalesce(F.col("part") - F.col("weight") * F.col("to"), F.lit(0)))
        x = x.select("node", "top", "bottom", "parent", "n", F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("leaves", F.lit(1)).alias("leaves"), below_it.alias("saved"), "to")
        x = kept(x, "rolled")
        done.append(x)
        weight = _big(F.col("n") - 1)
        sums = x.where(F.col("parent").isNotNull()).select(F.col("parent").alias("node"), (F.col("top") - 1).alias("bottom"), "leaves", _big(F.col("saved") + weight * F.col("to")).alias("part"), weight.alias("weight"))
    for _, _, lone in rounds:
        long = lambda x: F.lit(x).cast("long")
        done.append(lone.select("node", "top", "bottom", "parent", long(1).alias("n"), long(0).alias("children"), long(1).alias("leaves"), _big(0).alias("saved"), long(0).alias("to")))
    stretches, ended = done[0], rounds[0][1]
    for x in done[1:]:
        stretches = stretches.union(x)
    for _, tails, _ in rounds[1:]:
        ended = ended.union(tails)
    ended = ended.where("length = bottom").select("node", F.col("bottom").alias("depth"), "conv_id")
    result = materialise(_nodes(turns, stretches, ended).select(*NODES.replace(",", "").split()[::2]), "trie")
    discard(*written)
    return result


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _nodes(turns: DataFrame, stretches: DataFrame, ended: DataFrame) -> DataFrame:
    """Lays out stretches as nodes; every node is a place of its least member."""
    x = _along(turns.select("conv_id", "d", "size", "total"), "d", stretches.withColumnRenamed("node", "conv_id"), "top", "bottom").where("d BETWEEN top AND bottom")
    x = x.withColumnRenamed("conv_id", "node")
    last = F.col("d") == F.col("bottom")
    own = (F.col("n") - 1).cast("decimal(38,0)") * (F.col("to") - F.col("total") + F.col("size"))
    x = x.select(
        F.col("node").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top"), F.col("node")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.when(F.col("n") == 1, 0).otherwise(F.col("saved") + own).cast("long").alias("saved_tokens"),
        F.when(last & (F.col("n") == 1), F.sha2(F.col("node").cast("string"), 256)).alias("alone"),
    )
    hashes = ends(ended).withColumnRenamed("node", "conv_id")
    return x.join(hashes, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("alone", "ends_sha256", F.lit(EMPTY))).drop("alone")


def ends(members: DataFrame) -> DataFrame:
    """node, depth, ends_sha256: the hash of the node's conv_ids, ascending and joined by commas.

    Ids are joined in runs of 2**RUN consecutive numbers, each in a task of its own; one task then hashes a node's runs in order, as the
    hash demands, with one run in memory at a time.
    """
    runs = members.groupBy("node", "depth", F.shiftright("conv_id", RUN).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    runs = runs.select("node", "depth", "run", F.array_join(F.col("ids").cast("array<string>"), ",").alias("joined"))
    runs = runs.repartition("node", "depth").sortWithinPartitions("node", "depth", "run")
    return runs.mapInArrow(_hash_runs, "node long, depth long, ends_sha256 string")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, digest = None, None
    for batch in batches:
        out = []
        for node, depth, joined in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if (node, depth) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (node, depth), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(joined.as_py().encode())
        yield _batch(out)
    if now is not None:
        yield _batch([(*now, digest.hexdigest())])


def _batch(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], names=["node", "depth", "ends_sha256"])


def prefix_trie(conversations: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """The prefix trie of the rebuilt conversations (see rebuilt()), a row for each node: conv_id (least member), depth, parent_conv_id (null
    at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Two conversations share a node if their first turns agree in role and text, whatever the turns' numbers. Null role and text count as
    empty, texts are compared whole, ties in turn are ordered by role and text, repeated rows are turns of their own, rows with null
    conv_id take no part, columns beyond the four are ignored, and an empty table has no nodes. Ids below 0 belong to the block of their
    quotient rounded towards 0.
    """
    own = places(conversations.select("conv_id", "turn", "role", "text"))
    turns = materialise(rebuilt(own, block, few), "turns")
    discard(own)
    result = trie(turns)
    discard(turns)
    return result


#: The same in SQL, where prefixes are compared as lists.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(r := r, x := x) ORDER BY pos) AS l FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, l, xor(list_reduce(
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ord(substring(CAST(conv_id AS VARCHAR), CAST(i AS BIGINT), 1)) AS UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y // 2, (y % 2) * 3988292384)), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) % 6 AS h
  FROM o),
b AS (SELECT h.conv_id, list_concat(coalesce(f.l[1:CAST(h.h AS BIGINT)], []), h.l[CAST(h.h AS BIGINT) + 1:]) AS l FROM h LEFT JOIN o f ON f.conv_id = h.conv_id - h.conv_id % 100),
n AS (SELECT conv_id, unnest(range(0, len(l) + 1)) AS d, l FROM b),
p AS (SELECT conv_id, d, l, min(conv_id) OVER (PARTITION BY d, l[1:d]) AS node FROM n),
nodes AS (
  SELECT node, d, count(*) AS n, coalesce(max(length(l[d].x)), 0) AS size,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(l) = d), '') AS ends FROM p GROUP BY node, d),
k AS (SELECT p.node, p.d, count(*) AS n_children FROM nodes c JOIN p ON p.conv_id = c.node AND p.d = c.d - 1 GROUP BY p.node, p.d),
f AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN k USING (node, d)),
r AS (SELECT p.node, p.d, count(*) FILTER (WHERE f.n_children = 0) AS leaves, sum((f.n - 1) * f.size) AS saved FROM f JOIN p ON p.conv_id = f.node AND p.d <= f.d GROUP BY p.node, p.d)
SELECT f.node AS conv_id, f.d AS depth, p.node AS parent_conv_id, f.n AS n_convs, f.n_children, r.leaves AS n_leaves, CAST(r.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN r USING (node, d) LEFT JOIN p ON p.conv_id = f.node AND p.d = f.d - 1"""

"""Mixing sources to target weights by Pfair scheduling. DataFrame operations only.

A source of weight w of a total D gets its k-th block (from 0) released at floor(k * D / w), due at ceil((k + 1) * D / w). Earliest
deadline first among released blocks fills one slot after another; on one stream this meets all deadlines, so that after any number
of slots each source is less than one block from its share. The schedule repeats after D slots: one period is computed, with
the higher-order function `aggregate`, and every block takes its slot from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents in a block.
BLOCK = 8
#: Rows that one window partition should have; hot sources are split by leading hex digits of the shuffle key.
ROWS = 50_000
#: Slots of the schedule that one array gathers before it is put to the others.
CHUNK = 1000


def period(sources: DataFrame) -> DataFrame:
    """sources: source, weight (positive integers). Returns source, weight, total, turn (0 to weight - 1), slot, release, deadline.

    One period of the schedule. Ties go to the smaller source; a null source comes first. Sources of one weight have equal windows, so
    they take turns in order, and the choice of a slot is among the distinct weights, however many sources there are. One row holds a
    number for each source and slot of the period; slots are gathered CHUNK at a time, so the work is linear in them.
    """
    plain = sources.select("source", F.col("weight").cast("long").alias("weight"))
    # members of each class in order, with their places among all sources, which decide ties
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_first())).cast("long")
    member = (F.row_number().over(Window.partitionBy("weight").orderBy(F.col("source").asc_nulls_first())) - 1).cast("long")
    members = plain.withColumn("place", place).withColumn("member", member)
    classes = members.groupBy("weight").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("place")).alias("places"))
    one = classes.groupBy().agg(F.sort_array(F.collect_list(F.struct("weight", "n", "places"))).alias("c"), F.sum(F.col("weight") * F.col("n")).cast("long").alias("total")).where("total > 0")

    def step(given: Column, t: Column) -> Column:
        def due(i: Column) -> Column:
            x, total = F.get(F.col("c"), i), F.col("total")
            a = F.get(given, i)
            k = F.floor(a / x["n"])
            # a released block: its deadline and its source's place; others: null
            return F.when(F.floor(k * total / x["weight"]) <= t, F.struct(F.ceil((k + 1) * total / x["weight"]).alias("deadline"), F.get(x["places"], (a % x["n"]).cast("int")).alias("place"), i.alias("i")))

        return F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.size("c") - 1), due), lambda x: x.isNotNull()))["i"]

    def slot(acc: Column, t: Column) -> Column:
        # one expression for the choice, so that it is not worked out again for every class
        return F.element_at(
            F.transform(
                F.array(step(acc["given"], t)),
                lambda b: F.struct(
                    F.transform(acc["given"], lambda k, i: k + F.when(i == b, F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("given"),
                    F.concat(acc["order"], F.array(F.struct(b.alias("i"), F.get(acc["given"], b).alias("a")))).alias("order"),
                ),
            ),
            1,
        )

    none = F.array().cast("array<struct<i:int,a:bigint>>")

    def chunk(acc: Column, j: Column) -> Column:
        steps = F.sequence(j * CHUNK, F.least((j + 1) * CHUNK, F.col("total")) - 1)
        got = F.aggregate(steps, F.struct(acc["given"].alias("given"), none.alias("order")), slot)
        return F.element_at(F.transform(F.array(got), lambda g: F.struct(g["given"].alias("given"), F.concat(acc["chunks"], F.array(g["order"])).alias("chunks"))), 1)

    start = F.struct(F.transform("c", lambda x: F.lit(0).cast("long")).alias("given"), F.array().cast("array<array<struct<i:int,a:bigint>>>").alias("chunks"))
    chunks = F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / CHUNK)), start, chunk, lambda acc: acc["chunks"])
    dealt = one.select("c", "total", F.posexplode(chunks).alias("j", "part")).select("c", "total", "j", F.posexplode("part").alias("at", "x"))
    own = F.get("c", F.col("x.i"))
    slots = dealt.select((F.col("j").cast("long") * CHUNK + F.col("at")).alias("slot"), "total", own["weight"].alias("of"), (F.col("x.a") % own["n"]).alias("m"), F.floor(F.col("x.a") / own["n"]).alias("turn"))
    slots = slots.join(members, (F.col("of") == F.col("weight")) & (F.col("m") == F.col("member"))).select("source", "weight", "total", "turn", "slot")
    return slots.withColumn("release", F.floor(F.col("turn") * F.col("total") / F.col("weight"))).withColumn("deadline", F.ceil((F.col("turn") + 1) * F.col("total") / F.col("weight")))


def ranked(df: DataFrame, group: str, key: str, ties: list[str], rows: int = ROWS) -> DataFrame:
    """df with rank (from 0) of each row in its group by `key` (lower-case hex), then ties; groups of any size are split by the key's first digits."""
    most = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while 16**digits * rows < most:
        digits += 1
    head = F.substring(key, 1, digits) if digits else F.lit("")
    split = df.withColumn("head", head)
    sizes = split.groupBy(group, "head").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(group).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(group).alias("group_"), F.col("head").alias("head_"), before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(group, "head").orderBy(key, *ties)) - 1
    numbered = split.withColumn("inside", inside)
    joined = numbered.join(offsets, F.col(group).eqNullSafe(F.col("group_")) & (F.col("head") == F.col("head_")))
    return joined.withColumn("rank", (F.col("before") + F.col("inside")).cast("long")).drop("head", "head_", "group_", "before", "inside", "size")


def mix(docs: DataFrame, weights: dict[str, int], default: int = 1, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK) -> DataFrame:
    """The rows of docs (all its columns) with the schedule: source_block, slot, release, deadline, position, in_ratio.

    Each source's rows are shuffled by the md5 of their id, then cut into blocks of `block` rows; block k takes the slot of its turn.
    weights: positive integers by source; other sources, the null one too, get `default`. Every row is kept. position orders all rows
    by slot, then rank in the block. in_ratio: the slot comes before any source has run out, so shares hold up to there; later the
    slots of exhausted sources stay empty. Rows with equal ids and null ids are ordered by their other columns; rows that are equal
    in all are interchangeable. Long texts move with their rows and are not looked at. An empty table gives an empty result. Columns of docs with a name used here give way to the schedule's.
    """
    made = ["source_block", "slot", "release", "deadline", "position", "in_ratio"]
    docs = docs.drop(*[c for c in docs.columns if c in made])
    columns = docs.columns
    # columns keep apart, so that those a caller does not select are not moved; ties are broken by all but the text
    kinds = {c: docs.schema[c].dataType.simpleString() for c in columns}
    ties = [f"mix_{i}" for i, c in enumerate(columns) if c not in (source_col, "text") and not kinds[c].startswith(("map", "variant"))]
    own = [F.col(f"`{c}`").alias(f"mix_{i}") for i, c in enumerate(columns)]
    rows = docs.select(*own, F.col(source_col).cast("string").alias("mix_source"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("mix_key"))
    rows = ranked(rows, "mix_source", "mix_key", ties).withColumn("source_block", F.floor(F.col("rank") / block))
    listed = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, w)]) if weights else F.lit(None).cast("map<string,int>")
    weight = F.coalesce(F.try_element_at(listed, F.coalesce("source", F.lit(""))), F.lit(default))
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")).withColumn("weight", weight)
    plan = period(counts)
    # the first slot at which a source has no block left
    ends = counts.withColumn("blocks", F.ceil(F.col("n") / block)).join(plan.select(F.col("source").alias("of"), "total", "turn", F.col("slot").alias("at"), F.col("weight").alias("w")), F.col("source").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("blocks") % F.col("w")))
    last = ends.agg(F.min(F.floor(F.col("blocks") / F.col("w")) * F.col("total") + F.col("at")).alias("first_end")).select("first_end")
    plan = plan.select(F.col("source").alias("plan_source"), F.col("weight").alias("w"), "total", F.col("turn").alias("plan_turn"), F.col("slot").alias("at"), F.col("release").alias("r"), F.col("deadline").alias("d"))
    rows = rows.withColumn("w", weight_of(weights, default)).withColumn("plan_turn", F.col("source_block") % F.col("w"))
    joined = rows.drop("w").join(plan, F.col("mix_source").eqNullSafe(F.col("plan_source")) & (rows["plan_turn"] == plan["plan_turn"]))
    cycle = F.floor(F.col("source_block") / F.col("w")) * F.col("total")
    joined = joined.select(*[f"mix_{i}" for i in range(len(columns))], "source_block", (cycle + F.col("at")).alias("slot"), (cycle + F.col("r")).alias("release"), (cycle + F.col("d")).alias("deadline"), ((cycle + F.col("at")) * block + F.col("rank") % block).alias("position"))
    first_end = last.first()
    bound = first_end[0] if first_end and first_end[0] is not None else 0
    return joined.select(*[F.col(f"mix_{i}").alias(c) for i, c in enumerate(columns)], "source_block", "slot", "release", "deadline", "position", (F.col("slot") < bound).alias("in_ratio"))


def weight_of(weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default)
    listed = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, w)])
    return F.coalesce(F.try_element_at(listed, F.coalesce("mix_source", F.lit(""))), F.lit(default))


def mix_sql(weights: dict[str, int], default: int, block: int, columns: str = "doc_id, source") -> str:
    """DuckDB SQL for mix() over `documents`, with `columns` and the schedule."""
    case = " ".join(f"WHEN '{k}' THEN {w}" for k, w in sorted(weights.items()))
    return f"""
WITH RECURSIVE src AS (
  SELECT source AS source_, count(*) AS n, CAST(CASE source {case} ELSE {default} END AS BIGINT) AS w FROM documents GROUP BY source),
numbered AS (SELECT *, row_number() OVER (ORDER BY source_ NULLS FIRST) AS i, sum(w) OVER () AS total FROM src),
cfg AS (SELECT list(w ORDER BY i) AS ws, CAST(max(total) AS BIGINT) AS total, count(*) AS m FROM numbered),
sched AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS pick, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS given FROM cfg
  UNION ALL
  SELECT slot + 1, b, list_transform(given, lambda k, j: k + CASE WHEN j = b THEN 1 ELSE 0 END) FROM (
    SELECT slot, given, CAST(list_min(list_filter(list_transform(given, lambda k, j:
      CASE WHEN (k * total) // ws[j] <= slot + 1 THEN {{'d': ((k + 1) * total + ws[j] - 1) // ws[j], 'j': CAST(j AS BIGINT)}} END), lambda x: x IS NOT NULL)).j AS BIGINT) AS b
    FROM sched, cfg WHERE slot + 1 < total)),
plan AS (
  SELECT n.source_, n.w, CAST(n.total AS BIGINT) AS total, s.slot AS at, row_number() OVER (PARTITION BY n.i ORDER BY s.slot) - 1 AS turn
  FROM sched s JOIN numbered n ON n.i = s.pick WHERE s.slot >= 0),
ends AS (
  SELECT min((((n.n + {block - 1}) // {block}) // n.w) * p.total + p.at) AS first_end
  FROM numbered n JOIN plan p ON n.source_ IS NOT DISTINCT FROM p.source_ AND p.turn = ((n.n + {block - 1}) // {block}) % n.w),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(coalesce(CAST(doc_id AS VARCHAR), '') AS VARCHAR)), doc_id NULLS FIRST, lang NULLS FIRST, n_chars NULLS FIRST) - 1 AS rank FROM documents)
SELECT {columns}, CAST(r.rank // {block} AS BIGINT) AS source_block,
  CAST(((r.rank // {block}) // p.w) * p.total + p.at AS BIGINT) AS slot,
  CAST(((r.rank // {block}) // p.w) * p.total + (p.turn * p.total) // p.w AS BIGINT) AS release,
  CAST(((r.rank // {block}) // p.w) * p.total + ((p.turn + 1) * p.total + p.w - 1) // p.w AS BIGINT) AS deadline,
  CAST((((r.rank // {block}) // p.w) * p.total + p.at) * {block} + r.rank % {block} AS BIGINT) AS position,
  ((r.rank // {block}) // p.w) * p.total + p.at < (SELECT first_end FROM ends) AS in_ratio
FROM ranked r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source_ AND p.turn = (r.rank // {block}) % p.w"""

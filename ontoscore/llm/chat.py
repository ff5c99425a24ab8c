"""Tool-call linking for chat data. DataFrame operations only.

Calls and results are joined by identifier, calls are ordered topologically by the call they depend on, arguments are validated
against the schema of their tool, and each call with its result becomes one line of canonical JSON (sorted keys, no spaces).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ontoscore.llm.common import materialise

#: Argument types of a tool: field -> (type, required). Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]

KINDS = {"string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY.*", "object": "^OBJECT.*"}


def _path(field: str) -> str:
    return "$['" + field.replace("\\", "\\\\").replace("'", "\\'") + "']"


def problems(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """What is wrong with a call's arguments (JSON text), in order: one of 'unknown tool', 'not an object', or 'missing f', 'type of f', 'unexpected f'."""
    v = F.try_parse_json(arguments)
    whole = F.schema_of_variant(v)
    found = F.when(tool.isNull() | ~tool.isin(*schemas), F.array(F.lit("unknown tool"))) if schemas else F.when(F.lit(True), F.array(F.lit("unknown tool")))
    found = found.when(v.isNull() | ~whole.startswith("OBJECT"), F.array(F.lit("not an object")))
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required) in sorted(fields.items()):
            got = F.schema_of_variant(F.try_variant_get(v, _path(field), "variant"))
            missing = F.when(got.isNull(), F.lit(f"missing {field}") if required else F.lit(None).cast("string"))
            checks.append(missing.when(~got.rlike(KINDS[kind]), F.lit(f"type of {field}")))
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*[F.lit(f) for f in fields]).cast("array<string>"))), lambda x: F.concat(F.lit("unexpected "), x))
        checks_ = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
        found = found.when(tool == name, F.concat(checks_, extra))
    return found


def canonical(text: Column) -> Column:
    """JSON text with sorted keys and without spaces; null for text that is not JSON."""
    return F.to_json(F.try_parse_json(text))


def levels(calls: DataFrame) -> DataFrame:
    """calls: id (distinct), parent. Returns id, level: 0 for calls whose parent is null or unknown, else one more than the parent's; -1 on or below a cycle.

    Pointer doubling: every round doubles the distance of the known ancestor, so a chain of n calls takes log2(n) rounds.
    """
    ids = calls.select(F.col("id").alias("known"))
    # calls that name no parent are done at once and meet in no task
    done = calls.where("parent is null").select("id", F.lit(None).cast("string").alias("ancestor"), F.lit(0).cast("long").alias("steps"))
    first = calls.where("parent is not null").select("id", "parent").join(ids, F.col("parent") == F.col("known"), "left")
    at = materialise(first.select("id", F.col("known").alias("ancestor"), F.when(F.col("known").isNull(), 0).otherwise(1).cast("long").alias("steps")), "levels")
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        done, at = done.unionByName(at.where("ancestor is null")), at.where("ancestor is not null")
        if at.isEmpty():
            break
        up = done.unionByName(at).select(F.col("id").alias("up_id"), F.col("ancestor").alias("up_ancestor"), F.col("steps").alias("up_steps"))
        at = materialise(at.join(up, F.col("ancestor") == F.col("up_id"), "left").select("id", F.col("up_ancestor").alias("ancestor"), (F.col("steps") + F.coalesce("up_steps", F.lit(0))).alias("steps")), "levels")
    return done.unionByName(at).select("id", F.when(F.col("ancestor").isNull(), F.col("steps")).otherwise(F.lit(-1)).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per row of calls, and one per id of results that no call has.

    calls: conv_id, id, parent, tool, arguments (JSON text); results: id, seq, content. Returns conv_id, call_id, level, status, problems,
    n_results, json. status: ok, invalid (arguments), unanswered, orphan (a result without a call), cycle. Of several results for an
    id the first by seq, then content, is linked; n_results counts all. Rows that repeat an id are all kept and linked alike; their
    parent is the least one given. A null id is linked with nothing; a result with a null id is an orphan each. Arguments that are
    not JSON appear as null. Long contents stay whole. Empty tables give an empty result. Other columns are ignored.
    """
    calls, results = calls.select("conv_id", "id", "parent", "tool", "arguments"), results.select("id", "seq", "content")
    answer = results.where("id is not null").groupBy("id").agg(F.min(F.struct("seq", "content")).alias("first"), F.count("*").alias("n_results")).select(F.col("id").alias("result_id"), F.col("first.content").alias("content"), "n_results")
    distinct = calls.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent"))
    level = levels(distinct).select(F.col("id").alias("level_id"), "level")
    named = calls.where("id is not null").join(answer, F.col("id") == F.col("result_id"), "full").join(level, F.coalesce("id", "result_id") == F.col("level_id"), "left")
    joined = named.unionByName(calls.where("id is null"), allowMissingColumns=True)  # nameless calls meet in no task
    joined = joined.withColumn("own", F.col("result_id").isNull() | F.col("id").isNotNull())
    wrong = F.when(F.col("own"), problems(F.col("tool"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    orphans = results.where("id is null").select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("level"), F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("problems"), F.lit(1).cast("long").alias("n_results"), _json(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("content")).alias("json"))
    checked = joined.withColumn("problems", wrong)
    status = F.when(~F.col("own"), "orphan").when(F.col("level") < 0, "cycle").when(F.size("problems") > 0, "invalid").when(F.col("result_id").isNull(), "unanswered").otherwise("ok")
    out = checked.select(F.col("conv_id").cast("long"), F.coalesce("id", "result_id").alias("call_id"), F.coalesce("level", F.when(F.col("own"), F.lit(0))).cast("long").alias("level"), status.alias("status"), "problems", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), _json(F.coalesce("id", "result_id"), F.col("tool"), F.col("arguments"), F.col("content")).alias("json"))
    return out.unionByName(orphans)


def _json(call_id: Column, tool: Column, arguments: Column, content: Column) -> Column:
    """Canonical JSON with the keys arguments, content, id, tool; an absent value is null."""
    text = lambda c: F.coalesce(F.to_json(c.cast("variant")), F.lit("null"))
    return F.concat(F.lit('{"arguments":'), F.coalesce(canonical(arguments), F.lit("null")), F.lit(',"content":'), text(content), F.lit(',"id":'), text(call_id), F.lit(',"tool":'), text(tool), F.lit("}"))


def calls_of(conversations: DataFrame) -> DataFrame:
    """The calls of plain conversations: each turn that is not the assistant's asks its role's tool, and builds on the one two turns before."""
    key = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    arguments = F.to_json(F.struct(F.length("text").alias("n_chars"), F.col("text"), F.col("turn")), {"ignoreNullFields": "true"})
    return conversations.where("role is null or role <> 'assistant'").select("conv_id", key(F.col("turn")).alias("id"), F.when(F.col("turn") >= 2, key(F.col("turn") - 2)).alias("parent"), F.col("role").alias("tool"), arguments.alias("arguments"))


def results_of(conversations: DataFrame) -> DataFrame:
    """The results: each turn of the assistant answers the turn before."""
    return conversations.where("role = 'assistant'").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") - 1).cast("string")).alias("id"), F.col("turn").alias("seq"), F.col("text").alias("content"))

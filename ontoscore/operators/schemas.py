"""JSON Schemas for requests, made and checked by column expressions: one schema for each response, from its own features and banks.

A schema is built as nested structs, whose fields stand in the alphabet's order and vanish where they are null, so `to_json` writes it
in canonical form. Checks walk the schema as a variant, level by level, and give violation rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ontoscore.fixed import CAUSAL_ROLES, DISPOSITIONS, OUTPUT_KEYS, RELATION_VERSION, RELATIONS, STANCES, STATUSES

# What a claim that is not affirmed may say, groups that need no evidence, the lengths of strings, and the least evidence.
NEUTRAL_ROLES = ["background", "unclear"]
NO_EVIDENCE_GROUPS = ["accuracy"]
CONFIDENCES = ["low", "medium", "high"]
FACT_STATUSES = ["supported", "contradicted", "mixed", "unclear", "not_applicable", "not_assessable"]
EVIDENCE_LENGTH, ACTOR_LENGTH, CLAIM_LENGTH = 220, 40, 160
LEAST_UNION, LEAST_BANKS = 10, 3
NO_TARGET = "none"
# End of fixed values.

DENIED = [s for s in STATUSES if s != "true"]
OTHER_DISPOSITIONS = [d for d in DISPOSITIONS if d != "instantiated"]
RELATION_VALUES = sorted({v for values in RELATIONS.values() for v in values})
FEATURE = "struct<feature_id:string,feature_group:string,opportunity_class:string,bank:array<string>>"


def _object(**fields: Column) -> Column:
    """An object; what is null is left out."""
    return F.struct(*[fields[k].alias(k) for k in sorted(fields)])


def _strings(values: list[str] | Column) -> Column:
    return F.array(*map(F.lit, values)) if isinstance(values, list) else values


def _one_of(values: list[str] | Column, kind: str = "string") -> Column:
    return _object(enum=_strings(values), type=F.lit(kind))


def _array(items: Column, least: Column, most: Column | int) -> Column:
    return _object(items=items, maxItems=F.lit(most) if isinstance(most, int) else most, minItems=least, type=F.lit("array"))


def _complete(**properties: Column) -> dict[str, Column]:
    """The parts of an object schema that asks for all its properties and allows no others."""
    return {"additionalProperties": F.lit(False), "properties": _object(**properties), "required": _strings(list(properties)), "type": F.lit("object")}


def _evidence(bank: Column, length: int, asked: Column) -> Column:
    """At most one span of the bank, none if it is empty; one where it is asked for."""
    some = F.size(bank) > 0
    return _array(F.when(some, _object(enum=bank, maxLength=F.lit(length), type=F.lit("string"))), F.when(some & asked, F.lit(1)), F.when(some, 1).otherwise(0))


def _claim(f: Column, i: Column, affirmed: bool, length: int, actor: int) -> dict[str, Column]:
    none = F.lit(None).cast("int")
    asked = ~f["feature_group"].isin(NO_EVIDENCE_GROUPS) if affirmed else F.lit(False)
    return _complete(
        claim_index=_object(enum=F.array(i), type=F.lit("integer")),
        feature_group=_one_of(F.array(f["feature_group"])),
        feature_id=_one_of(F.array(f["feature_id"])),
        opportunity_class=_one_of(F.array(f["opportunity_class"])),
        status=_one_of(["true"] if affirmed else DENIED),
        disposition=_one_of(["instantiated"] if affirmed else OTHER_DISPOSITIONS),
        stance=_one_of(STANCES),
        causal_role=_one_of(CAUSAL_ROLES if affirmed else NEUTRAL_ROLES),
        actor_or_relation=_array(_object(maxLength=F.lit(actor), type=F.lit("string")), none, 2),
        evidence=_evidence(f["bank"], length, asked),
        complete_proposition_evidence=_object(type=F.lit("boolean")),
        confidence=_one_of(CONFIDENCES),
    )


def claims(features: Column, length: int = EVIDENCE_LENGTH, actor: int = ACTOR_LENGTH) -> Column:
    """JSON text of the schema of the claims: one place for each feature, pinned to it.

    A claim is affirmed, with evidence from the feature's bank, or it is not, with neutral roles. Without a bank a feature cannot be
    affirmed, but for the groups that need no evidence.
    """

    def item(f: Column, i: Column) -> Column:
        f = F.struct(*[f[c].alias(c) for c in ("feature_id", "feature_group", "opportunity_class")], F.coalesce(f["bank"], F.array().cast("array<string>")).alias("bank"))
        denied = _claim(f, i, False, length, actor)
        alone = (F.size(f["bank"]) == 0) & ~f["feature_group"].isin(NO_EVIDENCE_GROUPS)
        both = F.when(~alone, F.array(_object(**_claim(f, i, True, length, actor)), _object(**denied)))
        return _object(anyOf=both, **{k: F.when(alone, v) for k, v in denied.items()})

    n = F.size(features)
    return F.to_json(_object(items=F.lit(False), maxItems=n, minItems=n, prefixItems=F.transform(features, item), type=F.lit("array")))


def relations(union: Column, length: int = EVIDENCE_LENGTH) -> Column:
    """JSON text of the schema of the relations: as many as there are types."""
    none, n = F.lit(None).cast("int"), len(RELATIONS)
    indices = _array(_object(minimum=F.lit(0), type=F.lit("integer")), none, 3)
    span = _object(enum=F.when(F.size(union) > 0, union), maxLength=F.lit(length), type=F.lit("string"))
    one = _complete(
        relation_registry_version=_one_of([RELATION_VERSION]),
        relation_type=_one_of(list(RELATIONS)),
        relation_value=_one_of(RELATION_VALUES),
        source_claim_indices=indices,
        target_claim_indices=indices,
        evidence=_array(span, none, 1),
        confidence=_one_of(CONFIDENCES),
    )
    return F.to_json(_array(_object(**one), F.lit(n), n))


def facts(packets: Column, union: Column, length: int = EVIDENCE_LENGTH) -> Column:
    """JSON text of the schema of the factual assessments: one for each packet, none without packets."""
    none = F.lit(None).cast("int")
    span = _object(enum=F.when(F.size(union) > 0, union), maxLength=F.lit(length), type=F.lit("string"))
    one = _complete(
        factual_target_version_id=_one_of(F.transform(packets, lambda p: p["factual_target_version_id"])),
        factual_target_id=_one_of(F.transform(packets, lambda p: p["factual_target_id"])),
        status=_one_of(FACT_STATUSES),
        claim_text=_object(maxLength=F.lit(CLAIM_LENGTH), type=_strings(["string", "null"])),
        evidence=_array(span, none, 1),
        confidence=_one_of(CONFIDENCES),
    )
    n = F.size(packets)
    return F.to_json(_array(F.when(n > 0, _object(**one)), F.when(n > 0, n), n))


def quoted(text: Column) -> Column:
    """A string as JSON text; null is null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNull(), F.lit("null")).otherwise(listed.substr(F.lit(2), F.length(listed) - 2))


def _text_of(entries: Column, keys: Column) -> Column:
    """JSON text of a map from keys to JSON texts, in the alphabet's order."""
    pairs = F.transform(F.array_sort(keys), lambda k: F.concat(quoted(k), F.lit(":"), F.element_at(entries, k)))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _members(variant: Column) -> Column:
    """The members of a variant's object as JSON texts; an empty map for anything else."""
    found = F.transform_values(variant.try_cast("map<string,variant>"), lambda _, v: F.to_json(v))
    return F.coalesce(found, F.create_map().cast("map<string,string>"))


def with_schema(requests: DataFrame, least_union: int = LEAST_UNION, least_banks: int = LEAST_BANKS) -> DataFrame:
    """requests: custom_id, features (FEATURE), union_bank (array), packets (structs factual_target_id, factual_target_version_id), and
    base (JSON text of the schema that the request came with, or null). Adds schema_json (canonical) and schema_error.

    The schema keeps what `base` says, each const as an enum of one, but for claims, relations and factual assessments, which are made
    anew, and asks for all keys of an output. schema_error is set where the evidence is too thin to judge (fewer spans in the union or
    fewer features with a bank than asked for) or a packet lacks its target or version; the schema is made all the same.
    """
    none = F.array().cast("array<string>")
    x = enumerated(requests, "base", "_base")
    x = x.withColumns({"_union": F.coalesce("union_bank", none), "_packets": F.coalesce("packets", F.array().cast("array<struct<factual_target_id:string,factual_target_version_id:string>>"))})
    top = _members(F.try_parse_json("_base"))
    made = F.create_map(F.lit("claims"), claims(F.col("features")), F.lit("relations"), relations(F.col("_union")), F.lit("factual_assessments"), facts(F.col("_packets"), F.col("_union")))
    own = F.map_filter(_members(F.try_parse_json(F.element_at("_top", "properties"))), lambda k, _: ~k.isin("claims", "relations", "factual_assessments"))
    asked = F.coalesce(F.from_json(F.element_at("_top", "required"), "array<string>"), none)
    asked = F.array_union(asked, _strings(OUTPUT_KEYS))
    x = x.withColumn("_top", top).withColumn("_properties", F.map_concat(own, made))
    parts = F.create_map(
        F.lit("additionalProperties"), F.lit("false"), F.lit("properties"), _text_of(F.col("_properties"), F.map_keys("_properties")), F.lit("required"), F.to_json(asked),
        F.lit("type"), F.coalesce(F.element_at("_top", "type"), F.lit('"object"')),
    )
    x = x.withColumn("_parts", F.map_concat(F.map_filter("_top", lambda k, _: ~k.isin("additionalProperties", "properties", "required", "type")), parts))
    banked = F.size(F.filter("features", lambda f: F.coalesce(F.size(f["bank"]), F.lit(0)) > 0))
    error = (
        F.when(F.exists("_packets", lambda p: p["factual_target_id"].isNull() | (p["factual_target_id"] == NO_TARGET)), "packet without a target")
        .when(F.exists("_packets", lambda p: p["factual_target_version_id"].isNull()), "packet without a version")
        .when(F.size("_union") < least_union, F.concat(F.lit("too few spans: "), F.size("_union")))
        .when(banked < least_banks, F.concat(F.lit("too few banks: "), banked))
    )
    return x.select(*requests.columns, _text_of(F.col("_parts"), F.map_keys("_parts")).alias("schema_json"), error.alias("schema_error"))


# ---------------------------------------------------------------- const to enum

#: Stand for an escaped backslash and quote while JSON text is cut; they cannot stand in JSON text themselves.
SLASH, QUOTE = "\x01", "\x02"
TOKEN = r'"[^"]*+"(?:\s*+:)?|[\[\]{},]|[^\s\[\]{},:"]++'


def enumerated(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with JSON text in which every `"const": x` of `column` says `"enum": [x]`, x as it is, whatever it holds; compact.

    Equal texts are rewritten once. A text is cut into tokens; a const's value ends at the next token of the const's own depth. Null or
    invalid JSON gives null.
    """
    key = F.sha2(column, 256)
    texts = rows.where(F.try_parse_json(column).isNotNull()).select(key.alias("_key"), column).dropDuplicates(["_key"])
    plain = F.replace(F.replace(F.col(column), F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))
    t = texts.select("_key", F.posexplode(F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    t = t.withColumn("token", F.when(F.col("token").endswith(":"), F.regexp_replace("token", r'"\s+:$', '":')).otherwise(F.col("token")))
    order = Window.partitionBy("_key").orderBy("pos")
    step = F.when(F.col("token").isin("{", "["), 1).when(F.col("token").isin("}", "]"), -1).otherwise(0)
    t = t.withColumn("depth", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("end", F.when(F.col("token") == '"const":', F.lead("pos").over(Window.partitionBy("_key", "depth").orderBy("pos"))))
    outer = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("end", F.when(F.coalesce(outer, F.lit(-1)) < F.col("pos"), F.col("end")))
    here = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) == F.col("pos")
    said = F.when(F.col("end").isNotNull(), F.lit('"enum":[')).otherwise(F.concat("token", F.when(here, F.lit("]")).otherwise(F.lit(""))))
    t = t.select("_key", F.struct("pos", said.alias("said")).alias("s"))
    out = t.groupBy("_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["said"]), "").alias(name))
    out = out.withColumn(name, F.replace(F.replace(F.col(name), F.lit(QUOTE), F.lit('\\"')), F.lit(SLASH), F.lit("\\\\")))
    return rows.withColumn("_key", key).join(out, "_key", "left").drop("_key")


# ---------------------------------------------------------------- checks


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<string>"), F.array().cast("array<string>"))


def _branches(checked: DataFrame) -> DataFrame:
    """custom_id, i (place of the claim), b (place in its alternatives, null for a claim without), n_branches, branch (variant)."""
    items = checked.select("custom_id", "features", F.posexplode(F.try_variant_get("_s", "$.properties.claims.prefixItems", "array<variant>")).alias("i", "item"))
    several = F.try_variant_get("item", "$.anyOf", "array<variant>")
    items = items.select("custom_id", "i", F.try_element_at("features", F.col("i") + 1).alias("feature"), several.isNotNull().alias("several"), F.coalesce(several, F.array("item")).alias("branches"))
    return items.select("custom_id", "i", "feature", "several", F.size("branches").alias("n_branches"), F.posexplode("branches").alias("b", "branch"))


def schema_violations(requests: DataFrame) -> DataFrame:
    """custom_id, place (of the claim, or null), message: what is wrong with each request's schema. No rows for a sound one.

    requests: custom_id, schema_json, features, packets, as with_schema() has them.
    """
    x = requests.withColumn("_s", F.try_parse_json("schema_json"))
    n, n_packets = F.size("features"), F.coalesce(F.size("packets"), F.lit(0))
    of = lambda path, kind: F.try_variant_get("_s", f"$.properties.{path}", kind)
    pinned = lambda path, size: of(f"{path}.minItems", "int").eqNullSafe(size) & of(f"{path}.maxItems", "int").eqNullSafe(size)
    whole = {
        "no schema": F.col("_s").isNull(),
        "number of claims is not pinned": ~pinned("claims", n),
        "claims are not a tuple of the features": ~F.size(of("claims.prefixItems", "array<variant>")).eqNullSafe(n),
        "further claims are allowed": ~F.coalesce(of("claims.items", "boolean") == F.lit(False), F.lit(False)),
        "number of relations is not pinned": ~pinned("relations", F.lit(len(RELATIONS))),
        "facts without packets": (n_packets == 0) & ~of("factual_assessments.maxItems", "int").eqNullSafe(F.lit(0)),
    }
    found = F.array(*[F.when(F.col("_s").isNotNull() & bad if m != "no schema" else bad, F.lit(m)) for m, bad in whole.items()])
    top = x.select("custom_id", F.lit(None).cast("int").alias("place"), F.explode(F.array_compact(found)).alias("message"))

    listed = lambda path: _list(F.col("branch"), f"$.properties.{path}")
    there = lambda path: F.try_variant_get("branch", f"$.properties.{path}", "variant").isNotNull()
    first, second, alone = F.col("several") & (F.col("b") == 0), F.col("several") & (F.col("b") == 1), ~F.col("several")
    each = {
        "not two alternatives": F.col("several") & (F.col("n_branches") != 2) & (F.col("b") == 0),
        "first alternative is not the affirmed one": first & (listed("status.enum") != F.array(F.lit("true"))),
        "second alternative allows other roles": second & (F.size(F.array_except(listed("causal_role.enum"), _strings(NEUTRAL_ROLES))) > 0),
        "only alternative is not the denied one": alone & (listed("status.enum") != _strings(DENIED)),
        "feature is not pinned": ~listed("feature_id.enum").eqNullSafe(F.array(F.col("feature.feature_id"))),
        "index is not pinned": ~listed("claim_index.enum").eqNullSafe(F.array(F.col("i").cast("string"))),
        "object is not complete": ~(there("status") & there("causal_role") & there("evidence")),
        "evidence is neither empty nor listed": there("evidence") & ~F.try_variant_get("branch", "$.properties.evidence.maxItems", "int").eqNullSafe(F.lit(0)) & (F.size(listed("evidence.items.enum")) == 0),
    }
    found = F.array(*[F.when(bad, F.lit(m)) for m, bad in each.items()])
    claims_ = _branches(x).select("custom_id", F.col("i").alias("place"), F.explode(F.array_compact(found)).alias("message"))
    return top.union(claims_)

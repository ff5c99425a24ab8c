"""Canonical JSON, digests and name-based identifiers."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The namespace of URLs for name-based identifiers (RFC 9562).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def canonical(value: object) -> str:
    """Sorted keys, no spaces, no ASCII escapes; NaN is refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@F.pandas_udf(StringType())
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical form of JSON text; null for text that isn't JSON."""

    def one(text: str) -> str | None:
        try:
            return canonical(json.loads(text))
        except ValueError:
            return None

    for s in texts:
        yield s.map(one, na_action="ignore")


def sha256_text(text: Column) -> Column:
    return F.sha2(text, 256)


def json_hash(text: Column, without: str | None = None) -> Column:
    """SHA-256 of canonical JSON, one top-level key left out if named."""
    return F.sha2(canonical_json(_without(text, F.lit(without)) if without else text), 256)


@F.pandas_udf(StringType())
def _without(texts: pd.Series, keys: pd.Series) -> pd.Series:
    out = []
    for text, key in zip(texts, keys, strict=True):
        value = json.loads(text) if text is not None else None
        out.append(None if value is None else json.dumps({k: v for k, v in value.items() if k != key}))
    return pd.Series(out)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Name-based identifier of version 5 (SHA-1)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    digit = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(digit, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def content_hash(*parts: Column) -> Column:
    """SHA-256 over parts joined by the unit separator, null as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def is_sha256(col: Column) -> Column:
    return col.rlike("^[0-9a-f]{64}$")


@dataclass(frozen=True)
class RunManifest:
    """What one run used and made."""

    run_id: str
    created_at: str
    code_version: str
    configuration_sha256: str
    input_sha256: dict = field(default_factory=dict)
    output_sha256: dict = field(default_factory=dict)
    schema_version: str = "judge_output_v0.5.0"
    rubric_version: str = "hm_v0.5.0"
    seed: int | None = None
    n_rows: int = 0
    host: str = ""
    notes: str = ""
    status: str = "complete"


def configuration_hash(configuration: dict) -> str:
    return hashlib.sha256(canonical(configuration).encode()).hexdigest()


def write_manifest(spark: SparkSession, manifest: RunManifest, path: str) -> None:
    """Writes one row; fails if the path exists."""
    spark.createDataFrame([(canonical(asdict(manifest)),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def compare_hashes(found: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """key, found, recorded, state (same, differs, new, gone)."""
    a = found.select(F.col(key), F.col("sha256").alias("found"))
    b = recorded.select(F.col(key), F.col("sha256").alias("recorded"))
    state = F.when(F.col("recorded").isNull(), "new").when(F.col("found").isNull(), "gone").when(F.col("found") == F.col("recorded"), "same").otherwise("differs")
    return a.join(b, key, "full").withColumn("state", state)

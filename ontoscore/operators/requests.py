"""Requests to a judge: opportunity packets, rendered prompts and calls, all from data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniq_classes(primary: Column, secondary: Column, monitor: Column) -> Column:
    """One array of structs (feature_id, opportunity_class), each feature once, in order, with its strongest class."""
    p = F.array_distinct(primary)
    s = F.array_except(F.array_distinct(secondary), p)
    m = F.array_except(F.array_except(F.array_distinct(monitor), p), s)
    of = lambda a, cls: F.transform(a, lambda f: F.struct(f.alias("feature_id"), F.lit(cls).alias("opportunity_class")))
    return F.concat(of(p, "primary"), of(s, "secondary_afforded"), of(m, "monitor_only"))


def packets(families: DataFrame) -> DataFrame:
    """families: item_family_id, primary, secondary, monitor (arrays of ids). One row per planned feature with its place in the packet."""
    rows = families.select("item_family_id", F.posexplode(uniq_classes(F.col("primary"), F.col("secondary"), F.col("monitor"))).alias("i", "f"))
    return rows.select("item_family_id", "i", "f.feature_id", "f.opportunity_class")


def render(rows: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """rows with prompt: the template's {name} places filled from columns, other than text as canonical JSON."""
    prompt = F.lit(template)
    kinds = dict(rows.dtypes)
    for c in columns:
        value = F.col(c) if kinds[c] == "string" else F.to_json(F.col(c).cast("variant")) if kinds[c] != "variant" else F.to_json(c)
        prompt = F.replace(prompt, F.lit("{" + c + "}"), F.coalesce(value, F.lit("")))
    return rows.withColumn("prompt", prompt)


def family_packets(families: DataFrame, targets: DataFrame, packets: DataFrame) -> DataFrame:
    """The packets of each family's targets: item_family_id, factual_target_id, packet, error.

    families: item_family_id; targets: item_family_id, factual_target_id (a registry); packets: factual_target_id, packet. A family
    without targets and a target without a packet appear once each, with their error.
    """
    known = families.select("item_family_id").distinct().join(targets.select("item_family_id", "factual_target_id").distinct(), "item_family_id", "left")
    found = known.join(packets.select("factual_target_id", "packet"), "factual_target_id", "left")
    error = F.when(F.col("factual_target_id").isNull(), "family has no targets").when(F.col("packet").isNull(), "target has no packet")
    return found.select("item_family_id", "factual_target_id", "packet", error.alias("error"))


def compact_prompt(prompt: Column, blocks: dict[str, Column]) -> Column:
    """A prompt with the text between each <name> and </name> replaced, trailing blanks cut and empty lines joined."""
    for name, value in blocks.items():
        kept = F.regexp_replace(F.coalesce(value, F.lit("")), r"([\\$])", r"\\$1")
        prompt = F.regexp_replace(prompt, F.lit(f"(?s)<{name}>.*?</{name}>"), F.concat(F.lit(f"<{name}>\n"), kept, F.lit(f"\n</{name}>")))
    return F.regexp_replace(F.regexp_replace(prompt, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n")


@dataclass(frozen=True)
class Retry:
    """When a call is tried again. Waits are seconds: base * attempt, or base * 2 ** (attempt - 1) if doubling."""

    attempts: int = 3
    base: float = 2.0
    doubling: bool = False
    #: Only transport errors and statuses of 500 and more are tried again; else every failure is.
    server_only: bool = False

    def wait(self, attempt: int) -> float:
        return self.base * (2 ** (attempt - 1) if self.doubling else attempt)

    def again(self, error: Exception) -> bool:
        status = getattr(error, "status", None)
        return not self.server_only or isinstance(error, OSError) and status is None or (status is not None and status >= 500)


class Truncated(Exception):
    """The model stopped for want of room; its answer cannot be used."""


#: The policies of the two kinds of call: to the judge, to the generator.
JUDGE, GENERATOR = Retry(attempts=3, base=2.0), Retry(attempts=4, base=1.0, doubling=True, server_only=True)
ASKED = "id string, output string, ok boolean, truncated boolean, attempts int, waited double, latency_ms long, error string"


def ask(requests: DataFrame, model: Callable[..., str | tuple[str, str]], concurrency: int = 4, retry: Retry = Retry(attempts=1), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests: id, prompt. Calls the host's model on each, at most `concurrency` at a time: id, output, ok, truncated, attempts, waited, latency_ms, error.

    The model takes a prompt and gives text, or text and a finish reason; 'length' is a failure (its text is kept). An exception is a
    failure too; its `status`, where it has one, is that of HTTP. latency_ms is that of the last attempt.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, p in zip(b["id"], b["prompt"], strict=True):
                waited, output, error, cut = 0.0, None, None, False
                for attempt in range(1, retry.attempts + 1):
                    began = time.perf_counter()
                    try:
                        got = model(p)
                        output, reason = got if isinstance(got, tuple) else (got, "stop")
                        cut = reason == "length"
                        if cut:
                            raise Truncated("the answer was cut off")
                        error = None
                    except Exception as e:
                        error = e
                    latency = milliseconds(time.perf_counter() - began)
                    if error is None or attempt == retry.attempts or not retry.again(error):
                        break
                    waited += retry.wait(attempt)
                    sleep(retry.wait(attempt))
                rows.append((i, output, error is None, cut, attempt, waited, latency, None if error is None else f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["id", "output", "ok", "truncated", "attempts", "waited", "latency_ms", "error"])

    return requests.select("id", "prompt").repartition(concurrency).mapInPandas(run, ASKED)


def milliseconds(seconds: float) -> int:
    return round(seconds * 1000)


def latency(began: Column, ended: Column) -> Column:
    """Milliseconds between two timestamps, rounded."""
    return F.round((F.unix_micros(ended) - F.unix_micros(began)) / 1000).cast("long")


def iso_utc(at: Column, micros: bool = False) -> Column:
    """A timestamp as ISO 8601 in UTC, to the second or microsecond; the session's time zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss" + (".SSSSSS" if micros else "") + "'Z'")


def report_metrics(claims: DataFrame, relations: DataFrame, responses: DataFrame, banks: DataFrame, absent: list[str]) -> DataFrame:
    """By response: n_claims, n_true, exact_ok, exact_bad (evidence in the response or not), fs_ok, fs_bad (in the feature's bank or not, accuracy apart), bad_causal, nonabsent.

    claims: response_id, feature_id, feature_group, status, causal_role, evidence; banks: response_id, feature_id, bank.
    """
    spans = F.filter(F.coalesce("evidence", F.array().cast("array<string>")), lambda s: s != "")
    good_ = F.size(F.filter(spans, lambda s: F.coalesce(F.contains(F.col("text"), s), F.lit(False))))
    # texts, then banks go to the claims by response, so claims move once and no text is taken along
    x = claims.join(responses.select("response_id", "text"), "response_id", "left").select("response_id", "feature_id", "feature_group", "status", "causal_role", spans.alias("spans"), good_.alias("good"))
    of_response = banks.groupBy("response_id").agg(F.collect_list(F.struct("feature_id", "bank")).alias("banks"))
    mine = F.transform(F.filter("banks", lambda b: b["feature_id"] == F.col("feature_id")), lambda b: b["bank"])
    x = x.join(of_response, "response_id", "left").select("response_id", "feature_group", "status", "causal_role", "spans", "good", F.explode_outer(mine).alias("bank"))
    good, every = F.col("good"), F.size("spans")
    own = F.when(F.col("feature_group") == "accuracy", 0).otherwise(F.size(F.filter("spans", lambda s: F.coalesce(F.array_contains("bank", s), F.lit(False)))))
    counted = x.groupBy("response_id").agg(
        F.count("*").alias("n_claims"), F.count_if(F.col("status") == "true").alias("n_true"), F.sum(good).alias("exact_ok"), F.sum(every - good).alias("exact_bad"),
        F.sum(own).alias("fs_ok"), F.sum(F.when(F.col("feature_group") == "accuracy", 0).otherwise(every - own)).alias("fs_bad"),
        F.count_if((F.col("causal_role") == "cause") & ~F.col("status").eqNullSafe(F.lit("true"))).alias("bad_causal"),
    )
    there = relations.groupBy("response_id").agg(F.count_if(~F.col("relation_value").isin(absent)).alias("nonabsent"))
    return counted.join(there, "response_id", "left").withColumn("nonabsent", F.coalesce("nonabsent", F.lit(0).cast("long")))

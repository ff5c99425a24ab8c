"""Requests put together while the results of their jobs arrive: a stateful stream that can be stopped and started again.

The state of a request is what its row needs and no more: the last claim of each index, the last relation of each type, the facts, the
first semantic assessment, and what failed. It does not grow with attempts. Whenever results arrive the request's row is given anew, with
the number of results that it stands on as its version; the row of the highest version equals that of the batch reduction over all
results. A request that lacks jobs when event time has passed its last result by the waiting time is given once more, as late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ontoscore.fixed import RELATIONS

#: What arrives: `at` is event time, `payload` the job's claims, relation, fact or semantic assessment as JSON text, n_expected the request's jobs.
RESULT = "line_no long, custom_id string, job_id string, job_type string, index string, ok boolean, error string, payload string, n_expected long, at timestamp"
REDUCED = "custom_id string, version long, n_ok long, complete boolean, late boolean, claims string, relations string, facts string, semantic string, failed string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Assembly(StatefulProcessor):
    """wait: milliseconds of event time after which a request without all its jobs is late.

    Every call to the state goes to the JVM and back, so a request's state is one value: it is read once and written once for each batch
    that has results of it, however many these are.
    """

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # parts: {slot: [line_no, body]} as JSON text; done: the ids of good jobs as JSON text; timer: when it is due, 0 for none
        self.request = handle.getValueState("request", "version long, n_ok long, n_expected long, last long, timer long, parts string, done string")

    def put(self, parts: dict, slot: str, line: int, body: str, last: bool = True) -> None:
        """Keeps the body of the highest line (last) or the lowest; of one line the one that is put last."""
        if slot in parts:
            known = parts[slot][0]
            if (known > line) if last else (known <= line):
                return
        parts[slot] = [line, body]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, n_ok, expected, last, timer, parts, done = self.request.get() or (0, 0, 0, 0, 0, "{}", "[]")
        parts, done = json.loads(parts), dict.fromkeys(json.loads(done))
        for r in rows:
            version += 1
            expected, last = r.n_expected, max(last, int(r.at.timestamp() * 1000))
            if not r.ok:
                self.put(parts, f"failed:{r.line_no:020d}", r.line_no, json.dumps({"job_id": r.job_id, "error": r.error}, ensure_ascii=False))
                continue
            n_ok += 1
            done[r.job_id] = None
            body = json.loads(r.payload) if r.payload else None
            if r.job_type in ("feature", "feature_group"):
                for c in body or []:
                    if c.get("claim_index") is not None:
                        self.put(parts, f"claim:{c['claim_index']:010d}", r.line_no, json.dumps(c, ensure_ascii=False, sort_keys=True))
            elif r.job_type == "relation" and body:
                self.put(parts, f"relation:{body['relation_type']}", r.line_no, json.dumps(body, ensure_ascii=False, sort_keys=True))
            elif r.job_type == "factual" and body:
                self.put(parts, f"fact:{r.line_no:020d}", r.line_no, json.dumps(body, ensure_ascii=False, sort_keys=True))
            elif r.job_type == "semantic" and body:
                self.put(parts, "semantic", r.line_no, json.dumps(body, ensure_ascii=False, sort_keys=True), last=False)
        row = self.row(key[0], version, n_ok, len(done) >= expected, parts, False)
        due = 0 if row.complete else last + self.wait
        if timer and timer != due:
            self.handle.deleteTimer(timer)
        if due and timer != due:
            self.handle.registerTimer(due)
        self.request.update((version, n_ok, expected, last, due, json.dumps(parts), json.dumps(list(done))))
        yield row

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        version, n_ok, expected, last, _, parts, done = self.request.get()
        self.request.update((version, n_ok, expected, last, 0, parts, done))
        row = self.row(key[0], version, n_ok, len(json.loads(done)) >= expected, json.loads(parts), True)
        if not row.complete:
            yield row

    def row(self, custom_id: str, version: int, n_ok: int, complete: bool, parts: dict, late: bool) -> Row:
        of = lambda kind: [parts[s][1] for s in sorted(parts) if s.startswith(kind + ":")]
        listed = lambda bodies: "[" + ",".join(bodies) + "]"
        relations = [parts[f"relation:{t}"][1] for t in RELATIONS if f"relation:{t}" in parts]
        semantic = parts["semantic"][1] if "semantic" in parts else None
        return Row(custom_id=custom_id, version=version, n_ok=n_ok, complete=complete, late=late, claims=listed(of("claim")), relations=listed(relations), facts=listed(of("fact")), semantic=semantic, failed=listed(of("failed")))

    def close(self) -> None:
        pass


def assemble(results: DataFrame, wait: int = 3_600_000, late: str = "7 days") -> DataFrame:
    """A stream of RESULT as a stream of REDUCED: a row for each request that results arrived for, in each batch, and for each that is late.

    Results whose event time lies more than `late` before the latest one seen are left out, so choose it as long as a result may be under way.
    """
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return results.withWatermark("at", late).groupBy("custom_id").transformWithState(Assembly(wait), REDUCED, "Update", "EventTime")


def run(results: DataFrame, target: str, checkpoint: str, wait: int = 3_600_000, late: str = "7 days") -> StreamingQuery:
    """Puts together what has arrived since the last run with this checkpoint; a repeated batch replaces its own rows in the target."""
    from ontoscore.streaming.ingest import append_once

    rows = assemble(results, wait, late)
    return rows.writeStream.outputMode("update").foreachBatch(lambda df, batch: append_once(df, target, batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame) -> DataFrame:
    """The newest row of each request; late if any row of that version is."""
    columns: list[str | Column] = ["version", "late", "n_ok", "complete", "claims", "relations", "facts", "semantic", "failed"]
    return rows.groupBy("custom_id").agg(F.max(F.struct(*columns)).alias("r")).select("custom_id", "r.*")

"""Ledgers of calls as a stream: each event is accepted or refused by what its ledger has accepted before.

A ledger is bound once, reserves a call only when the one before has its receipt, numbers calls without gaps within
budgets by kind, and commits calls by windows: a builder's call first, then judging calls of which only the last
succeeds. It fails and is rebuilt, and is published in two steps, after which it is closed. An event that breaks a rule
is refused by the rule's name and changes nothing. A call without a receipt by its deadline, in event time, fails its
ledger by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Judging calls that may be tried again in a window.
RETRIES = 2
EVENT = "ledger string, event_id long, sequence long, kind string, call_id long, call_kind string, size long, ok boolean, sha256 string, at timestamp, ms long"
VERDICT = "ledger string, event_id long, kind string, verdict string"
_STATE = "sequence long, bound boolean, reserved long, received long, committed long, builder long, judge long, failed boolean, prepared string, published boolean"
#: With the calls that have a receipt and no window yet, and the open call's kind and deadline (null if there is no timer): one value, read and written once for a ledger's events of a batch.
_STORED = f"{_STATE}, kinds array<string>, oks array<boolean>, waiting string, deadline long"
_START = (-1, False, 0, 0, 0, 0, 0, False, "", False, [], [], None, None)
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
_VERDICT = Row(*[c.split()[0] for c in VERDICT.split(", ")])
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def refusal(state: dict, calls: list[tuple[str, bool]], event: dict, limits: dict[str, int]) -> str | None:
    """Why a ledger refuses an event. calls: kind and success of those that have a receipt and no window yet."""
    kind, open_calls = event["kind"], state["reserved"] - state["received"]
    if state["published"] or (state["failed"] and kind != "rebuilt"):
        return "closed"
    if event["sequence"] is None or event["sequence"] <= state["sequence"]:
        return "order"
    if kind == "bound":
        return "binding" if state["bound"] else None
    if not state["bound"]:
        return "unbound"
    uncommitted = state["reserved"] != state["committed"]
    if kind == "reserved":
        if state["prepared"] or open_calls or event["call_id"] != state["reserved"]:
            return "reservation"
        if event["size"] is None or event["size"] <= 0:
            return "request"
        return None if state.get(event["call_kind"], limits.get("", 0)) < limits.get(event["call_kind"], 0) else "budget"
    if kind == "received":
        return None if open_calls == 1 and event["call_id"] == state["received"] else "receipt"
    if kind == "window":
        whole = not open_calls and 1 <= len(calls) <= 2 + RETRIES and calls[0] == ("builder", True) and calls[-1][1]
        return None if whole and all(c == ("judge", False) for c in calls[1:-1]) and all(c[0] == "judge" for c in calls[1:]) else "window"
    if kind == "checkpoint":
        return "checkpoint" if uncommitted else None
    if kind == "failed":
        return None
    if kind == "rebuilt":
        return None if state["failed"] and not open_calls else "rebuild"
    if kind == "prepared":
        return "publication" if uncommitted or state["prepared"] or len(event["sha256"] or "") != 64 else None
    if kind == "published":
        return None if state["prepared"] and event["sha256"] == state["prepared"] else "publication"
    return "kind"


class Ledger(StatefulProcessor):
    def __init__(self, limits: dict[str, int], deadline_ms: int):
        self.limits, self.deadline_ms = limits, deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", _STORED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        *plain, kinds, oks, waiting, timer = self.state.get() or _START
        state, calls, deadline = dict(zip(_NAMES, plain, strict=True)), list(zip(kinds, oks, strict=True)), timer
        out = []
        for event in sorted(rows, key=lambda e: (e["event_id"] is None, e["event_id"] or 0)):
            why, kind = refusal(state, calls, event, self.limits), event["kind"]
            out.append(_VERDICT(key[0], event["event_id"], kind, why or "accepted"))
            if why:
                continue
            state["sequence"] = event["sequence"]
            if kind == "reserved":
                state["reserved"] += 1
                state[event["call_kind"]] += 1
                waiting, deadline = event["call_kind"], event["ms"] + self.deadline_ms
            elif kind == "received":
                state["received"] += 1
                calls.append((waiting, bool(event["ok"])))
                waiting = deadline = None
            elif kind in ("window", "rebuilt"):
                state["committed"], state["failed"], calls = state["reserved"], False, []
            elif kind == "failed":
                state["failed"] = True
            elif kind == "prepared":
                state["prepared"] = event["sha256"]
            elif kind in ("bound", "published"):
                state[kind] = True
        if state["failed"]:
            waiting = deadline = None
        if timer != deadline:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if deadline is not None:
                self.handle.registerTimer(deadline)
        self._keep(state, calls, waiting, deadline)
        yield from out

    def _keep(self, state: dict, calls: list, waiting: str | None, deadline: int | None) -> None:
        self.state.update((*[state[n] for n in _NAMES], [c[0] for c in calls], [c[1] for c in calls], waiting, deadline))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *plain, kinds, oks, _, _ = self.state.get()
        self._keep(dict(zip(_NAMES, plain, strict=True)) | {"failed": True}, list(zip(kinds, oks, strict=True)), None, None)
        yield _VERDICT(key[0], None, "deadline", "expired")


def judged(events: DataFrame, limits: dict[str, int], deadline_ms: int, delay: str = "0 seconds") -> DataFrame:
    """The verdict on each of a stream's events (EVENT; ms is `at` in milliseconds), and a row without an event for each deadline that has passed."""
    marked = events.withWatermark("at", delay)
    return marked.groupBy("ledger").transformWithState(Ledger(limits, deadline_ms), VERDICT, "Append", "EventTime")


def run(events: DataFrame, folder: str, limits: dict[str, int], deadline_ms: int) -> DataFrame:
    """Run a stream of events to its present end, and read all verdicts under folder. A batch that is run again replaces its own."""
    spark = events.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        query = (
            judged(events, limits, deadline_ms).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return verdicts(spark, folder)


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{VERDICT}, batch int").parquet(f"{folder}/verdicts").select(*[c.split()[0] for c in VERDICT.split(", ")])

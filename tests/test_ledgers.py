"""Ledgers: chained appends under budgets, and the stateful stream of calls."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscan.sources import chain, storage
from folioscan.streaming import calls

LIMITS = {"builder": 2, "judge": 3}


def payloads(spark, rows):
    return spark.createDataFrame(rows, "ledger string, ord long, payload string")


def test_chains_go_on_across_appends(spark, tmp_path):
    root = str(tmp_path / "chains")
    told = chain.append(payloads(spark, [("a", 2, "x2"), ("a", 1, "x1"), ("b", 1, "é")]), root)
    assert {tuple(r) for r in told.collect()} == {("a", 2, True), ("b", 1, True)}
    chain.append(payloads(spark, [("a", 3, "x3"), ("c", 0, "")]), root)
    lines = chain.read(spark, root)
    rows = {(r["ledger"], r["sequence"]): r for r in lines.collect()}
    assert sorted(rows) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)]
    assert rows["a", 1]["previous_sha256"] == rows["a", 0]["sha256"] == chain.digest(0, None, "x1") and rows["a", 2]["previous_sha256"] == rows["a", 1]["sha256"]
    assert chain.breaks(lines).count() == 0
    spoiled = lines.withColumn("payload", F.when((F.col("ledger") == "a") & (F.col("sequence") == 1), "y").otherwise(F.col("payload")))
    assert [tuple(r) for r in chain.breaks(spoiled).collect()] == [("a", 1)]
    assert {tuple(r) for r in chain.breaks(lines.filter("NOT (ledger = 'a' AND sequence = 1)")).collect()} == {("a", 2)}


def test_an_append_over_budget_is_refused_whole(spark, tmp_path):
    root, small = str(tmp_path / "chains"), chain.Budget(lines=3, ledger_bytes=20, line_bytes=8)
    chain.append(payloads(spark, [("a", i, "12345") for i in range(2)] + [("b", 0, "1")]), root, small)
    told = chain.append(payloads(spark, [("a", 2, "1"), ("a", 3, "1"), ("b", 1, "123456789"), ("c", 0, "12345678"), ("c", 1, "12345678"), ("c", 2, "12345"), ("d", 0, "ok")]), root, small)
    assert {(r["ledger"], r["accepted"]) for r in told.collect()} == {("a", False), ("b", False), ("c", False), ("d", True)}
    assert sorted((r["ledger"], r["sequence"]) for r in chain.read(spark, root).collect()) == [("a", 0), ("a", 1), ("b", 0), ("d", 0)]


def test_only_one_writer_commits(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "chains")
    chain.append(payloads(spark, [("a", 0, "first")]), root)
    monkeypatch.setattr(chain, "commits", lambda *a: [])  # a writer that read the heads before that
    with pytest.raises(chain.Taken):
        chain.append(payloads(spark, [("a", 0, "late")]), root)
    monkeypatch.undo()
    assert [r["payload"] for r in chain.read(spark, root).collect()] == ["first"]
    assert len(os.listdir(f"{root}/lines")) >= 2 and storage.exists(spark, f"{root}/commits/000000000.json")


START = dt.datetime(2024, 1, 1)


def course(*steps, ledger="l"):
    """Events from short notes: kind, call, and what else a step needs."""
    rows = []
    for i, (kind, *rest) in enumerate(steps):
        at = START + dt.timedelta(minutes=rest[2] if len(rest) > 2 else i)
        call, extra = (rest + [None, None])[:2]
        ms = int(at.replace(tzinfo=dt.UTC).timestamp() * 1000)
        rows.append((ledger, i, i, kind, call, extra if kind == "reserved" else None, 9, extra if kind == "received" else None, "f" * 64 if kind in ("prepared", "published") and extra is None else extra if kind in ("prepared", "published") else None, at, ms))
    return rows


def follow(spark, tmp_path, batches, deadline_ms=3_600_000):
    """Verdicts after each batch, each run of the stream starting anew from what the one before left."""
    folder, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, calls.EVENT).coalesce(1).write.mode("append").parquet(folder)
        found = calls.run(spark.readStream.schema(calls.EVENT).parquet(folder), str(tmp_path / "state"), LIMITS, deadline_ms)
        out.append(sorted((r["event_id"] if r["event_id"] is not None else -1, r["verdict"]) for r in found.collect()))
    return out


def test_a_regular_course_is_accepted_over_restarts(spark, tmp_path):
    steps = [("bound",), ("reserved", 0, "builder"), ("received", 0, True), ("reserved", 1, "judge"), ("received", 1, False), ("reserved", 2, "judge"), ("received", 2, True), ("window",), ("checkpoint",), ("prepared",), ("published",)]
    rows = course(*steps)
    first, second = follow(spark, tmp_path, [rows[:4], rows[4:]])
    assert first == [(i, "accepted") for i in range(4)] and second == [(i, "accepted") for i in range(len(steps))]


def test_breaches_are_refused_by_name(spark, tmp_path):
    cases = {
        "unbound": ([("reserved", 0, "builder")], 0), "binding": ([("bound",), ("bound",)], 1), "reservation": ([("bound",), ("reserved", 1, "builder")], 1), "kind": ([("bound",), ("other",)], 1),
        "budget": ([("bound",), *(s for i in range(3) for s in (("reserved", i, "builder"), ("received", i, True)))], 5), "receipt": ([("bound",), ("received", 0, True)], 1),
        "window": ([("bound",), ("reserved", 0, "builder"), ("received", 0, False), ("window",)], 3), "checkpoint": ([("bound",), ("reserved", 0, "builder"), ("checkpoint",)], 2),
        "closed": ([("bound",), ("failed",), ("checkpoint",)], 2), "rebuild": ([("bound",), ("rebuilt",)], 1), "publication": ([("bound",), ("prepared",), ("published", None, "0" * 64)], 2),
    }
    rows = [r for name, (steps, _) in cases.items() for r in course(*steps, ledger=name)]
    spark.createDataFrame(rows, calls.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = calls.run(spark.readStream.schema(calls.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "state"), LIMITS, 10**12).collect()
    for name, (steps, at) in cases.items():
        got = {r["event_id"]: r["verdict"] for r in found if r["ledger"] == name}
        assert got[at] == name and all(got[i] == "accepted" for i in range(at)), (name, got)
        assert len(got) == len(steps)


def test_late_receipts_fail_their_ledger(spark, tmp_path):
    slow = course(("bound",), ("reserved", 0, "builder", 1), ledger="slow")
    other = course(("bound", None, None, 200), ledger="other")
    late = [("slow", 2, 2, "received", 0, None, 9, True, None, START + dt.timedelta(minutes=201), 0), ("slow", 3, 3, "rebuilt", None, None, 9, None, None, START + dt.timedelta(minutes=202), 0)]
    first, second = follow(spark, tmp_path, [slow + other, late])
    assert first == [(-1, "expired"), (0, "accepted"), (0, "accepted"), (1, "accepted")]
    assert [v for i, v in second if i == 2] == ["closed"]


def test_a_ledger_is_read_and_written_once_for_a_batch(spark):
    told = []

    class Store:
        def get(self):
            told.append("get")

        def update(self, value):
            told.append("update")

    class Handle:
        def getValueState(self, name, schema):
            return Store()

        def registerTimer(self, at):
            told.append("timer")

    rows = course(("bound",), ("reserved", 0, "builder"), ("received", 0, True), ("reserved", 1, "judge"))
    events = [Row(*[c.split()[0] for c in calls.EVENT.split(", ")])(*r) for r in reversed(rows)]
    ledger = calls.Ledger(LIMITS, 1000)
    ledger.init(Handle())
    assert [(r["event_id"], r["verdict"]) for r in ledger.handleInputRows(("l",), iter(events), None)] == [(i, "accepted") for i in range(4)]
    assert told == ["get", "update", "timer"] or told == ["get", "timer", "update"]


def test_nulls_are_refused(spark, tmp_path):
    rows = course(("bound",), ("reserved", 0, "builder"))
    rows.append(("l", 2, None, "received", 0, None, 9, True, None, START, 0))
    rows += [r[:6] + (None,) + r[7:] for r in course(("bound",), ("reserved", 0, "builder"), ledger="m")]
    spark.createDataFrame(rows, calls.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = calls.run(spark.readStream.schema(calls.EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "state"), LIMITS, 10**12).collect()
    assert {(r["ledger"], r["event_id"]): r["verdict"] for r in found} == {("l", 0): "accepted", ("l", 1): "accepted", ("l", 2): "order", ("m", 0): "accepted", ("m", 1): "request"}

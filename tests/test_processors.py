"""Timers, typed state and restarts of the stateful streams, against the batch folds."""

from __future__ import annotations

import random

import pytest

from presswork.operators import state as S
from presswork.streaming import processors as P

LATE = "30 seconds"


def drained(stream, base, **trigger):
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(**trigger or {"availableNow": True}).start()
    assert q.awaitTermination(300)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out").collect()


@pytest.fixture
def log(spark, tmp_path):
    """Write rows as one more file of a folder, and the folder as a stream."""

    def add(rows, kind):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(kind).parquet(str(tmp_path / "in"))

    return add


SESSION = "sid string, seq long, at double, command string, item string"


def session_log(n, seed, begin=0.0):
    r = random.Random(seed)
    out, at = [], begin
    for i in range(n):
        at += r.choice([1, 5, 40])
        out.append((f"s{r.randint(0, 5)}", int(begin) + i, at, r.choice(["create", "view", "view", "expand", "collapse", "touch", "touch", "delete"] if i % 9 == 0 else ["create", "view", "expand", "touch"]), f"i{r.randint(0, 4)}"))
    return out


def told(r):
    return r.sid, r.seq, r.code, r.viewed, r.expanded


def test_sessions_equal_the_fold_and_end_by_themselves(spark, log, tmp_path):
    first, second = session_log(80, 1), session_log(80, 2, 5000.0)
    drained(P.sessions(log(first, SESSION), late=LATE, seconds=120), tmp_path)
    got = drained(P.sessions(log(second, SESSION), late=LATE, seconds=120), tmp_path)  # a restart from the checkpoint
    every = spark.createDataFrame(first + second, SESSION)
    want = S.folded(every, ["sid"], ["at", "seq"], lambda s, r: S.session_step(s, r, 120), "code int, viewed array<string>, expanded array<string>").collect()
    assert sorted(map(told, (r for r in got if r.seq is not None)), key=str) == sorted(map(told, want), key=str)
    ended = sorted((r.sid, r.at) for r in got if r.command == "expired")
    assert ended == sorted(ends_of(first + second, 120, max(r[2] for r in second) - 30))


def ends_of(rows, seconds, watermark):
    """When sessions ran out, by a plain loop."""
    ends, gone, out = {}, set(), []
    for sid, _, at, command, _ in sorted(rows, key=lambda r: r[2]):
        if sid in gone:
            continue
        live = ends.get(sid, 0) > at
        if sid in ends and not live:
            out.append((sid, ends.pop(sid)))
        if command == "create" or live:
            ends[sid] = at + seconds
        if live and command == "delete":
            gone.add(sid)
            del ends[sid]
    return out + [(s, e) for s, e in ends.items() if e <= watermark]


JOB = "job_id string, seq long, at double, command string, worker string"


def test_jobs_equal_the_fold_and_leases_end(spark, log, tmp_path):
    r = random.Random(4)
    first, at = [], 0.0
    for i in range(120):
        at += r.choice([2, 10, 45])
        first.append((f"j{r.randint(0, 9)}", i, at, r.choice(["claim", "claim", "heartbeat", "heartbeat", "cancel" if i % 11 == 0 else "heartbeat", "succeeded" if i % 7 == 0 else "claim"]), r.choice("ab")))
    first.append(("alone", 500, at, "claim", "a"))
    second = [("late", 1000, at + 5000, "claim", "a")]
    drained(P.jobs(log(first, JOB), late=LATE), tmp_path)
    got = drained(P.jobs(log(second, JOB), late=LATE), tmp_path)
    want = S.jobs(spark.createDataFrame(first + second, JOB)).collect()
    assert sorted((x.job_id, x.seq, x.status, x.outcome) for x in got if x.seq is not None) == sorted((x.job_id, x.seq, x.status, x.outcome) for x in want)
    assert sorted((x.at, x.command, x.status) for x in got if x.job_id == "alone" and x.seq is None) == [(at + 60, "lease_ended", "running"), (at + 1800, "deadline", "failed")]


def test_admissions_are_remembered_across_restarts_and_forgotten(spark, log, tmp_path):
    kind = "idempotency_key string, seq long, content_hash string, job_id string"
    first, second = [("k", 1, "h", "1"), ("k", 2, "h", "2"), ("m", 3, "x", "3")], [("k", 4, "other", "4"), ("k", 5, "h", "5")]
    drained(P.admissions(log(first, kind)), tmp_path, once=True)  # a stream with a time to live has no end of its own
    got = drained(P.admissions(log(second, kind)), tmp_path, once=True)
    want = S.admissions(spark.createDataFrame(first + second, kind)).collect()
    assert sorted((x.seq, x.outcome, x.admitted_job or "") for x in got) == sorted((x.seq, x.outcome, x.admitted_job or "") for x in want)
    drained(P.admissions(log([], kind), keep_ms=1), tmp_path / "short", once=True)
    again = drained(P.admissions(log([("k", 6, "new", "6")], kind), keep_ms=1), tmp_path / "short", once=True)
    assert {x.seq: x.outcome for x in again}[6] == "created"

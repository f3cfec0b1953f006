"""Commands with deadlines as stateful streams: typed state per key, timers, time to live.

The steps are those of operators.state, so a stream gives what the batch fold gives on the same log. What a key keeps
is typed: a value for its times and status, a list and a map for what it collects, of which only the part that
a batch changes is written. A session, a lease or a deadline that runs out is told by an event-time timer in a row of its
own (command ``expired``, ``lease_ended`` or ``deadline``), without a further command of the key; such a row comes once the watermark has passed
the time. Admissions instead are forgotten by a time to live (processing time, as the state store knows no other).

State is in the RocksDB store and the query's checkpoint; a restart goes on where the last committed batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import state as S

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timed(StatefulProcessor):
    """Commands of a key in order of their times (column at, seconds), and timers at the times that its state names."""

    names: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def load(self) -> dict:
        raise NotImplementedError

    def save(self, state: dict, before: dict) -> None:
        raise NotImplementedError

    def step(self, state: dict, row: dict) -> dict:
        raise NotImplementedError

    def times(self, state: dict) -> dict[str, float]:
        """What ends when."""
        raise NotImplementedError

    def end(self, what: str, state: dict) -> dict:
        """Change the state as ``what`` has ended, and the row's values."""
        raise NotImplementedError

    def copied(self, state: dict) -> dict:
        return {k: list(v) if isinstance(v, list) else v for k, v in state.items()}

    def settle(self, state: dict, before: dict) -> None:
        """Write what has changed, and set the timers anew if their times have."""
        if state == before:
            return
        self.save(state, before)
        due = {int(t * 1000) for t in self.times(state).values()}
        held = set(self.handle.listTimers())
        for t in held - due:
            self.handle.deleteTimer(t)
        for t in due - held:
            self.handle.registerTimer(t)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.load()
        before = self.copied(state)
        for row in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            told = row.asDict()
            yield from self.ended(key[0], state, told["at"])
            made = self.step(state, told)
            yield Row(key=key[0], seq=told["seq"], at=float(told["at"]), command=told["command"], **{n: made[n] for n in self.names})
        self.settle(state, before)

    def ended(self, key: str, state: dict, now: float) -> Iterator[Row]:
        """Rows of what has ended by now, in order: that a command of a batch comes after it is no reason not to tell it."""
        while due := min(((t, what) for what, t in self.times(state).items() if t <= now), default=None):
            made = self.end(due[1], state)
            yield Row(key=key, seq=None, at=float(due[0]), command=due[1], **{n: made[n] for n in self.names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.load()
        before = self.copied(state)
        yield from self.ended(key[0], state, (expiredTimerInfo.getExpiryTimeInMs() + 1) / 1000)
        self.settle(state, before)


class Sessions(Timed):
    """operators.state.sessions with an end of its own: value (ends, deleted), list of viewed items, map of expanded ones to their places."""

    names = ("code", "viewed", "expanded")
    out = "key string, seq long, at double, command string, code int, viewed array<string>, expanded array<string>"

    def __init__(self, seconds: int = S.SESSION_SECONDS) -> None:
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.life = handle.getValueState("life", "ends double, deleted boolean")
        self.viewed = handle.getListState("viewed", "item string")
        self.expanded = handle.getMapState("expanded", "item string", "place int")

    def load(self) -> dict:
        if not self.life.exists():
            return {}
        ends, deleted = self.life.get()
        if deleted:
            return {"deleted": True}
        order = sorted((place[0], item[0]) for item, place in self.expanded.iterator())
        return {"ends": ends, "viewed": [x[0] for x in self.viewed.get()], "expanded": [item for _, item in order]}

    def save(self, state: dict, before: dict) -> None:
        if not state:
            self.life.clear()
        else:
            self.life.update((state.get("ends"), bool(state.get("deleted"))))
        now, old = state.get("viewed", []), before.get("viewed", [])
        if now[: len(old)] == old and old:
            if len(now) > len(old):
                self.viewed.appendList([(x,) for x in now[len(old) :]])
        elif now:
            self.viewed.put([(x,) for x in now])
        else:
            self.viewed.clear()
        now, old = state.get("expanded", []), before.get("expanded", [])
        for x in set(old) - set(now):
            self.expanded.removeKey((x,))
        for place, x in enumerate(now):
            if old[place : place + 1] != [x]:
                self.expanded.updateValue((x,), (place,))

    def step(self, state: dict, row: dict) -> dict:
        return S.session_step(state, row, self.seconds)

    def times(self, state: dict) -> dict[str, float]:
        return {"expired": state["ends"]} if state.get("ends") and not state.get("deleted") else {}

    def end(self, what: str, state: dict) -> dict:
        state.clear()
        return {"code": 404, "viewed": None, "expanded": None}


class Jobs(Timed):
    """operators.state.jobs with leases and deadlines that end by themselves: one value."""

    names = ("status", "outcome")
    out = "key string, seq long, at double, command string, status string, outcome string"
    fields = ("status", "starts", "lease", "owner", "deadline")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.job = handle.getValueState("job", "status string, starts int, lease double, owner string, deadline double")

    def load(self) -> dict:
        return {k: v for k, v in zip(self.fields, self.job.get(), strict=True) if v is not None} if self.job.exists() else {}

    def save(self, state: dict, before: dict) -> None:
        self.job.update(tuple(float(state[k]) if k in ("lease", "deadline") and k in state else state.get(k) for k in self.fields))

    def step(self, state: dict, row: dict) -> dict:
        return S.job_step(state, row)

    def times(self, state: dict) -> dict[str, float]:
        if state.get("status") in S.TERMINAL:
            return {}
        return {what: state[k] for what, k in (("lease_ended", "lease"), ("deadline", "deadline")) if state.get(k)}

    def end(self, what: str, state: dict) -> dict:
        if what == "deadline":
            state["status"] = "failed"
        else:
            state["lease"] = 0.0
        return {"status": state["status"], "outcome": what}


class Admissions(StatefulProcessor):
    """operators.state.admissions that forget a key ``keep_ms`` after its first request."""

    out = "key string, seq long, outcome string, admitted_job string"

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "content_hash string, job_id string", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = {"first": tuple(self.first.get()), "told": True} if self.first.exists() else {}
        fresh = not state
        for row in sorted(rows, key=lambda r: r["seq"]):
            made = S.admission_step(state, row.asDict())
            yield Row(key=key[0], seq=row["seq"], **made)
        if fresh and state:
            self.first.update(state["first"])


def timed(commands: DataFrame, key: str, processor: Timed, late: str = "10 minutes") -> DataFrame:
    """Rows of processor.out: each command (key, seq, at in seconds and what its step reads) with its outcome, and what ended.

    Commands that come later than ``late`` after the newest are dropped, as Spark drops late rows.
    """
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = commands.withColumn(key, F.col(key).cast("string")).withColumn("at", F.col("at").cast("double")).withColumn("seq", F.col("seq").cast("long"))
    marked = keyed.withColumn("__time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("__time", late)
    return marked.groupBy(key).transformWithState(processor, processor.out, "Append", "EventTime").withColumnRenamed("key", key)


def sessions(commands: DataFrame, key: str = "sid", late: str = "10 minutes", seconds: int = S.SESSION_SECONDS) -> DataFrame:
    return timed(commands, key, Sessions(seconds), late)


def jobs(commands: DataFrame, key: str = "job_id", late: str = "10 minutes") -> DataFrame:
    return timed(commands, key, Jobs(), late)


def admissions(requests: DataFrame, key: str = "idempotency_key", keep_ms: int | None = 86_400_000) -> DataFrame:
    """idempotency_key, seq, outcome, admitted_job of requests (key, seq, content_hash, job_id).

    keep_ms None remembers for ever. With a time to live Spark runs batches without rows too, so the query has no end of its own.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    keyed = requests.withColumn(key, F.col(key).cast("string")).withColumn("seq", F.col("seq").cast("long")).withColumn("job_id", F.col("job_id").cast("string"))
    return keyed.groupBy(key).transformWithState(Admissions(keep_ms), Admissions.out, "Append", "ProcessingTime" if keep_ms is not None else "None").withColumnRenamed("key", key)

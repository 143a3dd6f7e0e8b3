"""Sliding-window limits by key: a log of the requests that were allowed."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: State stores that come with Spark, the one with timers and maps first.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IN_MEMORY = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


class WindowLog:
    """Times of the allowed requests of one key.

    A request is allowed if fewer than ``limit`` were within the window before
    it; one that is denied uses nothing up. ``inclusive`` drops entries that
    are exactly a window old, and lets requests of the same instant share one
    entry, as a sorted set of times does.
    """

    def __init__(self, limit: int, window: float, inclusive: bool = False, log: list[float] | None = None):
        self.limit, self.window, self.inclusive = limit, window, inclusive
        self.log = deque(log or [])

    def check(self, now: float) -> tuple[bool, int, float]:
        """(allowed, remaining, time at which the oldest entry leaves the window)."""
        cutoff = now - self.window
        while self.log and (self.log[0] < cutoff or self.inclusive and self.log[0] == cutoff):
            self.log.popleft()
        allowed = len(self.log) < self.limit
        if allowed and not (self.inclusive and self.log and self.log[-1] == now):
            self.log.append(now)
        return allowed, max(0, self.limit - len(self.log)), (self.log[0] if self.log else now) + self.window


def limit_batch(requests: DataFrame, key: str, ts: str, order: str, limit: int, window: float, inclusive: bool = False) -> DataFrame:
    """Adds allowed, remaining and reset (seconds) to requests, key by key in time order.

    The decision on a request depends on those before it, so a key's requests
    are run through in order. Rows are sorted by the exchange and stream
    through; a task holds the log of one key, ``limit`` times at most, however
    many requests the key has.
    """
    names = requests.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields) + ", allowed boolean, remaining int, reset double"
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    dealt = requests.withColumn("_s", seconds).repartition(key).sortWithinPartitions(key, "_s", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = object(), None
        for b in batches:
            out = []
            for k, s in zip(b[key], b["_s"]):
                k = None if pd.isna(k) else k  # requests without a key share a log
                if k != current:
                    current, log = k, WindowLog(limit, window, inclusive)
                out.append(log.check(s))
            yield b[names].assign(allowed=[o[0] for o in out], remaining=[o[1] for o in out], reset=[o[2] for o in out])

    return dealt.mapInPandas(run, schema)


def limit_stream(requests: DataFrame, key: str, ts: str, limit: int, window: float, inclusive: bool = False, late: str = "1 minute") -> DataFrame:
    """The same on a stream: the log of a key is its state. Rows of a micro-batch are taken in time order.

    State of a key is dropped when the watermark has passed its last request
    by the window; rows that come later than ``late`` are left out.
    """
    kind = requests.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = WindowLog(limit, window, inclusive, list(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values("_s", kind="stable")
        out = [log.check(s) for s in rows["_s"]]
        state.update((list(log.log),))
        state.setTimeoutTimestamp(max(int((rows["_s"].iloc[-1] + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "ts_s": rows["_s"].to_numpy(), "allowed": [o[0] for o in out], "remaining": [o[1] for o in out]})

    at = F.col(ts).cast("timestamp")
    rows = requests.select(F.col(key), at.alias("_ts"), (F.unix_micros(at) / 1e6).alias("_s")).withWatermark("_ts", late)
    return rows.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, ts_s double, allowed boolean, remaining int", "log array<double>", "append", "EventTimeTimeout")


#: Waiting requests of a key that stand in one entry of its state, and decided ones that are given out together.
TOGETHER = 4096


class _OrderedLog(StatefulProcessor):
    """Requests of a key wait together, or in slots of time if they are many; a timer decides the slots that the watermark has passed, in order."""

    def __init__(self, key: str, ts: str, order: str, kind: str, limit: int, window: float, inclusive: bool, slot_ms: int):
        self.names, self.kind, self.slot_ms = (key, ts, order), kind, slot_ms
        self.rule = (limit, window, inclusive)

    def init(self, handle) -> None:
        self.handle = handle
        self.near = handle.getValueState("near", f"at array<bigint>, number array<{self.kind}>, more boolean")
        self.far = handle.getMapState("far", "due bigint", f"at array<bigint>, number array<{self.kind}>")
        self.log = handle.getValueState("log", "times array<double>")

    def _waiting(self) -> tuple[list, list, bool]:
        """Times and numbers of the requests that wait together, and whether more of them stand in slots."""
        if not self.near.exists():
            return [], [], False
        at, number, more = self.near.get()
        return list(at), list(number), more

    def _slots(self, at: list, number: list) -> dict[int, list]:
        slots: dict[int, list] = {}
        for pair in zip(at, number):
            slots.setdefault((pair[0] // (self.slot_ms * 1000) + 1) * self.slot_ms, []).append(pair)
        return slots

    def handleInputRows(self, key, rows, timerValues):
        at, number, more = self._waiting()
        for chunk in rows:
            at += chunk["limit_us"].tolist()
            number += chunk["limit_order"].tolist()
            if len(at) > TOGETHER:
                for due, pairs in self._slots(at, number).items():
                    old_at, old_number = self.far.getValue((due,)) if self.far.containsKey((due,)) else ([], [])
                    self.far.updateValue((due,), (list(old_at) + [a for a, _ in pairs], list(old_number) + [n for _, n in pairs]))
                at, number, more = [], [], True
        self._keep(at, number, more, None)
        return iter(())

    def _frame(self, key, done: list[tuple]) -> pd.DataFrame:
        at, number, allowed, remaining, reset = zip(*done)
        return pd.DataFrame({
            self.names[0]: [key[0]] * len(done), self.names[1]: pd.to_datetime(list(at), unit="us", utc=True), self.names[2]: list(number),
            "allowed": list(allowed), "remaining": list(remaining), "reset": list(reset),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        log = WindowLog(*self.rule, log=self.log.get()[0] if self.log.exists() else None)
        at, number, more = self._waiting()
        slots = self._slots(at, number)
        far = {d for (d,) in self.far.keys()} if more else set()
        done: list[tuple] = []
        for due in sorted(d for d in far | set(slots) if d <= now):
            pairs = slots.pop(due, [])
            if due in far:
                pairs = pairs + list(zip(*self.far.getValue((due,))))
                self.far.removeKey((due,))
            done += [(a, n, *log.check(a / 1e6)) for a, n in sorted(pairs)]
            if len(done) >= TOGETHER:
                yield self._frame(key, done)
                done = []
        if done:
            yield self._frame(key, done)
        # Nothing that comes later is before the watermark, so a log wholly older than the window is of no more use.
        end = int((log.log[-1] + self.rule[1]) * 1000) + 1 if log.log and (log.log[-1] + self.rule[1]) * 1000 > now else None
        if end is not None:
            self.log.update((list(log.log),))
        else:
            self.log.clear()
        left = [pair for pairs in slots.values() for pair in pairs]
        self._keep([a for a, _ in left], [n for _, n in left], any(d > now for d in far), end)

    def _keep(self, at: list, number: list, more: bool, end: int | None) -> None:
        """What waits, and one live timer: the earliest slot that waits, else the end of the log's window."""
        if at or more:
            self.near.update((at, number, more))
        else:
            self.near.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = [(min(at) // (self.slot_ms * 1000) + 1) * self.slot_ms] if at else []
        due += [d for (d,) in self.far.keys()] if more else []
        if due:
            self.handle.registerTimer(min(due))
        elif end is not None:
            self.handle.registerTimer(end)


def limit_stream_ordered(requests: DataFrame, key: str, ts: str, order: str, limit: int, window: float, inclusive: bool = False, late: str = "1 minute", slot: float = 1.0) -> DataFrame:
    """``limit_batch`` on a stream, whatever the order in which requests arrive: (key, ts, order, allowed, remaining, reset).

    Requests wait until the watermark has passed their slot of ``slot`` seconds,
    which no other request can enter then, and are decided by time and order.
    So results do not depend on how the stream is cut into micro-batches; a
    request is answered ``late`` and a slot after it at most, those later than
    ``late`` are left out. A task holds one slot of one key, its log and at most
    TOGETHER of its requests beside a batch's, the rest stands in the state store, which has to be RocksDB
    (``use_state_store``); a key's state goes when its log has left the window.
    Requests without a key share a log; those without a time are left out.
    """
    kind, number = requests.schema[key].dataType.simpleString(), requests.schema[order].dataType.simpleString()
    at = F.col(ts).cast("timestamp")
    rows = requests.where(at.isNotNull()).select(F.col(key), F.col(order).alias("limit_order"), at.alias("limit_ts"), F.unix_micros(at).alias("limit_us")).withWatermark("limit_ts", late)
    return rows.groupBy(key).transformWithStateInPandas(
        _OrderedLog(key, ts, order, number, limit, window, inclusive, int(slot * 1000)),
        f"`{key}` {kind}, `{ts}` timestamp, `{order}` {number}, allowed boolean, remaining int, reset double", "Append", "EventTime",
    )


def use_state_store(spark: SparkSession, wanted: str = ROCKSDB) -> str:
    """Let the session's streams keep their state in a store, or in memory where its class cannot be loaded; returns which."""
    from py4j.protocol import Py4JJavaError

    try:
        spark._jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass(wanted)
        found = wanted
    except Py4JJavaError:
        found = IN_MEMORY
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", found)
    return found


def gaps(requests: DataFrame, key: str, ts: str, order: str, least: float) -> DataFrame:
    """Adds ``wait``: seconds that a request would be held back to keep ``least`` seconds from the one before it."""
    from pyspark.sql import Window

    s = F.unix_micros(F.col(ts).cast("timestamp"))
    before = F.lag(s).over(Window.partitionBy(key).orderBy(ts, order))
    return requests.withColumn("wait", F.greatest(F.lit(0.0), F.coalesce(F.lit(least) - (s - before) / 1e6, F.lit(0.0))))


def backoff(attempt: int, base: float = 1.0, most: float = 16.0) -> float:
    """Seconds before a further attempt."""
    return min(base * 2**attempt, most)

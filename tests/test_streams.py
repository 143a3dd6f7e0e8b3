"""Limits on streams whose rows come out of order, and robots files."""

import datetime as dt
import random
import time
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from quarrion.operators import robots
from quarrion.streaming import limits


def test_ordered_stream_is_the_batch_whatever_its_cuts(spark, tmp_path):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), start + dt.timedelta(seconds=rng.randrange(0, 300) * 2)) for i in range(500)]
    schema = "id long, who string, ts timestamp"
    e = spark.createDataFrame(rows, schema)
    folder = tmp_path / "e"
    for part in range(3):  # rows of all times in each file: ties and disorder across micro-batches
        e.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    for inclusive in (False, True):
        want = {r.id: (r.allowed, r.remaining) for r in limits.limit_batch(e, "who", "ts", "id", 3, 60.0, inclusive).collect()}
        apart = spark.newSession()
        assert limits.use_state_store(apart) == limits.ROCKSDB
        s = limits.limit_stream_ordered(apart.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)), "who", "ts", "id", 3, 60.0, inclusive, late="10 minutes", slot=30.0)
        out, state = str(tmp_path / f"o{inclusive}"), str(tmp_path / f"s{inclusive}")
        run = lambda: s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()  # noqa: B023, E731
        run()
        if not inclusive:  # a last row far ahead lets the watermark pass all others; state is taken up from the checkpoint
            apart.createDataFrame([(9999, "z", start + dt.timedelta(days=2))], schema).coalesce(1).write.mode("append").parquet(str(folder))
        run()
        got = {r.id: (r.allowed, r.remaining) for r in apart.read.parquet(out).collect()}
        assert got == want


def test_state_store_falls_back(spark):
    apart = spark.newSession()
    assert limits.use_state_store(apart, "no.such.Store") == limits.IN_MEMORY == apart.conf.get("spark.sql.streaming.stateStore.providerClass")


FILES = [
    "User-agent: *\nDisallow: /", "User-agent: bot\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /c", "", "Disallow: /x", "User-agent: *\nDisallow:\n", "User-agent: BOT\nUser-agent: z\nDisallow: /a%20b # why\nDisallow: *",
]


def test_robots_files_decide_as_read(spark):
    noon = dt.datetime(2024, 5, 1, 12)
    paths = ["", "/", "/a", "/a/b/c", "/c?x=1", "/a b", "/a%20b", "/x#f", "/é"]
    log = [(f"h{k}.org", noon, 200, t) for k, t in enumerate(FILES)] + [("no.org", noon, 403, None), ("gone.org", noon, 404, None), ("down.org", noon, None, None), ("down.org", None, 200, "x"), (None, noon, 200, FILES[0])]
    # A later file of the host takes over.
    log.append(("h0.org", noon + dt.timedelta(hours=6), 200, ""))
    asked = [(f"https://{h}{p}", noon + dt.timedelta(hours=t)) for h in [f"h{k}.org" for k in range(len(FILES))] + ["no.org", "gone.org", "down.org", "other.org"] for p in paths for t in (-1, 0, 7, 23, 24)]
    asked += [("nothing", noon), (None, noon), ("https://h0.org/", None), ("https:///x", noon)]
    got = robots.can_fetch(spark.createDataFrame([(i, u, t, "x") for i, (u, t) in enumerate(asked)], "i int, url string, ts timestamp, host string"), spark.createDataFrame(log, "host string, fetched timestamp, status int, text string"), "bot/2.0").collect()
    assert len(got) == len(asked) and got[0].asDict().keys() == {"i", "url", "ts", "host", "allowed", "known"}
    for r in got:
        url, ts = asked[r.i]
        host = (url or "").split("://", 1)[-1].split("/")[0].split("?")[0].split("#")[0] if url and "://" in url else ""
        held = ts is not None and noon <= ts < noon + dt.timedelta(hours=30 if host == "h0.org" else 24)  # the second file of h0 is of hour 6
        if not held or host in ("", "down.org", "other.org"):
            assert (r.allowed, r.known) == (True, False)
        elif host in ("no.org", "gone.org"):
            assert (r.allowed, r.known) == (host == "gone.org", True)
        else:
            file = RobotFileParser()
            file.parse(("" if host == "h0.org" and ts >= noon + dt.timedelta(hours=6) else FILES[int(host[1])]).splitlines())
            assert (r.allowed, r.known) == (file.can_fetch("bot/2.0", url), True), (url, ts)


def test_robots_of_empty_tables(spark):
    files = spark.createDataFrame([], "host string, fetched timestamp, status int, text string")
    none = spark.createDataFrame([], "url string, ts timestamp")
    assert robots.can_fetch(none, files, "bot").count() == 0
    one = spark.createDataFrame([("https://a.org/x", dt.datetime(2024, 1, 1))], "url string, ts timestamp")
    assert [(r.allowed, r.known) for r in robots.can_fetch(one, files, "bot").collect()] == [(True, False)]


class _State:
    """A state of one key in memory that counts its calls."""

    def __init__(self, calls):
        self.calls, self.value, self.map, self.timers = calls, None, {}, set()

    def __getattr__(self, name):
        do = {
            "exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None),
            "containsKey": lambda k: k in self.map, "getValue": lambda k: self.map[k], "updateValue": lambda k, v: self.map.__setitem__(k, v), "removeKey": lambda k: self.map.pop(k), "keys": lambda: list(self.map),
            "listTimers": lambda: list(self.timers), "deleteTimer": lambda t: self.timers.discard(t), "registerTimer": lambda t: self.timers.add(t),
            "getValueState": lambda *a: _State(self.calls), "getMapState": lambda *a: _State(self.calls),
        }[name]

        def call(*a):
            self.calls.append(name)
            return do(*a)

        return call


@pytest.mark.parametrize("many,most", [(300, 40), (9000, None)])
def test_slots_of_a_key_go_together(many, most):
    """Requests in slots of their own take a few calls of the state and few frames; a key with more than TOGETHER uses slots, with the same decisions."""
    from types import SimpleNamespace

    import pandas as pd

    at = [k * 7_000_000 for k in range(many)]
    log = limits._OrderedLog("who", "ts", "id", "bigint", 3, 60.0, False, 5000)
    calls = []
    handle = _State(calls)
    log.init(handle)
    frame = pd.DataFrame({"limit_us": at[::-1], "limit_order": list(range(many))[::-1]})
    log.handleInputRows(("a",), iter([frame[:100], frame[100:]]), None)
    out = []
    for now in (at[many // 2] // 1000, at[-1] // 1000 + 10_000):
        assert min(handle.timers) <= now
        out += list(log.handleExpiredTimer(("a",), SimpleNamespace(getCurrentWatermarkInMs=lambda now=now: now), None))
    rule = limits.WindowLog(3, 60.0)
    want = [(k, rule.check(a / 1e6)[0]) for k, a in enumerate(at)]
    got = pd.concat(out)
    assert list(zip(got["id"].tolist(), got["allowed"].tolist())) == want
    assert most is None or len(calls) <= most and len(out) == 2

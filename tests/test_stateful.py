"""Lockout with timers, newest-run stores, cursors and marks: replays, late and repeated events, resets and nulls."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from karst.operators.graphs import shared_dir
from karst.streaming import lockouts, stores, streams

T0 = datetime.datetime(2024, 3, 1)
SCHEMA = "user long, ts timestamp, id long, kind string"


def folder(spark):
    return f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"


def machine(rows, limit=5, hours=24, last=None):
    """The rule again, from sorted rows, one user at a time."""
    out = []
    good = {(u, t, i): k for u, t, i, k in sorted(rows, key=lambda r: (str(r), r[3] or "")) [::-1] if u is not None and t is not None and k in lockouts.KINDS}
    for u, t, i, k in rows:
        if (u, t, i) in good and k in lockouts.KINDS:
            good[u, t, i] = min(good[u, t, i], k)
    last = last or max(t for _, t, _ in good)
    for user in {u for u, _, _ in good}:
        fails, until = 0, None
        for t, _, k in sorted((t, -1 if i is None else i, k) for (u, t, i), k in good.items() if u == user):
            if until and t >= until:
                out.append((user, "expired", until, None))
                fails, until = 0, None
            if until and k == "unlock":
                out.append((user, "unlocked", t, None))
            if k == "unlock":
                fails, until = 0, None
            elif not until:
                fails = fails + 1 if k == "failure" else 0
                if fails == limit:
                    until = t + datetime.timedelta(hours=hours)
                    out.append((user, "locked", t, until))
        if until and until <= last:
            out.append((user, "expired", until, None))
    return sorted(out, key=str)


def login_rows(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), T0 + datetime.timedelta(minutes=rng.randint(0, 9000), milliseconds=i), i, rng.choice(["failure"] * 30 + ["success"] * 4 + ["unlock", "other"])) for i in range(n)]
    return [*rows, rows[0], rows[0], (None, T0, 5, "failure"), (1, None, 6, "failure"), (1, T0, 7, None)]


@pytest.mark.parametrize("seed", range(3))
def test_lockout_of_a_table(spark, seed):
    rows = login_rows(seed)
    got = lockouts.lockout(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    want = machine(rows)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {"locked", "unlocked", "expired"} <= {r[1] for r in want}


def test_lockout_of_nothing(spark):
    assert lockouts.lockout(spark.createDataFrame([], SCHEMA)).count() == 0
    assert lockouts.lockout(spark.createDataFrame([(1, T0, 1, "other")], SCHEMA)).count() == 0


def test_step_at_the_edges():
    hour = 3_600_000_000
    assert lockouts.step((4, None), 10, "failure", 5, 24) == ((5, 10 + 24 * hour), [("locked", 10, 10 + 24 * hour)])
    assert lockouts.step((5, 100), 99, "success", 5, 24) == ((5, 100), [])
    assert lockouts.step((5, 100), 99, "failure", 5, 24) == ((5, 100), [])
    assert lockouts.step((5, 100), 100, "failure", 5, 24) == ((1, None), [("expired", 100, None)])
    assert lockouts.step((5, 100), 50, "unlock", 5, 24) == ((0, None), [("unlocked", 50, None)])
    assert lockouts.step((5, 100), 100, "unlock", 5, 24) == ((0, None), [("expired", 100, None)])
    assert lockouts.step((3, None), 50, "unlock", 5, 24) == ((0, None), [])


def test_lockout_as_a_stream(spark):
    rows = [r for r in login_rows(7) if r[1] is not None]
    last = max(r[1] for r in rows)
    rows.append((9, last + datetime.timedelta(hours=30), 1000, "success"))  # moves the watermark on by more than the delay
    # parts by time, but each tenth event comes one part late, within the delay
    part = lambda r: int((r[1] - T0).total_seconds() // 60 // 3000) + (r[2] % 10 == 0)
    base = folder(spark)
    for k in range(6):
        own = [r for r in rows if part(r) == k]
        if own:
            spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    got = streams.run_to_end(lockouts.lockout_stream(stream, "6000 minutes"))
    # the watermark ends 6000 minutes before the last event
    end = last + datetime.timedelta(hours=30) - datetime.timedelta(minutes=6000)
    want = machine([r for r in rows if r[1] <= end], last=end)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want and len(want) > 5


def test_newest_store_replays(spark):
    store = stores.NewestStore(spark, folder(spark), ["key"], ["run", "attempt"], fold_every=3)
    assert store.read() is None
    make = lambda rows: spark.createDataFrame(rows, "key string, run long, attempt int, status string")
    batches = [[("a", 5, 1, "new"), ("b", 1, 1, "x"), (None, 1, 1, "n")], [("a", 4, 9, "old"), ("b", 1, 2, "retry")], [("a", 5, 1, "new"), ("c", 1, None, None)], [("b", 1, 1, "late"), ("c", 1, 1, "z")], []]
    want = {"a": (5, 1, "new"), "b": (1, 2, "retry"), "c": (1, 1, "z"), None: (1, 1, "n")}
    for n, rows in enumerate(batches):
        store.write(make(rows), n)
    state = lambda: {r["key"]: (r["run"], r["attempt"], r["status"]) for r in store.read().collect()}
    assert state() == want
    for n in (0, 1, 4, 4, 2):
        store.write(make(batches[n]), n)
        assert state() == want
    assert len(store.folds.runs()) == 1 and store.folds.runs()[0] >= 2


def test_batch_that_died_is_written_again(spark):
    store = stores.NewestStore(spark, folder(spark), ["key"], ["run"])
    rows = spark.createDataFrame([("a", 1, "x")], "key string, run long, status string")
    store.write(rows, 0)
    store.log.fs.delete(store.log.path(store.log.folder("rows", 0) + "/_SUCCESS"), True)
    assert store.read() is None
    store.write(rows, 0)
    assert store.read().count() == 1


def test_cursors_read_each_row_once(spark):
    log = stores.SourceCursors(spark, folder(spark), "source", ["at", "id"])
    make = lambda rows: spark.createDataFrame(rows, "source string, at long, id long, run_of string")
    first = [("a", 1, 1, "x"), ("a", 2, 2, "x"), ("b", 9, 3, "x"), (None, 1, 4, "x")]
    more = [*first, ("a", 2, 5, "y"), ("a", 3, 6, "y"), ("b", 9, 3, "again"), ("c", 1, 7, "y")]
    assert log.read() is None and log.cursors() is None
    log.reset()
    log.sync(make(first))
    assert log.read().count() == 4
    log.sync(make(more))
    got = sorted((r["id"], r["run"]) for r in log.read().collect())
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1), (6, 1), (7, 1)]
    log.sync(make(more))
    assert log.read().count() == 7
    log.reset("a")
    assert sorted(r["source"] or "" for r in log.cursors().collect()) == ["", "b", "c"]
    log.sync(make(more))
    got = sorted((r["id"], r["run"]) for r in log.read().collect())
    assert got == [(1, 4), (2, 4), (3, 0), (4, 0), (5, 4), (6, 4), (7, 1)]
    log.reset()
    assert log.read().count() == 0
    log.sync(make(more[:2]))
    assert log.read().count() == 2


def test_cursor_and_rows_commit_together(spark):
    log = stores.SourceCursors(spark, folder(spark), "source", ["id"])
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "source string, id long")
    log.sync(rows.where("id = 1"))
    log.log.put("rows", 1, rows.where("id = 2"))  # died before the cursors were written
    assert log.read().count() == 1
    log.sync(rows)
    assert sorted(r["id"] for r in log.read().collect()) == [1, 2]


def test_incremental_table(spark):
    make = lambda rows: spark.createDataFrame(rows, "k string, created long, v int")
    table = stores.IncrementalTable(spark, folder(spark), ["k"], ["created"], lambda df: df.where("v > 0"))
    assert table.read() is None
    first = [("a", 1, 1), ("b", 2, 1), ("c", 3, -1)]
    table.refresh(make(first))
    more = [*first, ("a", 4, 5), ("d", 3, 7)]  # d is behind the mark of the row that the job left out
    table.refresh(make(more))
    assert sorted((r["k"], r["created"], r["v"], r["run"]) for r in table.read().collect()) == [("a", 4, 5, 1), ("b", 2, 1, 0)]
    table.refresh(make([]))
    assert table.mark()["mark"]["created"] == 4
    table.refresh(make(more), full=True)
    assert sorted((r["k"], r["created"], r["run"]) for r in table.read().collect()) == [("a", 4, 3), ("b", 2, 3), ("d", 3, 3)]


def test_newest_is_merged_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("o"), (F.col("id") * 2).alias("v"))
    out = stores.newest(rows, ["k"], ["o"])
    assert [tuple(r) for r in out.collect()] == [("hot", 999, 1998)]
    assert "partial_max" in out._jdf.queryExecution().toString()


def test_a_part_of_many_files_is_one_batch(spark):
    parts = [spark.range(k * 100, k * 100 + 100, 1, 3).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("ts")) for k in range(3)]
    seen = []
    q = streams.feed([parts[0], parts[0].where("false"), *parts[1:]]).writeStream.foreachBatch(lambda df, n: seen.append(sorted(r["id"] for r in df.collect()))).option("checkpointLocation", folder(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [list(range(100)), [], list(range(100, 200)), list(range(200, 300))]


class Kept:
    """A handle that keeps state in memory and counts what is read and which timers are set."""

    def __init__(self):
        self.data, self.reads, self.timers = {}, 0, []
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove

    def getMapState(self, name, *_):
        return self

    def containsKey(self, k):
        return k in self.data

    def getValue(self, k):
        self.reads += 1
        return self.data[k]

    def updateValue(self, k, v):
        self.data[k] = v

    def removeKey(self, k):
        del self.data[k]

    def keys(self):
        return iter(list(self.data))

    def iterator(self):
        self.reads += len(self.data)
        return iter(list(self.data.items()))

    def getValueState(self, name, *_):
        class Value:
            exists, get = lambda s: hasattr(s, "v"), lambda s: s.v
            update, clear = lambda s, v: setattr(s, "v", v), lambda s: s.__dict__.pop("v", None)

        return Value()


def test_lockout_reads_each_waiting_event_once(spark):
    from types import SimpleNamespace as N

    from pyspark.sql import Row

    kept, machine_, minute = Kept(), lockouts._Machine(5, 24, 3600), 60_000_000
    machine_.init(kept)
    list(machine_.handleInputRows((1,), iter([Row(user=1, at=k * minute, id=k, kind="failure") for k in range(3000)]), None))
    out = []
    for now in range(0, 2900, 290):  # the watermark moves on by 290 minutes; timers that are due are called
        for timer in [t for t in kept.timers if t <= now * 60_000]:
            kept.timers.remove(timer)
            out += list(machine_.handleExpiredTimer((1,), N(getCurrentWatermarkInMs=lambda now=now: now * 60_000), N(getExpiryTimeInMs=lambda timer=timer: timer)))
    assert [(r["change"], r["at"] // minute) for r in out] == [("locked", 4), ("expired", 1444), ("locked", 1448)]
    assert len(kept.timers) == 1 and kept.reads <= 70

"""Account lockout as a state machine with timers, as a stream and over whole tables.

So many failed logins in a row lock an account for a time. A success or an unlock event resets the count; an unlock ends
a lock; while an account is locked, logins are refused and change nothing. A lock's end clears the count. Each lock,
unlock and end is one row.

Events of a user are taken in the order of their times and ids. The stream waits with an event until the watermark
has passed its time, so late events within the delay find their place; times of the stream are told apart by
milliseconds of the watermark. A user without failures and without a lock has no state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LIMIT, HOURS = 5, 24
#: Kinds of events; others are left out.
KINDS = ("failure", "success", "unlock")
CHANGES = "user long, change string, at long, until long"
_HOUR = 3_600_000_000
#: Most waiting events in a chunk of the state.
_CHUNK = 4096


def step(state: tuple[int, int | None], at: int, kind: str | None, limit: int, hours: int) -> tuple[tuple[int, int | None], list[tuple[str, int, int | None]]]:
    """The state (failures in a row, locked until) after an event at a time in microseconds, and the changes it made; without a kind,
    only the time passes."""
    failures, until = state
    out = []
    if until is not None and at >= until:
        out.append(("expired", until, None))
        failures, until = 0, None
    if kind == "unlock":
        if until is not None:
            out.append(("unlocked", at, None))
        return (0, None), out
    if until is None and kind == "success":
        failures = 0
    elif until is None and kind == "failure":
        failures += 1
        if failures == limit:
            until = at + hours * _HOUR
            out.append(("locked", at, until))
    return (failures, until), out


def known(events: DataFrame) -> DataFrame:
    """(user, at in microseconds, id, kind, ts) of the events that matter."""
    return events.where(F.col("user").isNotNull() & F.col("ts").isNotNull() & F.col("kind").isin(*KINDS)).select(F.col("user").cast("long"), F.unix_micros("ts").alias("at"), F.col("id").cast("long"), "kind", "ts")


class _Machine(StatefulProcessor):
    """Waiting events in chunks of a map (slice of time, number) -> rows, and the user's state, with one timer for the earliest thing due.

    An event is written once and read when its slice falls due (again only in the slice that the watermark stands in), so the work
    grows with the events, and memory holds one slice of one user."""

    def __init__(self, limit: int, hours: int, seconds: int):
        self.limit, self.hours, self.width = limit, hours, seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long, number long", "at array<long>, id array<long>, kind array<string>")
        self.state = handle.getValueState("state", "failures int, until long")
        self.next = handle.getValueState("next", "timer long, number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        timer, number = self._next()
        earliest, chunks = None, {}
        for row in rows:
            at = row["at"]
            earliest = at if earliest is None else min(earliest, at)
            chunk = chunks.setdefault(at // self.width, [])
            chunk.append((at, row["id"], row["kind"]))
            if len(chunk) == _CHUNK:
                number = self._put(at // self.width, number, chunk)
                chunk.clear()
        for place, chunk in chunks.items():
            number = self._put(place, number, chunk) if chunk else number
        self._wake(timer, [t for t in (timer, None if earliest is None else earliest // 1000) if t is not None], number)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        _, number = self._next()
        state = tuple(self.state.get()) if self.state.exists() else (0, None)
        later, due = [], {}
        for place, n in list(self.waiting.keys()):
            if place * self.width // 1000 <= now:
                due.setdefault(place, []).append(n)
            else:
                later.append(place * self.width // 1000)
        for place in sorted(due):
            # repeated deliveries of an event are one; of two kinds under one id the first in order stays, whatever came first
            kinds, left = {}, []
            for n in due[place]:
                for at, i, kind in zip(*self.waiting.getValue((place, n)), strict=True):
                    if at // 1000 > now:
                        left.append((at, i, kind))
                    elif (at, i) not in kinds or kind < kinds[at, i]:
                        kinds[at, i] = kind
                self.waiting.removeKey((place, n))
            for start in range(0, len(left), _CHUNK):
                number = self._put(place, number, left[start : start + _CHUNK])
            later += [min(left)[0] // 1000] if left else []
            for at, _, kind in sorted((at, -1 if i is None else i, kind) for (at, i), kind in kinds.items()):
                state, out = step(state, at, kind, self.limit, self.hours)
                yield from (Row(user=key[0], change=change, at=t, until=until) for change, t, until in out)
        if state[1] is not None and state[1] // 1000 <= now:
            state, out = step(state, state[1], None, self.limit, self.hours)
            yield from (Row(user=key[0], change=change, at=t, until=until) for change, t, until in out)
        if state == (0, None):
            self.state.clear()
        else:
            self.state.update(state)
            later += [] if state[1] is None else [state[1] // 1000]
        self._wake(None, later, number)

    def _next(self) -> tuple[int | None, int]:
        """The timer that is set, if any, and the number of the next chunk."""
        return tuple(self.next.get()) if self.next.exists() else (None, 0)

    def _put(self, place: int, number: int, chunk: list) -> int:
        at, i, kind = (list(c) for c in zip(*chunk, strict=True))
        self.waiting.updateValue((place, number), (at, i, kind))
        return number + 1

    def _wake(self, timer: int | None, times: list[int], number: int) -> None:
        """Set the timer to the earliest of the times."""
        if not times:
            self.next.clear()
            return
        if min(times) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(times))
        self.next.update((min(times), number))

    def close(self) -> None:
        pass


def lockout_stream(events: DataFrame, delay: str = "1 hour", limit: int = LIMIT, hours: int = HOURS, seconds: int = 3600) -> DataFrame:
    """Lock, unlock and end rows of a stream of (user, ts, id, kind). Needs the RocksDB state store.

    Waiting events are kept in slices of so many seconds."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = known(events).withWatermark("ts", delay)
    return _times(rows.groupBy("user").transformWithState(_Machine(limit, hours, seconds), CHANGES, "Append", "EventTime"))


def _times(changes: DataFrame) -> DataFrame:
    return changes.select("user", "change", F.timestamp_micros("at").alias("at"), F.timestamp_micros("until").alias("until"))


def lockout(events: DataFrame, limit: int = LIMIT, hours: int = HOURS) -> DataFrame:
    """The same rows of a whole table; locks that end after its last event have no end row.

    Users are dealt to tasks and read in order, one state at a time, so a user with many events costs time, not memory."""
    rows = known(events).groupBy("user", "at", "id").agg(F.min("kind").alias("kind"))
    last = rows.agg(F.max("at")).first()[0]

    def run(batches: Iterable) -> Iterator:
        user, state, out = None, (0, None), []

        def end():
            return step(state, last, None, limit, hours)[1]

        for batch in batches:
            for who, at, kind in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if who != user:
                    out += [(user, *x) for x in end()]
                    user, state = who, (0, None)
                state, changes = step(state, at, kind, limit, hours)
                out += [(user, *x) for x in changes]
            yield table(out)
            out = []
        out += [(user, *x) for x in end()] if user is not None else []
        yield table(out)

    def table(rows):
        import pyarrow as pa

        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], ["user", "change", "at", "until"])

    return _times(rows.repartition("user").sortWithinPartitions("user", "at", "id").mapInArrow(run, CHANGES))

"""Queries of stateful streams and of tables read on from marks. Each feeds the given events in parts, some of them late or twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graphs import shared_dir
from ..streaming import lockouts, stores, streams
from .registry import query

_PARTS = 4


def _folder(v, name: str) -> str:
    path = f"{shared_dir(v.spark)}/{name}-{uuid.uuid4().hex}"
    streams._until_the_end(v.spark, path)
    return path


def _by_time(rows: DataFrame) -> tuple[list[DataFrame], int]:
    """Rows with a time ts cut into parts of equal length in time, and that length in seconds."""
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    width = int((last - first).total_seconds() // _PARTS) + 1 if first else 1
    at = lambda k: F.lit(first).cast("timestamp") + F.expr(f"make_interval(0, 0, 0, 0, 0, 0, {k * width})")
    return [rows.where((F.col("ts") >= at(k)) & (F.col("ts") < at(k + 1))) for k in range(_PARTS)], width


# ------------------------------------------------ lockout

_KIND = "CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'success' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'unlock' END"
_DAY = 86_400_000_000


@query("st_lockout", f"""
WITH RECURSIVE e AS (SELECT user_id % 15 AS u, epoch_us(CAST(ts AS TIMESTAMP)) AS t, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id % 15 ORDER BY CAST(ts AS TIMESTAMP), event_id) AS i
    FROM events WHERE ({_KIND}) IS NOT NULL),
s AS (
    SELECT DISTINCT u, CAST(0 AS BIGINT) AS i, 0 AS failures, CAST(NULL AS BIGINT) AS until, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS BIGINT) AS freed, CAST(NULL AS BIGINT) AS locked FROM e
    UNION ALL
    SELECT u, i, CASE WHEN kind = 'unlock' THEN 0 WHEN held THEN failures WHEN kind = 'success' THEN 0 ELSE base + 1 END,
           CASE WHEN kind = 'unlock' THEN NULL WHEN held THEN until WHEN kind = 'failure' AND base = 4 THEN t + {_DAY} END,
           CASE WHEN until IS NOT NULL AND NOT held THEN until END,
           CASE WHEN held AND kind = 'unlock' THEN t END,
           CASE WHEN NOT held AND kind = 'failure' AND base = 4 THEN t END
    FROM (SELECT e.u, e.i, e.t, e.kind, s.failures, s.until, s.until IS NOT NULL AND e.t < s.until AS held, CASE WHEN s.until IS NULL THEN s.failures ELSE 0 END AS base
          FROM s JOIN e ON e.u = s.u AND e.i = s.i + 1)),
last AS (SELECT u, until FROM s QUALIFY row_number() OVER (PARTITION BY u ORDER BY i DESC) = 1)
SELECT u AS user, 'locked' AS change, make_timestamp(locked) AS at, make_timestamp(locked + {_DAY}) AS until FROM s WHERE locked IS NOT NULL
UNION ALL SELECT u, 'unlocked', make_timestamp(freed), NULL FROM s WHERE freed IS NOT NULL
UNION ALL SELECT u, 'expired', make_timestamp(ended), NULL FROM s WHERE ended IS NOT NULL
UNION ALL SELECT u, 'expired', make_timestamp(until), NULL FROM last WHERE until <= (SELECT max(t) FROM e)
""")
def st_lockout(v):
    """Each part's every tenth event comes one part late; the delay covers it."""
    rows = v.events.selectExpr("user_id % 15 AS user", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS id", f"{_KIND} AS kind").where("kind IS NOT NULL")
    parts, width = _by_time(rows)
    empty = parts[0].where("false")
    late = [p.where(f"id % 10 {'=' if k else '<>'} 0") for p in parts for k in (0, 1)]
    sent = [a.unionByName(b) for a, b in zip([*late[::2], empty], [empty, *late[1::2]], strict=True)]
    # the last event of all, far on in time and of no consequence, moves the watermark past all others
    last = rows.agg(F.max("ts").alias("ts")).selectExpr("CAST(-1 AS BIGINT) AS user", f"ts + make_interval(0, 0, 0, 0, 0, 0, {2 * width}) AS ts", "CAST(-1 AS BIGINT) AS id", "'success' AS kind").where("ts IS NOT NULL")
    changes = streams.run_to_end(lockouts.lockout_stream(streams.feed([*sent, last]), f"{2 * width} seconds", seconds=width // 16 + 1))
    return changes


# ------------------------------------------------ newest run, sent out of order and again


@query("st_late_run_guard", "SELECT source, max_by(status, (ts, event_id)) AS status, max_by(event_id, (ts, event_id)) AS event_id FROM runs GROUP BY 1")
def st_late_run_guard(v):
    """The newest third of the runs comes first, then the others, then the first batch again."""
    runs = v.runs.select("source", "ts", "event_id", "status")
    parts = [runs.where(f"event_id % 3 = {k}") for k in (2, 0, 1)]
    store = stores.NewestStore(v.spark, _folder(v, "newest"), ["source"], ["ts", "event_id"], fold_every=2)
    q = streams.feed(parts).writeStream.foreachBatch(store.write).option("checkpointLocation", _folder(v, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    for number in (0, 1):
        store.write(parts[0], number)
    return store.read().select("source", "status", "event_id")


# ------------------------------------------------ cursors and marks

_THIRD = "(SELECT max(event_id) // 3 FROM runs)"


@query("st_cursor_per_source", f"SELECT source, run, count(*) AS n, max(event_id) AS upto FROM (SELECT source, event_id, CAST(CASE WHEN source = 7 THEN 3 WHEN event_id <= {_THIRD} * (1 + source % 2) THEN 0 ELSE 1 END AS BIGINT) AS run FROM runs) GROUP BY 1, 2")
def st_cursor_per_source(v):
    """Sources that are a third or two thirds on, then all; then source 7 from the beginning again."""
    rows = v.runs.select("source", "event_id", "ts")
    third = (rows.agg(F.max("event_id")).first()[0] or 0) // 3
    log = stores.SourceCursors(v.spark, _folder(v, "cursors"), "source", ["event_id"])
    log.sync(rows.where(F.col("event_id") <= third * (1 + F.col("source") % 2)))
    log.sync(rows)
    log.reset(7)
    log.sync(rows)
    log.sync(rows)
    return log.read().groupBy("source", "run").agg(F.count("*").alias("n"), F.max("event_id").alias("upto"))


@query("st_incremental_watermark", f"SELECT source, day, event_id, CAST(CASE WHEN event_id <= {_THIRD} THEN 0 WHEN event_id <= 2 * {_THIRD} THEN 1 ELSE 2 END AS BIGINT) AS run FROM (SELECT source, CAST(ts AS DATE) AS day, max(event_id) AS event_id FROM runs WHERE status = 'failure' GROUP BY 1, 2)")
def st_incremental_watermark(v):
    """The latest failure of each source and day, kept up in three runs."""
    rows = v.runs.selectExpr("source", "CAST(ts AS DATE) AS day", "event_id", "status")
    third = (rows.agg(F.max("event_id")).first()[0] or 0) // 3
    table = stores.IncrementalTable(v.spark, _folder(v, "marks"), ["source", "day"], ["event_id"], lambda df: df.where("status = 'failure'").drop("status"))
    for upto in (third, 2 * third, None):
        table.refresh(rows if upto is None else rows.where(F.col("event_id") <= upto))
    return table.read().select("source", "day", "event_id", "run")


# ------------------------------------------------ deliveries and alerts


@query("st_idempotent_ingest", "SELECT event_id, user_id, event_type FROM events")
def st_idempotent_ingest(v):
    """Every part is sent again together with the next one."""
    parts, width = _by_time(v.events.selectExpr("event_id", "user_id", "event_type", "CAST(ts AS TIMESTAMP) AS ts"))
    sent = [parts[0], *(a.unionByName(b) for a, b in zip(parts[1:], parts[:-1], strict=True)), parts[-1]]
    return streams.run_to_end(streams.idempotent_ingest(streams.feed(sent), ["event_id"], "ts", f"{2 * width} seconds")).select("event_id", "user_id", "event_type")


query("st_live_alerts", "SELECT user_id, date_trunc('day', CAST(ts AS TIMESTAMP)) AS since FROM events WHERE event_type = 'error' AND value > 20 GROUP BY 1, 2")(
    lambda v: streams.run_to_end(streams.live_alerts(streams.feed(_by_time(v.events.withColumn("ts", F.col("ts").cast("timestamp")))[0]), "event_type = 'error' AND value > 20", ["user_id"], "ts"))
)

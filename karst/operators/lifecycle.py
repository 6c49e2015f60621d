"""A finding's life: scans, retirement, alerts, entries, boxes and fix targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retire_by_scope(state: DataFrame, scan: DataFrame, scope: DataFrame, full: bool) -> DataFrame:
    """Which findings a scan retires: those whose file it examined and that it did not report. A partial scan retires none."""
    examined = scope.select("path").distinct().withColumn("_x", F.lit(True))
    reported = scan.select("fingerprint").distinct().withColumn("_r", F.lit(True))
    out = state.join(examined, "path", "left").join(reported, "fingerprint", "left")
    verdict = F.when(F.col("_r"), "reported").when(F.lit(not full), "held").when(F.col("_x"), "retired").otherwise("held")
    return out.select("fingerprint", "path", verdict.alias("verdict"))


def apply_scan(state: DataFrame, scan: DataFrame, scope: DataFrame, scan_id: str) -> DataFrame:
    """New state from old state and a full scan: insert, seen again, reopened, retired, held."""
    old = state.select("fingerprint", F.col("path").alias("_op"), F.col("status").alias("_os"))
    new = scan.select("fingerprint", F.col("path").alias("_np")).withColumn("_n", F.lit(True))
    out = old.join(new, "fingerprint", "full_outer").withColumn("path", F.coalesce("_np", "_op"))
    out = out.join(scope.select("path").distinct().withColumn("_x", F.lit(True)), "path", "left")
    was = F.col("_os")
    change = F.when(was.isNull(), "inserted").when(F.col("_n") & (was == "Fixed"), "reopened").when(F.col("_n"), "seen").when((was != "Fixed") & F.col("_x"), "retired").otherwise("held")
    out = out.withColumn("change", change)
    status = F.when(F.col("change").isin("inserted", "reopened"), "Open").when(F.col("change") == "retired", "Fixed").otherwise(was)
    return out.select("fingerprint", "path", "change", status.alias("status"), F.when(F.col("_n"), F.lit(scan_id)).alias("seen_in"))


def rule_alerts(rows: DataFrame, key: list[str], existing: DataFrame) -> DataFrame:
    """Rows of a rule as alerts; a key that has alerted does not again."""
    alerts = rows.select(*key).distinct().withColumn("alert_key", F.md5(F.concat_ws("|", *(F.col(k).cast("string") for k in key))))
    return alerts.join(existing.select("alert_key"), "alert_key", "left_anti")


def group_entries(df: DataFrame, action: list[str], row_id: str) -> DataFrame:
    """Findings that one action clears, as one entry."""
    return df.groupBy(*action).agg(F.count("*").alias("members"), F.min(row_id).alias("first_member"), F.count_if(F.col("status") == "Fixed").alias("closed"))


def route_alerts(alerts: DataFrame, routes: DataFrame, fields: list[str]) -> DataFrame:
    """(alert, route) pairs of routes whose stated fields all match; an unstated field matches any.

    Routes differ in which fields they state: for each such pattern (as many as 2 to the number of fields at most) an alert
    asks with its values of the stated fields and nulls elsewhere, so one join on equality finds them."""
    stated = [F.col(f"want_{f}").isNotNull().alias(f) for f in fields]
    patterns = [tuple(r) for r in routes.select(*stated).distinct().collect()]
    if not patterns:
        return alerts.select("alert_id").limit(0).crossJoin(routes.select("route").limit(0))
    asks = F.array(*(F.struct(F.lit(i).alias("_pattern"), *(F.when(F.lit(on), F.col(f)).alias(f"_ask_{f}") for f, on in zip(fields, p, strict=True))) for i, p in enumerate(sorted(patterns))))
    number = reduce(lambda a, x: a.when(x[1], F.lit(x[0])), enumerate(reduce(lambda p, q: p & q, (F.col(f"want_{f}").isNotNull() == F.lit(on) for f, on in zip(fields, p, strict=True))) for p in sorted(patterns)), F.when(F.lit(False), 0))
    own = alerts.select("alert_id", F.explode(asks).alias("a")).select("alert_id", "a.*")
    same = reduce(lambda p, q: p & q, (F.col(f"_ask_{f}").eqNullSafe(F.col(f"want_{f}")) for f in fields))
    # an alert that lacks a stated field matches no route that states it
    full = reduce(lambda p, q: p & q, (F.col(f"want_{f}").isNull() | F.col(f"_ask_{f}").isNotNull() for f in fields))
    return own.join(routes.withColumn("_route_pattern", number), (F.col("_pattern") == F.col("_route_pattern")) & same & full).select("alert_id", "route")


def box_of_item(df: DataFrame) -> DataFrame:
    box = F.when(F.coalesce("is_deleted", F.lit(False)), "closed:moved").when(F.col("status") == "Fixed", "closed:fixed").when(F.coalesce("is_false_positive", F.lit(False)), "closed:false_positive").when(F.coalesce("is_risk_accepted", F.lit(False)), "closed:accepted").otherwise("attention")
    return df.withColumn("box", box)


def lower_priority(df: DataFrame, verdicts: DataFrame, key: str, entry: str, rank: str) -> DataFrame:
    """A usage verdict may only lower a member's rank; an entry's rank is its members' best."""
    out = df.join(verdicts.select(key, F.col("rank").alias("_v")), key, "left").withColumn("_rank", F.least(F.col(rank), F.col("_v")))
    return out.groupBy(entry).agg(F.max("_rank").alias("rank"), F.count("*").alias("members"))


def work_queue(df: DataFrame, by: list[str], row_id: str, measured: DataFrame) -> DataFrame:
    """One row per package and version with how many alerts wait on it, less those measured already."""
    return df.groupBy(*by).agg(F.count("*").alias("alerts"), F.min(row_id).alias("first_alert")).join(measured, by, "left_anti")


def falls_out(requirements: DataFrame, removed: DataFrame) -> DataFrame:
    """Packages all of whose requirers are removed."""
    gone = removed.select(F.col("package").alias("parent")).distinct().withColumn("karst g", F.lit(True))
    out = requirements.join(gone, "parent", "left").groupBy("child").agg(F.every(F.coalesce("karst g", F.lit(False))).alias("out"))
    return out.where("out").select("child")


def gate_landed(before: DataFrame, after: DataFrame, target: DataFrame, key: list[str], order) -> DataFrame:
    """Whether each copy is at or above its target; a vanished copy passes."""
    out = before.select(*key).join(after.select(*key, F.col("version").alias("now")), key, "left").join(target, "package_id")
    landed = F.when(F.col("now").isNull(), "gone").when(order(F.col("now")) >= order(F.col("target")), "landed").otherwise("short")
    return out.select(*key, landed.alias("verdict"))


def gate_blast(before: DataFrame, after: DataFrame, key: str, order) -> DataFrame:
    """Every other package that moved, and which way."""
    out = before.select(key, F.col("version").alias("was")).join(after.select(key, F.col("version").alias("now")), key, "full_outer")
    move = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(order(F.col("now")) < order(F.col("was")), "downgraded").when(order(F.col("now")) > order(F.col("was")), "upgraded").otherwise("same")
    return out.withColumn("move", move).where("move <> 'same'")


def provenance_verdict(df: DataFrame, shipped: str, affected: str) -> DataFrame:
    """not_shipped, unknown, vulnerable_in_shipped or fixed_in_shipped."""
    v = F.when(F.col(shipped).isNull(), "not_shipped").when(F.col(affected).isNull(), "unknown").when(F.col(affected), "vulnerable_in_shipped").otherwise("fixed_in_shipped")
    return df.withColumn("provenance", v)

"""Data quality: measured values against what is declared, with the reason where there is no answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expectations(df: DataFrame, rules: dict[str, tuple[Column, float, str]]) -> DataFrame:
    """Each invariant's measured value, threshold and outcome, all in one aggregate. Rules: name -> (aggregate, threshold, op)."""
    one = df.agg(*(value.cast("double").alias(name) for name, (value, _, _) in rules.items()))
    rows = one.selectExpr("stack(%d, %s) AS (rule, threshold, op, measured)" % (len(rules), ", ".join(f"'{n}', double({t}), '{op}', `{n}`" for n, (_, t, op) in rules.items())))
    passed = F.when(F.col("op") == "ge", F.col("measured") >= F.col("threshold")).when(F.col("op") == "le", F.col("measured") <= F.col("threshold")).when(F.col("op") == "eq", F.col("measured") == F.col("threshold"))
    return rows.withColumn("passed", F.coalesce(passed, F.lit(False)))


def freshness(df: DataFrame, source: str, ts: str, as_of: str, days: int) -> DataFrame:
    """fresh, stale or unknown by each source's newest row."""
    age = F.datediff(F.expr(as_of), F.max(ts))
    out = df.groupBy(source).agg(F.max(ts).alias("newest"), age.alias("age_days"))
    return out.withColumn("state", F.when(F.col("age_days").isNull(), "unknown").when(F.col("age_days") <= days, "fresh").otherwise("stale"))


def sync_health(runs: DataFrame, source: str, ts: str, row_id: str) -> DataFrame:
    """The state of each source's latest run, and how many of its runs failed."""
    latest = F.max_by("status", F.struct(ts, row_id))
    return runs.groupBy(source).agg(F.when(latest == "success", "healthy").when(latest == "failure", "failing").otherwise("unknown").alias("health"), F.count_if(F.col("status") == "failure").alias("failures"))


def measure_coverage(df: DataFrame, by: list[str], value: str, least: float = 0.5) -> DataFrame:
    """A mean with how much of it is measured; a blind one shows no number."""
    share = F.count(value) / F.count("*")
    out = df.groupBy(*by).agg(F.round(F.avg(value), 4).alias("_v"), F.round(share, 4).alias("coverage"))
    state = F.when(F.col("coverage") == 0, "blind").when(F.col("coverage") < least, "partial").otherwise("measured")
    return out.select(*by, state.alias("state"), F.when(F.col("coverage") > 0, F.col("_v")).alias("value"), "coverage")


def decompose(source: DataFrame, stored: DataFrame, key: str, measure: Column) -> DataFrame:
    """Stored figures against the same figures computed again: match, differs, nothing_to_compare."""
    now = source.groupBy(key).agg(measure.alias("recomputed"))
    out = stored.select(key, "stored").join(now, key, "full_outer")
    state = F.when(F.col("stored").isNull() | F.col("recomputed").isNull(), "nothing_to_compare").when(F.abs(F.col("stored") - F.col("recomputed")) < 1e-6, "match").otherwise("differs")
    return out.withColumn("state", state)


def threshold(df: DataFrame, value: str, limit: float, least: int) -> DataFrame:
    """How many known values are over the limit, whether any, all, and at least so many are; unknown ones are skipped."""
    over = F.col(value) > limit
    return df.agg(F.count(value).alias("known"), F.count_if(over).alias("over"), F.bool_or(over).alias("any_over"), F.every(over).alias("all_over"), (F.count_if(over) >= least).alias("enough_over"))


def changed_fields(old: DataFrame, new: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """(key, field, before, after) of watched fields that moved; one row each, made without pairing fields."""
    a = old.select(key, *(F.col(c).cast("string").alias(f"a_{c}") for c in watched))
    b = new.select(key, *(F.col(c).cast("string").alias(f"b_{c}") for c in watched))
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"a_{c}").alias("before"), F.col(f"b_{c}").alias("after")) for c in watched))
    out = a.join(b, key).select(key, F.explode(F.filter(rows, lambda r: ~r["before"].eqNullSafe(r["after"]))).alias("r"))
    return out.select(key, "r.field", "r.before", "r.after")


def claim_compare(stored: DataFrame, now: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Stored claims against now: unchanged, changed, gone or new, with the inputs that moved."""
    a = stored.select(key, F.lit(1).alias("_a"), *(F.col(c).alias(f"a_{c}") for c in columns))
    b = now.select(key, F.lit(1).alias("_b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    moved = F.array_compact(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns)))
    out = a.join(b, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    state = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(F.size(moved) > 0, "changed").otherwise("unchanged")
    return out.select(key, state.alias("state"), F.when(both, F.array_join(moved, ",")).otherwise("").alias("moved"))


def three_way_merge(base: DataFrame, theirs: DataFrame, ours: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per field: already, applied (they changed it), edited (we did), kept (both did, differently) or unchanged."""
    out = base.select(*key, F.col(value).alias("b")).join(theirs.select(*key, F.col(value).alias("t")), key, "full_outer").join(ours.select(*key, F.col(value).alias("o")), key, "full_outer")
    b, t, o = (F.col(c) for c in "bto")
    state = F.when(t.eqNullSafe(b) & o.eqNullSafe(b), "unchanged").when(t.eqNullSafe(o), "already").when(o.eqNullSafe(b), "applied").when(t.eqNullSafe(b), "edited").otherwise("kept")
    return out.select(*key, state.alias("state"), F.when(state == "applied", t).otherwise(o).alias("value"))


def rollup_consistency(base: DataFrame, rolled: DataFrame, key: str, rolled_count: str) -> DataFrame:
    """A materialised count against its base table."""
    now = base.groupBy(key).agg(F.count("*").alias("_n"))
    return now.join(rolled.select(key, rolled_count), key, "full_outer").select(key, (F.coalesce(F.col(rolled_count), F.lit(0)) - F.coalesce("_n", F.lit(0))).alias("difference"))


def column_supply(columns: DataFrame, writers: DataFrame, connections: DataFrame) -> DataFrame:
    """Why a column is or is not supplied: supplied, failing, not_reported, connect_a_tool or never_collected."""
    w = writers.join(connections, "tool", "left").groupBy("column_name").agg(F.count("*").alias("writers"), F.bool_or(F.coalesce("connected", F.lit(False))).alias("connected"), F.bool_or(F.coalesce("healthy", F.lit(False))).alias("healthy"))
    state = F.when(F.col("writers").isNull(), "never_collected").when(~F.col("connected"), "connect_a_tool").when(~F.col("healthy"), "failing").when(F.col("filled") == 0, "not_reported").otherwise("supplied")
    return columns.join(w, "column_name", "left").select("column_name", state.alias("supply"))


def empty_reason(widgets: DataFrame) -> DataFrame:
    """(supply, synced, n_rows) -> blocked, unknown, stale, empty or live."""
    state = F.when(F.col("supply") != "supplied", "blocked").when(F.col("synced").isNull(), "unknown").when(~F.col("synced"), "stale").when(F.col("n_rows") == 0, "empty").otherwise("live")
    return widgets.withColumn("reason", state)


def assumption_ledger(keys: DataFrame, stated: DataFrame, key: str) -> DataFrame:
    """One row per fixed key; an absent one is stated as unknown."""
    return keys.select(key).join(stated.select(key, "value", "basis"), key, "left").withColumn("basis", F.coalesce("basis", F.lit("unknown")))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)

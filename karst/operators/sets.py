"""Set operations between scans and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan_delta(base: DataFrame, head: DataFrame, key: str = "fingerprint") -> DataFrame:
    """fixed: in base only; new: in head only; unchanged: in both."""
    a, b = base.select(key).distinct().withColumn("_a", F.lit(1)), head.select(key).distinct().withColumn("_b", F.lit(1))
    state = F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "fixed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def empty_base(delta: DataFrame, base_present: bool) -> DataFrame:
    """Counts of a delta; without a base scan nothing can be called new."""
    counts = delta.agg(F.count_if(F.col("state") == "new").alias("new"), F.count_if(F.col("state") == "fixed").alias("fixed"), F.count_if(F.col("state") == "unchanged").alias("unchanged"))
    if base_present:
        return counts.withColumn("answer", F.when(F.col("new") == 0, "nothing_new").otherwise("new_findings"))
    return counts.withColumn("new", F.lit(None).cast("long")).withColumn("answer", F.lit("no_base"))


def union_runs(**runs: DataFrame) -> DataFrame:
    """Findings of several engines, each named; columns one lacks are null."""
    out = None
    for engine, df in runs.items():
        df = df.withColumn("engine", F.lit(engine))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def union_distinct_places(*frames: DataFrame, keys: list[str]) -> DataFrame:
    out = frames[0].select(*keys)
    for df in frames[1:]:
        out = out.unionByName(df.select(*keys))
    return out.dropDuplicates(keys)


def unserved_types(selected: DataFrame, ran: DataFrame, column: str) -> DataFrame:
    return selected.select(column).exceptAll(ran.select(column).distinct()).distinct()


def declared_vs_observed(declared: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    """Each value: both, declared only, or observed only."""
    a, b = declared.select(column).distinct().withColumn("_a", F.lit(1)), observed.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "observed_only").when(F.col("_b").isNull(), "declared_only").otherwise("both")
    return a.join(b, column, "full_outer").select(column, side.alias("side"))


def ordered_union(sources: list[DataFrame], column: str, cap: int) -> DataFrame:
    """Distinct values in order of the first source that has them, then by name, capped."""
    rows = None
    for i, df in enumerate(sources):
        df = df.select(column, F.lit(i).alias("source"))
        rows = df if rows is None else rows.unionByName(df)
    first = rows.groupBy(column).agg(F.min("source").alias("source"))
    top = first.orderBy("source", column).limit(cap)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("source", column)))  # cap rows

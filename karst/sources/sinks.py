"""Writers: nested reports, keyed tables, materialised jobs, two-grain exports and quarantines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SALTS = 256


def report_document(findings: DataFrame, scan: str, tool: str, rule: str, order: list[str], fields: list[str], per_document: int = 5000) -> DataFrame:
    """(scan, part, content): findings as nested report documents, one run per tool.

    A scan of more results than `per_document` becomes several documents, so no task holds a whole scan; neither does
    the join with the scans' sizes, which deals a scan's rows to `_SALTS` places."""
    part = F.pmod(F.xxhash64(*order), F.col("_parts")).alias("part")
    sizes = findings.groupBy(scan, tool).agg(F.ceil(F.count("*") / per_document).alias("_parts")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = findings.withColumn("_salt", F.pmod(F.xxhash64(*order, F.lit("salt")), F.lit(_SALTS)).cast("int"))
    rows = salted.join(sizes, [scan, tool, "_salt"]).select(scan, tool, part, F.struct(*order, F.col(rule).alias("ruleId"), *fields).alias("r"))
    grouped = rows.groupBy(scan, tool, "part").agg(F.sort_array(F.collect_list("r")).alias("results"))
    rules = F.transform(F.array_sort(F.array_distinct(F.transform("results", lambda r: r["ruleId"]))), lambda i: F.struct(i.alias("id")))
    run = F.struct(F.struct(F.struct(F.col(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    return grouped.select(scan, tool, "part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("content"))


def keyed_upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row of each key of both; a key seen again is no longer deleted. A partial aggregate, so hot keys are cheap."""
    rest = [c for c in old.columns if c not in key]
    both = old.select(*key, *rest, F.lit(0).alias("_s")).unionByName(new.select(*key, *rest, F.lit(1).alias("_s")))
    out = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_s", order)).alias("v"))
    return out.select(*key, *(F.col(f"v.{c}").alias(c) for c in rest))


def materialize(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def two_grain_export(df: DataFrame, coarse: DataFrame, path: str) -> None:
    """The same result at two grains, each a table of its own."""
    materialize(df, f"{path}/fine")
    materialize(coarse, f"{path}/coarse")


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with the reasons); the batch goes on."""
    reasons = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    marked = df.withColumn("reasons", F.array_join(reasons, ","))
    return marked.where("reasons = ''").drop("reasons"), marked.where("reasons <> ''")

"""Settings as a table: values drive predicates, and where each came from is reported with the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Policy:
    """Settings (key, kind, value, origin), at most as many rows as there are keys."""

    LIMIT = 10_000

    def __init__(self, table: DataFrame):
        rows = table.select("key", "kind", "value", "origin").limit(self.LIMIT + 1).collect()
        if len(rows) > self.LIMIT:
            raise ValueError("a settings table has a row a key; this one has too many")
        self.rows = {r["key"]: r for r in rows}

    def _get(self, key: str, kind: str) -> str:
        if key not in self.rows:
            raise KeyError(f"no such setting: {key}")
        if self.rows[key]["kind"] != kind:
            raise TypeError(f"{key} is a {self.rows[key]['kind']}, not a {kind}")
        return self.rows[key]["value"]

    def values(self, key: str) -> list[str]:
        return [v for v in self._get(key, "set").split(",") if v]

    def switch(self, key: str) -> bool:
        return self._get(key, "switch") == "true"

    def number(self, key: str) -> float:
        return float(self._get(key, "scalar"))

    def floor(self, key: str) -> str:
        return self._get(key, "floor")

    def member(self, column: str, key: str):
        """Whether a column is in a setting's list; an empty list restricts nothing."""
        values = self.values(key)
        return F.col(column).isin(values) if values else F.lit(True)


def at_or_above(df: DataFrame, column: str, floor: str, ranks: DataFrame) -> DataFrame:
    """Rows whose value ranks at or above a floor; unknown values never do."""
    order = Window.orderBy(F.desc("rnk")).rangeBetween(Window.unboundedPreceding, Window.currentRow)  # a row a rank
    at = ranks.withColumn("_passed", F.count_if(F.col(column) == floor).over(order)).withColumn("_here", F.count_if(F.col(column) == floor).over(Window.partitionBy("rnk")))
    return df.join(at.where((F.col("_passed") == 0) | (F.col("_here") > 0)).drop("_passed", "_here"), column)


def bound(df: DataFrame, policy: DataFrame, keys: list[str]) -> DataFrame:
    """A result with the settings it was made with: each key, its value and its origin."""
    used = policy.where(F.col("key").isin(keys)).select("key", "value", "origin")
    return df.crossJoin(F.broadcast(used.agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "key", "value"))), ";").alias("policy"))))


def param_job(spark, text: str, tables: dict[str, DataFrame], args: dict) -> DataFrame:
    """A named template with its parameters; values are bound, never pasted into the text."""
    return spark.sql(text, args=args, **tables)

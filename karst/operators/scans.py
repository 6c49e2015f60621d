"""Running values along an order within keys, in parts: no key's rows meet in one task, however many there are.

Rows are dealt to parts by ranges of (key, order) and written once, so the parts stay what they are. Each part works out its own running
values; of each (key, part) a summary is kept; what comes before a part is carried from the summaries, one row a part; and
one join puts it back. A key of nine tenths of all rows is spread over nine tenths of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graphs import cut


class Spread:
    """A table's rows in parts. The caller's row is one struct, so no name of its columns can clash; `row` gives its columns."""

    def __init__(self, df: DataFrame, key: list[str], order: list[str], parts: int | None = None):
        self.columns = df.columns
        rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.struct(*key).alias("key"), F.struct(*order).alias("at"))
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = cut(rows.repartitionByRange(parts, "key", "at").withColumn("part", F.spark_partition_id()))
        self.added: list[str] = []

    @staticmethod
    def row(column: str) -> Column:
        return F.col("row").getField(column)

    def _carried(self, keys: list[str], summary: Column, carry) -> DataFrame:
        """The rows with `carry` of the summaries of their key's earlier parts."""
        ends = self.rows.groupBy(*keys, "part").agg(summary.alias("end"))
        before = ends.select(*keys, "part", carry(Window.partitionBy(*keys).orderBy("part")).alias("carry"))
        return self.rows.join(before, [*keys, "part"])

    def _keep(self, rows: DataFrame, name: str, value: Column) -> Spread:
        self.rows = rows.select("row", "key", "at", "part", *self.added, value.alias(name))
        self.added.append(name)
        return self

    def lag(self, value: Column, name: str) -> Spread:
        """Add the value of the key's row before, as a struct of `x` that is null where there is none."""
        self.rows = self.rows.withColumn("v", F.struct(value.alias("x")))
        here = F.lag("v").over(Window.partitionBy("key", "part").orderBy("at"))
        rows = self._carried(["key"], F.max_by("v", "at"), lambda w: F.lag("end").over(w))
        return self._keep(rows, name, F.coalesce(here, F.col("carry")))

    def running(self, value: Column, name: str, how: str = "sum", by: tuple[str, ...] = ()) -> Spread:
        """Add the sum or the minimum of the values so far, this row's included, within the key and added columns."""
        fold = {"sum": F.sum, "min": F.min}[how]
        keys = ["key", *by]
        self.rows = self.rows.withColumn("v", value)
        here = fold("v").over(Window.partitionBy(*keys, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        rows = self._carried(keys, fold("v"), lambda w: fold("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
        return self._keep(rows, name, F.coalesce(here, F.lit(0)) + F.coalesce("carry", F.lit(0)) if how == "sum" else F.least(here, F.col("carry")))

    def table(self, **columns: Column | str) -> DataFrame:
        """The caller's columns, and the named ones; a caller's column of such a name is replaced."""
        own = [self.row(c).alias(c) for c in self.columns if c not in columns]
        return self.rows.select(*own, *((F.col(v) if isinstance(v, str) else v).alias(n) for n, v in columns.items()))

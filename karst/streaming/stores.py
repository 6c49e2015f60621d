"""Tables that grow run by run in the shared folder, and what is read on with them: newest results, cursors and marks.

A run's tables and its progress are one commit: the progress is written last, and a run counts from that on. A run that
died is written again under its number, so nothing is read twice or lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class RunLog:
    """Numbered runs under a folder: base/<table>/run=<number>. One writer at a time."""

    def __init__(self, spark: SparkSession, base: str, last_table: str):
        self.spark, self.base, self.last_table = spark, base.rstrip("/"), last_table
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        self.fs, self.path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def folder(self, table: str, run: int) -> str:
        return f"{self.base}/{table}/run={run}"

    def whole(self, table: str, run: int) -> bool:
        return self.fs.exists(self.path(f"{self.folder(table, run)}/_SUCCESS"))

    def runs(self) -> list[int]:
        """The runs that count, in order."""
        top = self.path(f"{self.base}/{self.last_table}")
        if not self.fs.exists(top):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(top))
        return sorted(n for n in (int(x[4:]) for x in names if x.startswith("run=")) if self.whole(self.last_table, n))

    def put(self, table: str, run: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.folder(table, run))

    def get(self, table: str, runs: list[int], number: str | None = None) -> DataFrame | None:
        """Rows of those runs, with the run's number in a column of that name if one is given."""
        parts = [self.spark.read.parquet(self.folder(table, n)) for n in runs]
        if number is not None:
            if any(number in p.columns for p in parts):
                raise ValueError(f"the rows have a column {number} of their own")
            parts = [p.withColumn(number, F.lit(n).cast("long")) for p, n in zip(parts, runs, strict=True)]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def drop(self, table: str, run: int) -> None:
        self.fs.delete(self.path(self.folder(table, run)), True)


def newest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last in order; rows equal in order: the greatest by their other columns."""
    others = [c for c in df.columns if c not in key and c not in order]
    row = F.struct(*(F.col(c) for c in (*order, *others)))
    return df.groupBy(*key).agg(F.max(row).alias("row")).select(*key, *(F.col("row").getField(c).alias(c) for c in (*order, *others)))


class NewestStore:
    """The row of each key's newest run, whenever it arrives; `write` is for foreachBatch.

    A batch writes the newest row of each of its keys under its own number, so a batch that Spark sends again replaces
    itself. Every `fold_every` batches the whole is folded into one table; batches up to there that come again are in
    it already and are left alone."""

    def __init__(self, spark: SparkSession, base: str, key: list[str], order: list[str], fold_every: int = 16):
        self.log, self.folds = RunLog(spark, f"{base}/batches", "rows"), RunLog(spark, f"{base}/folds", "rows")
        self.key, self.order, self.fold_every = key, order, fold_every

    def write(self, batch: DataFrame, number: int) -> None:
        folded = self.folds.runs()
        if folded and number <= folded[-1]:
            return
        self.log.put("rows", number, newest(batch, self.key, self.order))
        later = [n for n in self.log.runs() if not folded or n > folded[-1]]
        if len(later) >= self.fold_every:
            self.folds.put("rows", later[-1], self.read())
            for n in later:
                self.log.drop("rows", n)
            for n in folded:
                self.folds.drop("rows", n)

    def read(self) -> DataFrame | None:
        folded = self.folds.runs()[-1:]
        later = [n for n in self.log.runs() if not folded or n > folded[0]]
        parts = [p for p in (self.folds.get("rows", folded), self.log.get("rows", later)) if p is not None]
        return newest(reduce(DataFrame.unionByName, parts), self.key, self.order) if parts else None


class SourceCursors:
    """Each source is read on from its own cursor: the greatest (order columns) that a committed run has read of it.

    `sync` reads what lies beyond the cursors and commits rows and cursors together. `reset` forgets the cursor of one
    source or of all: the next run reads them from the beginning, and rows of earlier runs no longer count."""

    def __init__(self, spark: SparkSession, base: str, source: str, order: list[str]):
        self.log, self.source, self.order = RunLog(spark, base, "cursors"), source, order

    def _mark(self) -> Column:
        return F.struct(*self.order)

    def cursors(self) -> DataFrame | None:
        """(source, since, mark): rows of runs from `since` on count, up to mark."""
        runs = self.log.runs()
        return self.log.get("cursors", runs[-1:]) if runs else None

    def sync(self, rows: DataFrame) -> int:
        """Read on; the run's number."""
        runs, cursors = self.log.runs(), self.cursors()
        run = runs[-1] + 1 if runs else 0
        if cursors is not None:
            known = cursors.select(F.col(self.source).alias("cursor of"), F.col("mark").alias("cursor"))
            rows = rows.join(known, F.col(self.source).eqNullSafe(F.col("cursor of")), "left").where(F.col("cursor").isNull() | (self._mark() > F.col("cursor"))).drop("cursor of", "cursor")
        self.log.put("rows", run, rows)
        got = self.log.get("rows", [run]).groupBy(self.source).agg(F.max(self._mark()).alias("mark")).withColumn("since", F.lit(run).cast("long"))
        both = got if cursors is None else cursors.unionByName(got)
        self.log.put("cursors", run, both.groupBy(self.source).agg(F.min("since").alias("since"), F.max("mark").alias("mark")))
        return run

    def reset(self, source=None) -> None:
        """Forget one source's cursor, or all."""
        runs = self.log.runs()
        if runs:
            kept = self.cursors().where(F.lit(False) if source is None else ~F.col(self.source).eqNullSafe(F.lit(source)))
            self.log.put("cursors", runs[-1] + 1, kept)

    def read(self) -> DataFrame | None:
        """All rows that count, each once, with the run that read it."""
        runs, cursors = self.log.runs(), self.cursors()
        rows = self.log.get("rows", [n for n in runs if self.log.whole("rows", n)], "run")
        if rows is None:
            return None
        since = cursors.select(F.col(self.source).alias("cursor of"), "since")
        return rows.join(since, F.col(self.source).eqNullSafe(F.col("cursor of")) & (F.col("run") >= F.col("since"))).drop("cursor of", "since")


class IncrementalTable:
    """A keyed table made by a job over the rows beyond a mark; a full refresh makes it anew and resets the mark."""

    def __init__(self, spark: SparkSession, base: str, key: list[str], order: list[str], job: Callable[[DataFrame], DataFrame]):
        self.log, self.key, self.order, self.job = RunLog(spark, base, "marks"), key, order, job

    def mark(self):
        """(first run that counts, greatest order read so far) of the last run, or None."""
        runs = self.log.runs()
        return self.log.get("marks", runs[-1:]).select("since", "mark").first() if runs else None

    def refresh(self, rows: DataFrame, full: bool = False) -> int:
        """One run over what is new, or over everything; the run's number. The job keeps the key and order columns."""
        runs, last = self.log.runs(), self.mark()
        run = runs[-1] + 1 if runs else 0
        since = run if full or last is None else last["since"]
        at = F.struct(*self.order)
        if last is not None and not full and last["mark"] is not None:
            rows = rows.where(at > F.struct(*(F.lit(last["mark"][c]).cast(rows.schema[c].dataType).alias(c) for c in self.order)))
        self.log.put("rows", run, self.job(rows))
        # the mark of what the job read, not of what it kept, and never behind the last one
        seen = rows.agg(F.max(at).alias("mark"))
        if last is not None and not full and last["mark"] is not None:
            seen = seen.select(F.coalesce("mark", F.struct(*(F.lit(last["mark"][c]).cast(rows.schema[c].dataType).alias(c) for c in self.order))).alias("mark"))
        self.log.put("marks", run, seen.select(F.lit(since).cast("long").alias("since"), "mark"))
        return run

    def read(self) -> DataFrame | None:
        """The newest row of each key, with the run that wrote it."""
        last = self.mark()
        if last is None:
            return None
        rows = self.log.get("rows", [n for n in self.log.runs() if n >= last["since"]], "run")
        return newest(rows, self.key, [*self.order, "run"])

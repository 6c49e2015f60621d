"""Window operators. Every order ends in a unique key, so no result depends on arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Spread


def top_n_per_class(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("pos") <= n)


def top_n_ties(df: DataFrame, by: str, value: str, n: int) -> DataFrame:
    """The first n of each class and all that tie with the last of them."""
    return df.withColumn("pos", F.rank().over(Window.partitionBy(by).orderBy(F.desc(value)))).where(F.col("pos") <= n)


def capped_total(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each class with the class' total before the cap. Counts are aggregated, rows cut before they meet."""
    total = df.groupBy(by).agg(F.count("*").alias("total"))
    return top_n_per_class(df, by, order, n).join(total, by)


def occurrence_ordinal(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)


def latest_version(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The newest row of each key, as a partial aggregate: a hot key's rows never meet in one task."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
    return out.select(*key, *(F.col(f"_v.{c}").alias(c) for c in rest))


def tightest_deadline(df: DataFrame, key: str, order: list[str], deadline: str, reopened: str) -> DataFrame:
    """The tightest deadline so far within a cycle; a reopening begins a new cycle."""
    rows = Spread(df, [key], order)
    rows.running(F.coalesce(rows.row(reopened), F.lit(False)).cast("int"), "cycle")
    rows.running(rows.row(deadline), "in_force", "min", by=("cycle",))
    return rows.table(cycle="cycle", in_force="in_force")


def _islands(df: DataFrame, key: str, order: list[str], state: str) -> Spread:
    rows = Spread(df, [key], order)
    rows.lag(rows.row(state), "previous")
    same = F.col("previous").isNotNull() & rows.row(state).eqNullSafe(F.col("previous.x"))
    return rows.running((~same).cast("int"), "island")


def islands(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Number the runs of equal states of each key, from 1."""
    return _islands(df, key, order, state).table(island="island")


def failure_streaks(runs: DataFrame, key: str, ts: str, row_id: str, status: str = "status") -> DataFrame:
    """The failing streaks of each source: first and last failure, length, and whether the source is still failing."""
    rows = _islands(runs, key, [ts, row_id], status)
    row = rows.row
    groups = rows.rows.groupBy("key", "island").agg(F.min(row(status)).alias("state"), F.min(row(ts)).alias("first_ts"), F.max(row(ts)).alias("last_ts"), F.count("*").alias("length"))
    last = groups.groupBy("key").agg(F.max("island").alias("last island"))
    out = groups.where("state = 'failure'").join(last, "key")
    return out.select(F.col("key").getField(key).alias(key), "first_ts", "last_ts", "length", (F.col("island") == F.col("last island")).alias("current"))


def fold_repeats(df: DataFrame, key: str, order: list[str], what: str, ts: str) -> DataFrame:
    """Consecutive equal events as one row with a count."""
    rows = _islands(df, key, order, what)
    row = rows.row
    groups = rows.rows.groupBy("key", "island").agg(F.min(row(what)).alias("what"), F.min(row(ts)).alias("first_ts"), F.max(row(ts)).alias("last_ts"), F.count("*").alias("times"))
    return groups.select(F.col("key").getField(key).alias(key), F.col("what").alias(what), "first_ts", "last_ts", "times")


def state_transition(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """The rows where a key's state differs from the one before; repeats write nothing."""
    rows = Spread(df, [key], order)
    rows.lag(rows.row(state), "before")
    rows.rows = rows.rows.where(F.col("before").isNull() | ~rows.row(state).eqNullSafe(F.col("before.x")))
    return rows.table(previous=F.col("before.x"))


def reopened(df: DataFrame, key: str, order: list[str], status: str, closed: str) -> DataFrame:
    """Rows of a key that follow a closed one and are not closed."""
    rows = Spread(df, [key], order)
    rows.lag(rows.row(status), "before")
    rows.rows = rows.rows.where((F.col("before.x") == closed) & (rows.row(status) != closed))
    return rows.table(previous=F.col("before.x"))


def carry_block_state(lines: DataFrame, key: str, line: str, begin: Column, end: Column) -> DataFrame:
    """Whether a line lies in a block, from its begin marker to its end marker, both included."""
    w = Window.partitionBy(key).orderBy(line)
    opened = F.sum(begin.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.coalesce(F.sum(end.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("in_block", opened > closed)


def tail_budget(lines: DataFrame, key: str, line: str, text: str, lines_each: int, characters: int) -> DataFrame:
    """The last lines of each step, at most so many, within a budget of characters counted from the end."""
    w = Window.partitionBy(key).orderBy(F.desc(line))
    out = lines.withColumn("karst n", F.row_number().over(w)).withColumn("karst sum", F.sum(F.length(text)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("karst n") <= lines_each) & (F.col("karst sum") <= characters)).drop("karst n", "karst sum")


def trend_delta(df: DataFrame, by: str, period: str, value: str) -> DataFrame:
    """The value against the period before: direction and percent."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(period))
    out = df.withColumn("previous", before)
    delta = F.col(value) - F.col("previous")
    return out.withColumn("direction", F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat")).withColumn("pct", F.round(100.0 * delta / F.nullif(F.col("previous"), F.lit(0)), 1))


def ntile_distribution(df: DataFrame, by: str, value: str, row_id: str) -> DataFrame:
    """Percent rank and quartile of a value within its class, from each row's number in it."""
    rows = Spread(df, [by], [value, row_id])
    rows.running(F.lit(1), "number")
    sizes = rows.rows.groupBy("key").agg(F.count("*").alias("size"))
    # rows of one value share the place of the first of them
    firsts = rows.rows.groupBy("key", F.struct(rows.row(value)).alias("value")).agg(F.min("number").alias("first"))
    rows.rows = rows.rows.withColumn("value", F.struct(rows.row(value))).join(firsts, ["key", "value"]).join(sizes, "key")
    size, number = F.col("size"), F.col("number")
    share, rest = F.floor(size / 4), size % 4
    longer = rest * (share + 1)
    quartile = F.when(number <= longer, F.floor((number - 1) / (share + 1)) + 1).otherwise(rest + F.floor((number - 1 - longer) / F.greatest(share, F.lit(1))) + 1)
    rank = F.when(size == 1, F.lit(0.0)).otherwise((F.col("first") - 1) / (size - 1))
    return rows.table(pct_rank=F.round(rank, 4), quartile=quartile.cast("int"))


def severity_order(column: str = "severity") -> Column:
    """Rank of a severity, unknown ones lowest."""
    c = F.col(column)
    return F.when(c == "Critical", 4).when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1).otherwise(0)


def capped_strict(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows in a strict order: a top-n, not a full sort."""
    return df.orderBy(*order).limit(n)


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, n: int) -> DataFrame:
    """The page after a cursor, and on each row whether more follows."""
    if after is not None:
        row = F.struct(*(F.col(k) for k in keys))
        df = df.where(row > F.struct(*(F.lit(v).alias(k) for k, v in zip(keys, after, strict=True))))
    page = df.orderBy(*keys).limit(n + 1)
    w = Window.orderBy(*keys)  # n + 1 rows
    return page.withColumn("karst n", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > n).where(F.col("karst n") <= n).drop("karst n")


def last_activity(own: DataFrame, members: DataFrame, key: str, own_ts: str, member_ts: str) -> DataFrame:
    """The newest change of an entry or of any of its members."""
    newest = members.groupBy(key).agg(F.max(member_ts).alias("karst m"))
    return own.join(newest, key, "left").withColumn("last_activity", F.greatest(own_ts, "karst m")).drop("karst m")

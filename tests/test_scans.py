"""Running values in parts against plain windows: hot keys, nulls, ties in key, clashing names, empty tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from karst.operators import windows
from karst.operators.scans import Spread

SCHEMA = "k string, t int, id int, s string, d int, r boolean, previous string, island string, part int, row string"


def table(spark, n=600):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 18 + ["a", None]), rng.randint(0, 90), i, rng.choice(["failure", "failure", "ok", None]), rng.choice([None, *range(50)]), rng.choice([True, False, False, None]), "mine", "own", 7, "w") for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_a_hot_key_is_spread(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), F.col("id").alias("t"), (F.col("id") % 3).alias("v"))
    rows = Spread(df, ["k"], ["t"], parts=16)
    sizes = [r["count"] for r in rows.rows.groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 1.5 * 20000 / 16
    got = rows.running(rows.row("v"), "so_far").table(so_far="so_far")
    want = df.withColumn("so_far", F.sum("v").over(Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    assert same(got, want)


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_lag_and_running(spark, parts):
    df = table(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    rows = Spread(df, ["k"], ["t", "id"], parts)
    rows.lag(rows.row("s"), "before")
    rows.running(rows.row("d"), "total")
    rows.running(F.coalesce(rows.row("r"), F.lit(False)).cast("int"), "cycle")
    rows.running(rows.row("d"), "least", "min", by=("cycle",))
    got = rows.table(before=F.col("before.x"), first=F.col("before").isNull(), total="total", cycle="cycle", least="least")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("before", F.lag("s").over(w)).withColumn("first", F.row_number().over(w) == 1).withColumn("total", F.coalesce(F.sum("d").over(so_far), F.lit(0))).withColumn("cycle", F.sum(F.coalesce("r", F.lit(False)).cast("int")).over(so_far))
    want = want.withColumn("least", F.min("d").over(Window.partitionBy("k", "cycle").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert same(got, want)


def test_window_operators(spark):
    df = table(spark)
    w = Window.partitionBy("k").orderBy("t", "id")
    first = F.row_number().over(w) == 1
    change = first | ~F.col("s").eqNullSafe(F.lag("s").over(w))
    assert same(windows.state_transition(df, "k", ["t", "id"], "s"), df.withColumn("c", change).withColumn("previous", F.lag("s").over(w)).where("c").drop("c"))
    assert same(windows.reopened(df, "k", ["t", "id"], "s", "ok"), df.withColumn("previous", F.lag("s").over(w)).where("previous = 'ok' and s <> 'ok'"))
    numbered = df.withColumn("c", change.cast("int")).withColumn("island", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("c")
    assert same(windows.islands(df, "k", ["t", "id"], "s"), numbered)
    folded = numbered.groupBy("k", "island").agg(F.min("s").alias("s"), F.min("t").alias("first_ts"), F.max("t").alias("last_ts"), F.count("*").alias("times"))
    assert same(windows.fold_repeats(df, "k", ["t", "id"], "s", "t"), folded.drop("island"))
    last = F.max("island").over(Window.partitionBy("k"))
    streaks = folded.withColumn("current", F.col("island") == last).where("s = 'failure'").select("k", "first_ts", "last_ts", F.col("times").alias("length"), "current")
    assert same(windows.failure_streaks(df, "k", "t", "id", "s"), streaks)
    ranked = df.withColumn("pct_rank", F.round(F.percent_rank().over(Window.partitionBy("k").orderBy("d")), 4)).withColumn("quartile", F.ntile(4).over(Window.partitionBy("k").orderBy("d", "id")))
    assert same(windows.ntile_distribution(df, "k", "d", "id"), ranked)


def test_nothing_and_few(spark):
    df = table(spark)
    for few in (df.limit(0), df.where("id < 3")):
        assert windows.islands(few, "k", ["t", "id"], "s").count() == few.count()
        assert windows.ntile_distribution(few, "k", "d", "id").count() == few.count()
        assert windows.tightest_deadline(few, "k", ["t", "id"], "d", "r").count() == few.count()

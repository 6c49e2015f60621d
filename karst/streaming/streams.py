"""Streaming forms: each has a batch twin of the same result over all rows.

Tumbling, sliding and session windows re-aim activity and audit summaries at streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import shared_dir


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return what it wrote to the shared folder."""
    import uuid

    base = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:

        def write(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{base}/out")

        q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    _until_the_end(stream.sparkSession, base)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def feed(parts: list[DataFrame]) -> DataFrame:
    """The parts as a stream that takes one part a batch, in order, however many files a part makes.

    Each part gets the same number of files, some of them without rows, and that number is taken at a time."""
    import uuid

    spark = parts[0].sparkSession
    path = f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"
    files = spark.sparkContext.defaultParallelism
    fs_path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fs = fs_path(path).getFileSystem(conf)
    written = lambda folder: fs.globStatus(fs_path(f"{folder}/*.parquet"))
    spark.createDataFrame([], parts[0].schema).coalesce(1).write.parquet(f"{path}-blank")
    blank = written(f"{path}-blank")[0].getPath()
    for number, part in enumerate(parts, 1):
        part.coalesce(files).write.mode("append").parquet(path)
        for k in range(len(written(path)), files * number):
            spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, blank, fs, fs_path(f"{path}/blank-{k}.parquet"), False, conf)
    _until_the_end(spark, path)
    _until_the_end(spark, f"{path}-blank")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def _until_the_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the driver ends."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(made)


def idempotent_ingest(stream: DataFrame, key: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """A row sent again changes nothing, if it comes within the delay; state is kept for the delay.

    Over a whole table: the first row in time of each key."""
    if stream.isStreaming:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    row = F.struct(ts, *(c for c in stream.columns if c != ts))
    first = stream.groupBy(*key).agg(F.min(row).alias("karst row"))
    return first.select(*(F.col("karst row").getField(c).alias(c) for c in stream.columns))


def tumbling_counts(events: DataFrame, ts: str, by: str, size: str = "1 day") -> DataFrame:
    out = events.withWatermark(ts, "1 day") if events.isStreaming else events
    return out.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sliding_failures(events: DataFrame, ts: str, by: str, size: str = "6 hours", slide: str = "3 hours") -> DataFrame:
    out = events.withWatermark(ts, "1 day") if events.isStreaming else events
    return out.groupBy(F.window(ts, size, slide).alias("w"), by).agg(F.count("*").alias("failures")).select(F.col("w.start").alias("start"), by, "failures")


def session_folding(events: DataFrame, ts: str, by: str, gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark(ts, "1 day") if events.isStreaming else events
    return out.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def static_enrich(stream: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """A stream's rows with an inventory's columns, whether the inventory has them or not."""
    return stream.join(static, key, "left")


def live_alerts(stream: DataFrame, condition: str, key: list[str], ts: str, every: str = "1 day") -> DataFrame:
    """(key..., since): one alert for each key and period in which a row meets a rule, as soon as the first one comes.

    Rows of one period lie within its length of each other, so that length as the delay is enough to know them again."""
    hits = stream.where(condition).select(*key, ts, F.window(ts, every)["start"].alias("since"))
    once = hits.withWatermark(ts, every).dropDuplicatesWithinWatermark([*key, "since"]) if stream.isStreaming else hits.dropDuplicates([*key, "since"])
    return once.select(*key, "since")

"""What the corpus operators share: the shared folder, text batches as byte arrays, word hashes, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once; bounds a Python worker's memory.
BLOCK_BYTES = 1 << 19
#: Bytes of one Arrow batch between Spark and a Python worker; Spark's own bound of 64 MB is held several times over by both.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets
    a folder of its own; on a cluster a local folder would lose data, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-karst-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; from now on this session's Arrow batches hold about BATCH_BYTES at most."""
    name, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    return df


class Scratch:
    """Tables written in the shared folder to cut lineage; `drop` deletes those that no later step reads, and the driver's
    end those that are left."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "lz4") -> DataFrame:
        small_batches(df).write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        return self.load(name, df.schema)

    def load(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read
        return (reader.schema(schema) if schema is not None else reader).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, jsc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)

    def free(self) -> None:
        """Let Spark delete the shuffle files of finished steps: it does so when the driver's JVM drops what refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


# ---------------------------------------------------------------- text as bytes


def utf8_blocks(column, limit: int = BLOCK_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) for runs of rows of an Arrow string column; null is empty.

    A run holds about `limit` bytes, or one row if that is longer."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(np.asarray(column.is_null()), 0, lengths)
    row = 0
    ends = np.cumsum(lengths)
    while row < n:
        base = ends[row - 1] if row else 0
        last = max(row + 1, int(np.searchsorted(ends, base + limit, "right")))
        size = lengths[row:last]
        at = np.concatenate(([0], np.cumsum(size)))
        lo = offsets[row]
        hi = offsets[last]
        if hi - lo == at[-1]:
            block = data[lo:hi]
        else:
            block = np.concatenate([data[offsets[i] : offsets[i] + lengths[i]] for i in range(row, last)] or [data[:0]])
        yield row, last, block, at
        row = last
    pa.default_memory_pool().release_unused()


class SpanHash:
    """64-bit hashes of many spans of one byte array: a polynomial over random byte values, modulo 2**64."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 2**64, 256, np.uint64)
        self.base = np.uint64(int(rng.integers(2**63)) | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 2**64))
        self.up = self.down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1024)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > 16 * BLOCK_BYTES:  # one very long text: hash windows of it, so the powers stay small
            out = np.empty(len(starts), np.uint64)
            k = 0
            while k < len(starts):
                lo = starts[k]
                m = max(k + 1, int(np.searchsorted(ends, lo + 8 * BLOCK_BYTES, "right")))
                out[k:m] = self._small(data[lo : ends[m - 1]], starts[k:m] - lo, ends[k:m] - lo)
                k = m
            return out
        return self._small(data, starts, ends)

    def _small(self, data, starts, ends):
        n = len(data)
        self._powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


# ---------------------------------------------------------------- connected components


def _local_forest(batches):
    """Of each batch's edges, a star from the smallest member of every part to the others."""
    import pyarrow as pa

    for batch in batches:
        u, v = (np.asarray(batch.column(i)) for i in (0, 1))
        if not len(u):
            continue
        nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, label[a], low)
            np.minimum.at(new, label[b], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        keep = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[label[keep]])], ["u", "v"])


def _settled(e: DataFrame) -> bool:
    """Whether every edge leads from a node that has no other to one that has none of its own."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("leads"), F.lit(0).alias("met")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("n").agg(F.sum("leads").alias("leads"), F.max("met").alias("met")).where("leads > 1 OR leads = 1 AND met = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(u long, v long) links -> (node, component): the smallest node each one reaches. Nodes without links are absent.

    Partitions first contract their own edges; then large-star and small-star rounds, each written to the shared
    folder, run until the edges are stars, which further rounds leave as they are. A hub's edges never meet in one task: its
    minimum is a partial aggregate, and the join back is one that adaptive execution can split.
    """
    e = edges.where("u <> v").select("u", "v").mapInArrow(_local_forest, "u long, v long")
    e = scratch.save(e.distinct(), f"{name}0")
    i = 0
    while not _settled(e):  # a round is some ten jobs, whose plans and tasks the driver keeps; this is one
        i += 1
        if i > rounds:
            raise RuntimeError("the components did not settle")
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the stars' centres keep their own link to the minimum
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        e2 = large.union(own).where("u <> v").distinct()
        down = e2.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e3 = small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v")
        e = scratch.save(e3.distinct(), f"{name}{i}")
        scratch.drop(f"{name}{i - 1}")
    # every edge now goes from a member to its smallest member
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

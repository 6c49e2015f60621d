"""Token-id files: frequency-ranked ids in one to four bytes each, their byte counts in separate control bytes.

An id's rank by frequency over the whole corpus (ties to the smaller id) is written instead of the id, so common ids
take one byte. Four ranks share a control byte of four two-bit lengths; control bytes and data bytes lie apart, so a
reader looks up each control byte in a table of gather positions and decodes four ids at once with numpy.

Layout of a block (little-endian): magic "KID1", u32 documents, u64 data bytes; per document i64 id (the null id is
the smallest), u32 ids; per document its control bytes; then all data bytes. Blocks are rows of a Parquet table,
(shard, block, documents, ids, payload), written by Spark's own committer, so lost executors leave no torn files;
a second table holds the ranks. Shards are ranges of doc_id in ascending order, blocks ascend within a shard.

Cases: a null text is empty and gives its end id alone; null doc_ids come first; rows that share a doc_id follow
each other in the order of their content; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import token_blocks

MAGIC = b"KID1"
NULL_ID = -(2**63)
#: Ids after which a block is closed; bounds the memory of writer and reader (one longer document is one block).
BLOCK_IDS = 1 << 18
#: Documents of one shard, about.
SHARD_ROWS = 20_000


def _tables():
    """Of each control byte: bytes of its four numbers, and the 16 positions to gather (those past the end: none)."""
    codes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    sizes = codes + 1
    starts = np.cumsum(sizes, 1) - sizes
    at = starts[:, :, None] + np.arange(4)
    at[np.arange(4)[None, None, :] >= sizes[:, :, None]] = -1
    return sizes.sum(1), at.reshape(256, 16)


TOTAL, GATHER = _tables()


def encode(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(control bytes, data bytes) of unsigned 32-bit numbers."""
    ranks = ranks.astype("<u4")
    n = len(ranks)
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(n, 4)[np.arange(4) <= code[:, None]]
    code = np.concatenate((code, np.zeros(-n % 4, np.uint8))).reshape(-1, 4)
    return (code << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8), data


def decode(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """The n numbers, and how many data bytes they took."""
    size = TOTAL[control]
    ends = np.cumsum(size)
    padding = -n % 4  # the absent numbers of the last byte have no data
    at = (ends - size)[:, None] + GATHER[control]
    at[GATHER[control] < 0] = len(data)
    at = np.minimum(at, len(data))
    out = np.append(data, np.uint8(0))[at].reshape(-1).view("<u4")
    return out[:n], int(ends[-1]) - padding if n else 0


def token_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, n, z): each text's ids with the end id, as compressed 32-bit integers."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.column(0)
            for lo, hi, ids, at in token_blocks(batch.column(1), tokenizer):
                own = [np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4") for i in range(hi - lo)]
                z = [pa.compress(_planes(x), codec="zstd", asbytes=True) for x in own]
                yield pa.RecordBatch.from_arrays([names.slice(lo, hi - lo), pa.array([len(x) for x in own], pa.int32()), pa.array(z, pa.binary())], ["doc_id", "n", "z"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, z binary")


def _planes(ids: np.ndarray) -> bytes:
    """The low two bytes of all ids, then the high two: the high plane of a small vocabulary is zeros."""
    halves = ids.view("<u2").reshape(-1, 2)
    return halves[:, 0].tobytes() + halves[:, 1].tobytes()


def _ids(z: bytes, n: int) -> np.ndarray:
    import pyarrow as pa

    halves = np.frombuffer(pa.decompress(z, decompressed_size=4 * n, codec="zstd", asbytes=True), "<u2")
    return halves[:n] | (halves[n:].astype(np.uint32) << np.uint32(16))


def frequencies(table: DataFrame) -> DataFrame:
    """(id, n) over all ids of a token table; as many rows as the vocabulary has."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            for z, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.bincount(_ids(z, n))
                if len(own) > len(total):
                    total, own = own, total
                total[: len(own)] += own
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["id", "n"])

    return table.select("z", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Write documents (doc_id, text) as a token-id file under path."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ids")
    table = scratch.save(token_table(docs, tokenizer, end_id), "tokens", "none")
    # the vocabulary bounds this table, so the driver and each task may hold it
    counts = frequencies(table).orderBy(F.desc("n"), "id").select("id").toPandas()["id"].to_numpy()
    spark.createDataFrame([(int(r), int(i)) for r, i in enumerate(counts)], "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = np.zeros(int(counts.max()) + 1 if len(counts) else 1, np.uint32)
    rank_of[counts] = np.arange(len(counts), dtype=np.uint32)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        names, sizes, controls, data, total = [], [], [], [], 0

        def close():
            body = b"".join(data)
            head = MAGIC + struct.pack("<IQ", len(names), len(body))
            payload = b"".join((head, np.array(names, "<i8").tobytes(), np.array(sizes, "<u4").tobytes(), *controls, body))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32()), (len(names), pa.int32()), (total, pa.int64()), (payload, pa.binary()))], ["shard", "block", "documents", "ids", "payload"])

        for batch in batches:
            for name, n, z in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                control, own = encode(rank_of[_ids(z, n)])
                names.append(NULL_ID if name is None else name)
                sizes.append(n)
                controls.append(control.tobytes())
                data.append(own.tobytes())
                total += n
                if total >= BLOCK_IDS:
                    yield close()
                    names, sizes, controls, data, total, block = [], [], [], [], 0, block + 1
        if names:
            yield close()

    n = max(1, table.count() // SHARD_ROWS, spark.sparkContext.defaultParallelism)
    tie = F.xxhash64("z").alias("tie")
    ordered = table.withColumn("tie", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "n", "z")
    ordered.mapInArrow(blocks, "shard int, block int, documents int, ids long, payload binary").write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop("tokens")


def unpack(payload: bytes, id_of: np.ndarray):
    """Yield (doc_id, ids) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token-id block")
    documents, size = struct.unpack("<IQ", payload[4:16])
    names = np.frombuffer(payload, "<i8", documents, 16)
    sizes = np.frombuffer(payload, "<u4", documents, 16 + 8 * documents)
    at = 16 + 12 * documents
    body = len(payload) - size
    data = np.frombuffer(payload, np.uint8)
    for name, n in zip(names.tolist(), sizes.tolist(), strict=True):
        control = data[at : at + (n + 3) // 4]
        ranks, took = decode(control, data[body : body + 4 * n], n)
        at += len(control)
        body += took
        yield None if name == NULL_ID else name, id_of[ranks]


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Read a token-id file: one row per document with where its ids start in the whole file, their number and CRC-32."""
    files = spark.read.schema("shard int, block int, documents int, ids long, payload binary").parquet(f"{path}/blocks")
    id_of = spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy().astype("<u4")
    shards = files.groupBy("shard").agg(F.sum("ids").alias("own"))
    rest = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one small row a shard
    shards = shards.select("shard", F.coalesce(F.sum("own").over(rest), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = files.select("shard", "block", "ids").withColumn("inside", F.coalesce(F.sum("ids").over(within), F.lit(0)))
    starts = blocks.join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for shard, block, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, at = ([], [], [], [], []), 0
                for name, ids in unpack(payload, id_of):
                    for column, value in zip(rows, (name, at, len(ids), zlib.crc32(ids), ids.tobytes() if with_ids else None), strict=True):
                        column.append(value)
                    at += len(ids)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array([shard] * len(rows[0]), pa.int32()), pa.array([block] * len(rows[0]), pa.int32()), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    rows = files.select("shard", "block", "payload").mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    out = rows.join(starts, ["shard", "block"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))

"""Best-fit packing by patterns: few-document length patterns whose repeat counts fit the length histogram.

Lengths are counted over all pieces (at most `limit` counts, so the driver may hold them). Patterns of one to three
lengths that fill a sequence exactly are enumerated; non-negative least squares fits how often to repeat each to the
histogram; the counts are rounded down to what is there; what remains is packed best-fit, longest first, on the same
histogram. The plan is a table over lengths: the k-th piece of a length has a fixed place, so pieces find their places
by their rank within their length, which two partial counts give without gathering a length in one task.

Cases: a null text is an empty one, which is its end id alone; null, repeated or negative ids are packed like others;
an empty table gives no rows; columns other than those named are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import token_blocks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Steps of the projected gradient that solves the least squares.
FIT_STEPS = 400


def pieces(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Token pieces of (doc_id, text). A longer document is cut into pieces of `limit` ids; the first may be shorter."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, ids, at in token_blocks(batch.column(1), tokenizer):
                rows = ([], [], [], [], [], [])
                for i in range(len(at) - 1):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    n = len(own)
                    first = n % limit or limit
                    bounds = [0, *range(first, n + 1, limit)]
                    for k in range(len(bounds) - 1):
                        part = own[bounds[k] : bounds[k + 1]]
                        for column, value in zip(rows, (names[lo + i], k, bounds[k], len(part), zlib.crc32(part), part.tobytes() if with_ids else None), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def patterns(lengths: np.ndarray, limit: int) -> np.ndarray:
    """All multisets of one to three of the lengths that sum to limit, as rows of three with 0 for none.

    With more than 2,048 distinct lengths only pairs are enumerated, for there would be millions of triples."""
    have = np.zeros(limit + 1, bool)
    have[lengths] = True
    out = [np.array([[limit, 0, 0]])] if have[limit] else []
    a = lengths[(lengths <= limit // 2)]
    a = a[have[limit - a]]
    out.append(np.stack((a, limit - a, 0 * a), 1))
    if len(lengths) <= 2048:
        for x in lengths[lengths <= limit // 3]:
            b = lengths[(lengths >= x) & (lengths <= (limit - x) // 2)]
            b = b[have[limit - x - b]]
            out.append(np.stack((np.full_like(b, x), b, limit - x - b), 1))
    return np.concatenate(out)


def fit(pattern: np.ndarray, counts: np.ndarray, limit: int) -> np.ndarray:
    """Repeat counts >= 0 that bring the patterns' lengths closest to the histogram, by accelerated projected gradient.

    An unpacked long piece wastes more than a short one, so residuals weigh as the lengths do."""
    weight = np.sqrt(np.arange(limit + 1) / limit)
    weight[0] = 0
    scale = max(counts.max(), 1)
    target = weight * counts / scale

    def forward(x):
        return weight * sum(np.bincount(pattern[:, j], x, limit + 1) for j in range(3))

    def back(r):
        r = weight * r
        return r[pattern[:, 0]] + r[pattern[:, 1]] + r[pattern[:, 2]]

    v = np.ones(len(pattern))
    for _ in range(12):
        v = back(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pattern))
    t = 1.0
    for _ in range(FIT_STEPS):
        new = np.maximum(0, y - back(forward(y) - target) / (1.02 * top))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def best_fit(left: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such) for the counts that are left, longest first into the fullest that fits."""
    open_: dict[int, list[list]] = {limit: []}  # room -> [lengths, number]
    rooms: list[int] = []
    done = []

    def put(lengths, room, number):
        if number and room:
            if room not in open_ or not open_[room]:
                insort(rooms, room)
            open_.setdefault(room, []).append([lengths, number])
        elif number:
            done.append((lengths, number))

    for length in range(limit, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                lengths, number = open_[room].pop()
                if not open_[room]:
                    rooms.pop(at)
            else:
                room, lengths, number = limit, (), n
            each = min(room // length, n)
            full = min(number, n // each)
            put(lengths, room, number - full if lengths else 0)
            put(lengths + (length,) * each, room - each * length, full)
            n -= full * each
    return done + [(tuple(x), k) for groups in open_.values() for x, k in groups]


def plan(histogram: dict[int, int], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places by length and rank: sorted keys (length << 40 | first rank), first sequence and offset of each, and
    how many sequences the patterns and the remainder took."""
    counts = np.zeros(limit + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    left, made = counts.copy(), []
    lengths = np.flatnonzero(counts)
    if len(lengths):
        rows = patterns(lengths, limit)
        if len(rows):
            repeat = fit(rows, counts.astype(float), limit)
            for i in np.argsort(-repeat, kind="stable"):
                if repeat[i] < 0.5:
                    break
                row = rows[i][rows[i] > 0]
                own, many = np.unique(row, return_counts=True)
                n = int(min(round(repeat[i]), (left[own] // many).min()))
                if n > 0:
                    left[own] -= many * n
                    made.append((tuple(sorted(row.tolist(), reverse=True)), n))
    fitted = sum(n for _, n in made)
    made += best_fit(left, limit)
    used = np.zeros(limit + 1, np.int64)
    places, sequence = [], 0
    for row, n in made:
        offset = 0
        for length in row:
            places.append(((length << 40) | int(used[length]), sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    assert (used == counts).all()
    places = np.array(sorted(places), np.int64).reshape(-1, 3)
    return places[:, 0], places[:, 1], places[:, 2], np.array([fitted, sequence - fitted])


def ranked(rows: DataFrame, counts: dict[int, int], key: str, tie: list[str]) -> DataFrame:
    """Number the rows of each key from 0, as `rank`. counts: rows by key, of a bounded number of keys.

    Each key's rows are salted into about the square root of their number; salts are counted, and the counts before
    a salt plus a row's number within it are its rank. No task holds more than a key's square root."""
    import pyarrow as pa

    # as an Arrow table: from a list of rows, Spark would make it in Python workers of another kind, which then stay beside the others
    salts = pa.table({key: pa.array(list(counts), pa.int64()), "salts": pa.array([int(n**0.5) + 1 for n in counts.values()], pa.int64())})
    salts = rows.sparkSession.createDataFrame(salts)
    rows = rows.join(F.broadcast(salts), key).withColumn("salt", F.expr(f"pmod(xxhash64({', '.join(tie)}), salts)")).drop("salts")
    before = Window.partitionBy(key).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(key, "salt").count().select(key, "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy(key, "salt").orderBy(*tie)
    return rows.withColumn("_n", F.row_number().over(own)).join(base, [key, "salt"]).withColumn("rank", F.col("base") + F.col("_n") - 1).drop("_n", "base", "salt")


def pack(table: DataFrame, limit: int = 1024) -> DataFrame:
    """Give each piece of a written table (doc_id, piece, start, length, ids_crc32, ...) its sequence_id and offset."""
    counts = {int(r[0]): int(r[1]) for r in table.groupBy("length").count().collect()}  # at most `limit` rows
    keys, first, offset, _ = plan(counts, limit)
    starts = keys & ((1 << 40) - 1)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 40) | rank, "right") - 1
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"}
            columns |= {"sequence_id": pa.array(first[at] + rank - starts[at]), "offset": pa.array(offset[at])}
            yield pa.RecordBatch.from_pydict(columns)

    rows = ranked(table, counts, "length", ["doc_id", "piece", "start", "ids_crc32"])
    rows = rows.select(*table.columns, "rank")
    return rows.mapInArrow(run, rows.drop("rank").schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer: str, limit: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """documents (doc_id, text) -> one row per piece with its sequence and offset; with_ids adds its ids."""
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(scratch.save(pieces(docs, tokenizer, limit, end_id, with_ids), "pieces"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> one row per sequence: its ids (little-endian 32-bit) and its documents in order.

    A sequence holds at most `limit` ids, so its pieces may meet in one task."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", joined.alias("ids"), F.expr("transform(parts, p -> named_struct('doc_id', p.doc_id, 'piece', p.piece, 'offset', p.offset, 'length', p.length))").alias("pieces"))

"""Nearest neighbours by additive quantisation: each vector is a sum of full-dimensional codewords.

Codebooks are fitted on a bounded sample (SAMPLE rows with the smallest hashes of their ids), stage by stage on what
the earlier stages leave; every row is then encoded by beam search over the stages, so a later codeword may correct an
earlier choice. An index row holds the codes, the norm of the decoded vector and the norm of what it misses. A query
looks its inner products with all codewords up in a table, adds those of a row's codes, and the best SHORTLIST rows of
each index block are scored exactly on the original vectors, in double precision. So are all others of the block whose
sum, with MARGIN times the error to be expected from the norm of what the codes miss, reaches the k-th best so found:
how many are opened follows from the codes' errors and not from a fixed number.

Queries and index rows meet block by block: every query block against every index block in a task of its own, of
which only the k best per query leave. A row goes to as many tasks as there are query blocks, so these are large, and
vectors given in single precision travel in it. They travel with the codes: which rows must be opened is known only where
the codes are, and they are too many to be fetched one by one (about 15 in 100 a query and block).

Cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of each length are
searched apart, with codebooks of their own, for there is no inner product between lengths; norms beyond single precision
are scaled by a power of two while codes are made; fewer candidates than k are all returned; ties go to the smaller id; a
row is no candidate of its own id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .vectors import array, matrix, usable

SAMPLE, STAGES, WORDS, BEAM, FIT_ROUNDS = 8192, 8, 256, 4, 6
INDEX_BLOCK, QUERY_BLOCK, SHORTLIST, MARGIN = 8192, 2048, 160, 2.5


def fit(sample: np.ndarray, stages: int = STAGES, words: int = WORDS, seed: int = 5) -> np.ndarray:
    """(stages, words, d) codebooks by k-means on the residuals of a bounded sample."""
    rng = np.random.default_rng(seed)
    left = sample.astype(np.float32).copy()
    words = min(words, len(left))
    books = np.zeros((stages, words, left.shape[1]), np.float32)
    for m in range(stages):
        book = left[rng.choice(len(left), words, replace=False)]
        for _ in range(FIT_ROUNDS):
            near = np.argmin((book * book).sum(1) - 2 * left @ book.T, 1)
            n = np.bincount(near, minlength=words)
            sums = np.zeros_like(book)
            np.add.at(sums, near, left)
            book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], left[rng.integers(len(left), size=words)])
        near = np.argmin((book * book).sum(1) - 2 * left @ book.T, 1)
        left -= book[near]
        books[m] = book
    return books


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by beam search, norms of the decoded vectors, norms of what they miss."""
    stages, words, d = books.shape
    x = x.astype(np.float32)
    n = len(x)
    flat = books.reshape(-1, d)
    dots = (x @ flat.T).reshape(n, stages, words)
    norms = (flat * flat).sum(1).reshape(stages, words)
    gram = flat @ flat.T
    codes = np.zeros((n, 1, 0), np.int64)
    cost = np.zeros((n, 1), np.float32)  # squared norm of what is left, less that of x
    for m in range(stages):
        cross = np.zeros((n, codes.shape[1], words), np.float32)
        for j in range(m):
            cross += gram[j * words + codes[:, :, j], m * words : (m + 1) * words]
        total = cost[:, :, None] + norms[m] - 2 * dots[:, m][:, None, :] + 2 * cross
        total = total.reshape(n, -1)
        keep = min(beam, total.shape[1])
        best = np.argpartition(total, keep - 1, 1)[:, :keep]
        cost = np.take_along_axis(total, best, 1)
        parent, word = best // words, best % words
        codes = np.concatenate((np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]), 2)
    best = np.argmin(cost, 1)
    codes = codes[np.arange(n), best]
    decoded = books[np.arange(stages), codes].sum(1)
    return codes.astype(np.uint8 if words <= 256 else np.int16), np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1)


def index(rows: DataFrame, books: np.ndarray, exponent: int = 0) -> DataFrame:
    """(id, v) -> (id, v, code, norm, missed): every row encoded, at 2**-exponent of its size."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                code, norm, missed = encode(np.ldexp(matrix(part.column(1)).astype(float), -exponent), books)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm, pa.float32()), pa.array(missed, pa.float32())], ["id", "v", "code", "norm", "missed"])

    return small_batches(rows).select("id", "v").mapInArrow(run, f"id long, v {rows.schema['v'].dataType.simpleString()}, code binary, norm float, missed float")


def _search(books: np.ndarray, k: int, shortlist: int, exponent: int):
    stages, words, d = books.shape

    def run(group):
        import pyarrow as pa

        query = array(group.column("asks").cast("int8")) == 1
        ids, v = array(group.column("id")), matrix(group.column("v")).astype(float)
        have, rows = np.flatnonzero(~query), np.flatnonzero(query)
        out = ([], [], [])
        if len(have) and len(rows):
            code = np.frombuffer(b"".join(group.column("code").filter(pa.array(~query)).to_pylist()), np.uint8 if words <= 256 else np.int16).reshape(-1, stages)
            cv, cid = v[have], ids[have]
            error = MARGIN * array(group.column("missed"))[have] / np.sqrt(d)
            for lo in range(0, len(rows), 128):
                own = rows[lo : lo + 128]
                q = v[own]
                small = np.ldexp(q, -exponent)
                table = np.einsum("qd,mwd->mqw", small.astype(np.float32), books, optimize=True)
                score = np.zeros((len(own), len(have)), np.float32)
                for m in range(stages):
                    score += table[m][:, code[:, m]]
                keep = min(len(have), shortlist)
                best = np.argpartition(-score, keep - 1, 1)[:, :keep]
                for i in range(len(own)):
                    first = best[i][cid[best[i]] != ids[own[i]]]
                    exact = cv[first] @ q[i]
                    least = np.partition(exact, len(exact) - k)[len(exact) - k] if len(exact) >= k else -np.inf
                    more = np.flatnonzero(score[i] + np.linalg.norm(small[i]) * error >= np.ldexp(least, -2 * exponent))
                    opened = np.union1d(first, more)
                    exact, names = cv[opened] @ q[i], cid[opened]
                    order = np.lexsort((names, -exact))
                    order = order[names[order] != ids[own[i]]][:k]
                    out[0].append(np.full(len(order), ids[own[i]]))
                    out[1].append(names[order])
                    out[2].append(exact[order])
        columns = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.table({"query_id": pa.array(columns[0]), "vec_id": pa.array(columns[1]), "score": pa.array(columns[2])})

    return run


def search(df: DataFrame, queries: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """The k rows of df with the largest inner product for each row that meets the SQL condition `queries` on id."""
    spark = df.sparkSession
    scratch = Scratch(spark, "addquant")
    rows = usable(df, id_col, vector_col)
    if df.schema[vector_col].dataType.simpleString() == "array<float>":
        rows = rows.withColumn("v", F.col("v").cast("array<float>"))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), largest.alias("largest")).orderBy(F.desc("n"), "d").collect()  # a row a length
    found = [_of_length(rows.where(F.size("v") == d), n, int(np.frexp(most)[1]), queries, k, shortlist, scratch, f"index{d}") for d, n, most in sizes if n > 1]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.union, found)


def _of_length(rows: DataFrame, total: int, exponent: int, queries: str, k: int, shortlist: int, scratch: Scratch, name: str) -> DataFrame:
    # the sample's bound is SAMPLE rows
    sample = np.array([r[0] for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE).collect()], float)
    books = fit(np.ldexp(sample, -exponent))
    coded = scratch.save(index(rows, books, exponent), name, "none")
    asked = coded.where(queries).select("id", "v")
    blocks, asks = max(1, -(-total // INDEX_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    # every index block meets every query block: one row of a block for each block of the other side
    have = coded.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("b"), F.explode(F.expr(f"sequence(0L, {asks - 1}L)")).alias("a"), F.lit(0).alias("asks"), "id", "v", "code", "missed")
    want = asked.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("b"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(asks)).alias("a"), F.lit(1).alias("asks"), "id", "v", F.lit(None).cast("binary").alias("code"), F.lit(0.0).cast("float").alias("missed"))
    found = have.union(want).groupBy("a", "b").applyInArrow(_search(books, k, shortlist, exponent), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

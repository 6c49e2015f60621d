"""Near-duplicate vectors of a label by binary codes of a random rotation.

A unit vector o is rotated and replaced by its signs, a unit vector b; f = <b, o> is stored as its correction factor.
With s = <b, q>, s / f estimates <o, q> without bias, with standard error sqrt((1 - f^2) / (f^2 (d - 1))) over
rotations; and f s + sqrt((1 - f^2) (1 - s^2)) is a bound that always holds. A pair goes on unless one of both bounds puts
it under the threshold (the estimate by CONFIDENCE standard errors, which is more than it can err by in up to 65
dimensions and a matter of probability beyond).

Beside its signs a vector's record holds the rotated vector in 16-bit steps and how far these are from it. They bound a
pair's cosine from both sides by about 1e-4: what lies clearly above is a link, what lies clearly below is none, and only
pairs in between are recomputed exactly, in double precision, on the original vectors, which are fetched for them alone.
Records are made once and are all that travels between blocks.

Equal vectors of a label are one class with a count. Classes of a label are dealt into blocks of bounded size, and
pairs of blocks are compared in one task each; what leaves a task is each class's number of links, a spanning
forest and the pairs in between, so no list of all pairs exists. The work is the square of a label's classes divided by
the block size in tasks: vectors of many dimensions give no exact way to leave out block pairs.

Cases: vectors that are null, zero or hold null or non-finite components, rows of a null label or of a null id have
no links and are their own component; vectors of any size, however large or small, are scaled by powers of two first;
vectors of different lengths do not link; repeated ids are one vector each in n_links and one node in components; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, small_batches
from .vectors import USABLE, array, matrix, usable

BLOCK = 2048
CONFIDENCE = 8.0


def rotation(d: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated unit vectors, packed sign bits, correction factors)."""
    turned = unit @ rotation(unit.shape[1])
    bits = turned >= 0
    factor = np.abs(turned).sum(1) / np.sqrt(unit.shape[1])
    return turned.astype(kind), np.packbits(bits, axis=1), factor


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest components lie between 1/2 and 1: cosines stay as they are."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def candidates(turned: np.ndarray, bits: np.ndarray, factor: np.ndarray, least: float, error: np.ndarray | float = 0.0) -> np.ndarray:
    """Which pairs (query row, code row) may reach the threshold; error: how far the query rows are from the rotated vectors."""
    d = turned.shape[1]
    signs = np.unpackbits(bits, axis=1, count=d).astype(np.float32) * 2 - 1
    s = turned.astype(np.float32) @ signs.T / np.float32(np.sqrt(d))
    f = np.minimum(factor, 1).astype(np.float32)[None, :]
    lost = np.sqrt(np.maximum(0, 1 - f * f))
    error = np.broadcast_to(np.asarray(error, np.float32), len(turned))[:, None]
    # the bound is largest where s, known but for the error, is nearest to f
    near = np.clip(f, s - error, s + error)
    always = f * near + lost * np.sqrt(np.maximum(0, 1 - near * near))
    likely = (s + error) / f + CONFIDENCE * lost / f / np.float32(np.sqrt(max(d - 1, 1)))
    return np.minimum(always, likely) >= least - 1e-4


def records(classes: DataFrame) -> DataFrame:
    """(key, v) -> (key, bits, steps, step, factor, error) of every class: all that comparing blocks needs."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                turned, bits, factor = codes(unit(matrix(part.column(1))), float)
                step = np.abs(turned).max(1) / 32767
                whole = np.rint(turned / step[:, None]).astype("<i2")
                error = np.linalg.norm(turned - whole * step[:, None], axis=1) + 1e-12
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array([x.tobytes() for x in whole], pa.binary()), *(pa.array(x) for x in (step, factor, error))], ["key", "bits", "steps", "step", "factor", "error"])

    return small_batches(classes).select("key", "v").mapInArrow(run, "key long, bits binary, steps binary, step double, factor double, error double")


def _compare(least: float):
    def run(group):
        import pyarrow as pa

        get = lambda name: array(group.column(name))
        i, j, own, keys, ids, copies, error = (get(c) for c in ("block", "other", "i", "key", "cid", "c", "error"))
        raw = lambda name, kind: np.frombuffer(b"".join(group.column(name).to_pylist()), kind).reshape(len(keys), -1)
        bits, turned = raw("bits", np.uint8), raw("steps", "<i2") * get("step")[:, None]
        left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
        a, b = np.nonzero(candidates(turned[left], bits[right], get("factor")[right], least, error[left] + 1e-5))
        a, b = left[a], right[b]
        if i[0] == j[0]:
            a, b = a[a < b], b[a < b]
        near = np.concatenate([np.einsum("ij,ij->i", turned[a[k : k + 65536]], turned[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)])
        slack = error[a] + error[b] + error[a] * error[b]
        open_ = np.abs(near - least) <= slack
        between = a[open_], b[open_]
        a, b = a[near - least > slack], b[near - least > slack]
        links = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        root = np.arange(len(ids))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        some, m = np.flatnonzero(links), len(between[0])
        whole = lambda x, y, t: pa.concat_arrays([pa.array(x, t), pa.nulls(m, t) if y is None else pa.array(y, t)])
        n = len(some)
        return pa.table({"key": whole(keys[some], keys[between[0]], pa.int64()), "links": whole(links[some].astype(np.int64), None, pa.int64()), "cid": whole(ids[some], None, pa.int64()), "root": whole(ids[root[some]], None, pa.int64()), "open": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys[between[1]], pa.int64())])})

    return run


def cosines(pairs: DataFrame) -> DataFrame:
    """Adds the cosine of the vectors v and w, in double precision."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = [batch.schema.get_field_index(c) for c in ("v", "w")]
            out = np.zeros(batch.num_rows)
            lengths = np.asarray(batch.column(at[0]).value_lengths())
            for d in np.unique(lengths):
                v, w = (scaled(matrix(batch.column(k).filter(pa.array(lengths == d)))) for k in at)
                out[lengths == d] = np.einsum("ij,ij->i", v, w) / (np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(np.einsum("ij,ij->i", w, w)))
            keep = [k for k in range(batch.num_columns) if k not in at]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(out)], [*(batch.schema.names[k] for k in keep), "cosine"])

    return small_batches(pairs).mapInArrow(run, pairs.drop("v", "w").schema.add("cosine", "double"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per row of df: (id, n_links, component_id, kept), by cosine >= least within a label."""
    scratch = Scratch(df.sparkSession, "nearvec")
    rows = usable(df, id_col, vector_col, F.col(label_col).alias("label")).where("label is not null").withColumn("d", F.size("v"))
    classes = rows.groupBy("label", "d", "v").agg(F.min("id").alias("cid"), F.count("*").alias("c"))
    # the numbers are written with the table, so later reads agree on them
    classes = scratch.save(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    sizes = classes.groupBy("label", "d").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    codes_ = scratch.save(records(classes), "records", "none")
    blocks = classes.select("label", "d", "key", "cid", "c").join(codes_, "key").join(sizes, ["label", "d"]).withColumn("i", F.pmod(F.xxhash64("key"), "blocks"))
    pairs = blocks.withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("label", "d", F.least("i", "k").alias("block"), F.greatest("i", "k").alias("other"), "i", "key", "cid", "c", "bits", "steps", "step", "factor", "error")
    found = pairs.groupBy("label", "d", "block", "other").applyInArrow(_compare(least), "key long, links long, cid long, root long, open long")
    found = scratch.save(found, "found")

    side = lambda name: classes.select(F.col("key").alias(f"{name}_key"), F.col("cid").alias(f"{name}_cid"), F.col("c").alias(f"{name}_c"), F.col("v").alias(name))
    between = found.where("open is not null").select(F.col("key").alias("v_key"), F.col("open").alias("w_key"))
    exact = cosines(between.join(side("v"), "v_key").join(side("w"), "w_key")).where(F.col("cosine") >= least)
    exact = scratch.save(exact.drop("cosine"), "exact")

    edges = found.where("open is null").select(F.col("cid").alias("u"), F.col("root").alias("v")).union(exact.select("v_cid", "w_cid"))
    comp = components(edges, scratch)
    links = found.where("open is null").select("key", "links").union(exact.select("v_key", "w_c")).union(exact.select("w_key", "v_c")).groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.join(links, "key", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    known = known.select("label", "d", "v", (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    usual = rows.join(known, ["label", "d", "v"]).select("id", "n_links", "component_id")
    rest = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rest = rest.where(f"not coalesce(({USABLE}) and label is not null, false)").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = usual.union(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))

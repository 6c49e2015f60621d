"""Whitening of vectors by an incremental eigendecomposition.

Each partition keeps the mean and the spectrum of the scatter of its rows: every row is one centred rank-one update,
whose new eigenvalues are the roots of a secular equation, after deflation (directions that the update does not touch, or
that share an eigenvalue, stay as they are). The partitions' spectra are combined in a tree of bounded fan-in: one is put
into another by as many rank-one updates as it has directions, and one for the difference of the means. A last distributed
pass is a Rayleigh-Ritz refinement: the covariance of all rows within the basis found, centred with exact integer sums, is
summed over partitions, and its own small eigenproblem turns the basis into eigenvectors to double precision.

Entries become integers x = floor(1024 c) + 100000 first. What is broadcast is one basis of d by d numbers a vector length d.

Cases: vectors that are null, empty or hold null or non-finite entries (or entries of 2**42 and more in size, whose x a
double cannot hold) are dropped; a null id or a repeated row is a row like others; vectors of different lengths are
fitted apart, each length with its own n; eigenvalues tied to working precision have some orthonormal eigenvectors;
directions without variance (eigenvalue up to 1e-12 of the trace) cannot be whitened and give no component, so one row, or
equal rows, give none; a deviation that no long holds is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

EPS = np.finfo(float).eps
#: Spectra that one task combines.
FAN_IN = 16
SCALE, SHIFT, LIMIT, FLAT = 1024.0, 100_000.0, 2.0**42, 1e-12
SPECTRUM = "d int, part long, n long, mean binary, values binary, basis binary"


# ---------------------------------------------------------------- one rank-one update


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + rho * sum(z2 / (d - t)) = 0 for ascending distinct d: (number of the pole each is measured from, distance).

    All roots at once, by rational interpolation through the two poles around each, within a bracket that shrinks."""
    k = len(d)
    top = d[-1] + rho * z2.sum()
    right = np.append(d[1:], top)
    gap = right - d
    rows = np.arange(k)
    # which pole is nearer: the sign of the function in the middle of the interval
    middle = 1 + rho * (z2 / ((d - d[:, None]) - (gap / 2)[:, None])).sum(1)
    near = np.where((middle >= 0) | (rows == k - 1), rows, rows + 1)
    delta = d - d[near][:, None]
    left_near = near == rows
    low = np.where(left_near, 0.0, -gap / 2)
    high = np.where(left_near, np.where((rows == k - 1) & (middle < 0), gap, gap / 2), 0.0)
    low[-1] = gap[-1] / 2 if middle[-1] < 0 else 0.0
    t = (low + high) / 2
    upto = np.arange(k) <= rows[:, None]
    one, two = np.minimum(rows, max(k - 2, 0)), np.minimum(rows + 1, k - 1)
    if k > 1:
        upto[-1, -1] = False
    else:
        two = one
    done = np.zeros(k, bool)
    for _ in range(60):
        gaps = delta - t[:, None]
        part = rho * z2 / gaps
        f = 1 + part.sum(1)
        size = 1 + np.abs(part).sum(1)
        done |= np.abs(f) <= 8 * EPS * size
        low, high = np.where(f < 0, t, low), np.where(f > 0, t, high)
        if done.all():
            break
        steep = part / gaps
        psi = np.where(upto, steep, 0).sum(1)
        phi = steep.sum(1) - psi
        if k == 1:
            step = -f / (psi + phi)
        else:
            a1, a2 = gaps[rows, one], gaps[rows, two]
            a = (a1 + a2) * f - a1 * a2 * (psi + phi)
            b = a1 * a2 * f
            c = f - a1 * psi - a2 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            with np.errstate(all="ignore"):
                step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
                last = (a[-1] + root[-1]) / (2 * c[-1]) if a[-1] >= 0 else 2 * b[-1] / (a[-1] - root[-1])
            step[-1] = last
        new = t + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        new = np.where(done, t, np.where(inside, new, (low + high) / 2))
        done |= np.abs(new - t) <= 2 * EPS * np.abs(t)
        t = new
    return near, t


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and eigenvectors (columns) of basis * diag(values) * basis' + rho v v', rho > 0."""
    z = v @ basis
    norm = np.sqrt(z @ z)
    if rho * norm * norm == 0:
        return values, basis
    z, rho = z / norm, rho * norm * norm
    scale = max(values[-1], rho)
    tol = 8 * EPS * scale
    # directions of one eigenvalue: a reflection puts all of z within them on the last one
    starts = np.flatnonzero(np.append(True, np.diff(values) > tol))
    if len(starts) < len(values):
        basis = basis.copy()
        for lo, hi in zip(starts, np.append(starts[1:], len(values)), strict=True):
            own = z[lo:hi].copy()
            size = np.sqrt(own @ own)
            if hi - lo > 1 and size > 0:
                w = own.copy()
                w[-1] += size if own[-1] >= 0 else -size
                w /= np.sqrt(w @ w)
                basis[:, lo:hi] -= 2 * np.outer(basis[:, lo:hi] @ w, w)
                z[lo:hi] = 0
                z[hi - 1] = -size if own[-1] >= 0 else size
    use = rho * np.abs(z) > tol
    if not use.any():
        return values, basis
    d, own = values[use], z[use]
    near, t = secular_roots(d, own * own, rho)
    # distances of poles and roots without cancellation, then the z whose exact roots these are, so that vectors are orthogonal
    gaps = (d[near] - d[:, None]) + t  # [pole, root]
    k = len(d)
    between = d - d[:, None]
    under = np.where(np.arange(k)[None, :] < np.arange(k)[:, None], between, np.append(between[:, 1:], np.full((k, 1), rho), 1))
    fitted = np.sqrt(np.abs(np.prod(gaps / under, 1)))
    fitted = np.where(own < 0, -fitted, fitted)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = fitted[:, None] / gaps
    exact = ~np.isfinite(w).all(0)
    if exact.any():  # a root on its pole, as close as doubles tell
        w[:, exact] = np.eye(k)[:, near[exact]]
    w /= np.sqrt((w * w).sum(0))
    values, basis = values.copy(), basis.copy()
    values[use] = d[near] + t
    basis[:, use] = basis[:, use] @ w
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Number, mean, and eigenvalues and eigenvectors of the scatter of rows."""

    def __init__(self, d: int):
        self.n, self.mean, self.values, self.basis = 0, np.zeros(d), np.zeros(d), np.eye(d)

    def add(self, row: np.ndarray) -> None:
        away = row - self.mean
        if self.n:
            self.values, self.basis = rank_one(self.values, self.basis, away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        if not self.n or not other.n:
            if other.n:
                self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        away, n = other.mean - self.mean, self.n + other.n
        for value, v in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.values, self.basis = rank_one(self.values, self.basis, v, value)
        self.values, self.basis = rank_one(self.values, self.basis, away, self.n * other.n / n)
        self.mean, self.n = self.mean + away * (other.n / n), n

    def row(self, part: int) -> tuple:
        return len(self.mean), part, self.n, self.mean.tobytes(), self.values.tobytes(), np.ascontiguousarray(self.basis).tobytes()

    @classmethod
    def of(cls, row) -> Spectrum:
        out = cls(row[0])
        out.n, out.mean, out.values = row[2], np.frombuffer(row[3]), np.frombuffer(row[4])
        out.basis = np.frombuffer(row[5]).reshape(row[0], row[0])
        return out


# ---------------------------------------------------------------- rows


def integers(batch):
    """Yield (row numbers, x as doubles) for each vector length of an Arrow batch whose last column is the vector."""
    lists = batch.column(batch.num_columns - 1)
    ends = np.asarray(lists.offsets)
    flat = np.asarray(lists.values)
    sizes = np.diff(ends)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, np.floor(SCALE * flat[ends[at][:, None] + np.arange(d)]) + SHIFT


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    return small_batches(df.select(F.col(id_col).alias("id"), v.alias("v")).where((F.size("v") > 0) & whole))


def totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (n, exact sums of x)}."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for _, x in integers(batch):
                sums = [str(s) for s in (x.sum(0).astype(int) if np.abs(x).max() * len(x) < 2.0**52 else x.astype(object).sum(0)).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([len(sums)] * len(sums), pa.int32()), pa.array(range(len(sums)), pa.int32()), pa.array([len(x)] * len(sums), pa.int64()), pa.array([str(int(float(s))) if "." in s else s for s in sums])], ["d", "i", "n", "s"])

    parts = rows.select("v").mapInArrow(run, "d int, i int, n long, s string")
    out: dict = {}
    for d, _, n, s in parts.groupBy("d", "i").agg(F.sum("n"), F.sum(F.col("s").cast("decimal(38,0)"))).orderBy("d", "i").collect():  # as many rows as dimensions
        out.setdefault(d, (n, []))[1].append(int(s))
    return out


def spectra(rows: DataFrame, scratch: Scratch) -> dict[int, Spectrum]:
    """{length: the spectrum of all rows}, by rank-one updates within partitions and a tree of merges."""

    def grow(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own: dict = {}
        for batch in batches:
            for _, x in integers(batch):
                state = own.setdefault(x.shape[1], Spectrum(x.shape[1]))
                for row in x:
                    state.add(row)
        part = TaskContext.get().partitionId()
        for state in own.values():
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(state.row(part), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["d", "part", "n", "mean", "values", "basis"])

    def combine(key, table):
        import pyarrow as pa

        whole = Spectrum(key[0].as_py())
        for row in sorted(zip(*(table.column(c).to_pylist() for c in ("d", "from", "n", "mean", "values", "basis")), strict=True)):
            whole.merge(Spectrum.of(row))
        return pa.table([pa.array([v], t) for v, t in zip(whole.row(key[1].as_py()), (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["d", "part", "n", "mean", "values", "basis"])

    parts, turn = scratch.save(rows.select("v").mapInArrow(grow, SPECTRUM), "spectra0"), 0
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        turn += 1
        grouped = parts.withColumnRenamed("part", "from").withColumn("part", F.floor(F.col("from") / FAN_IN).cast("long"))
        parts = scratch.save(grouped.groupBy("d", "part").applyInArrow(combine, SPECTRUM), f"spectra{turn}")
        scratch.drop(f"spectra{turn - 1}")
    return {r[0]: Spectrum.of(r) for r in parts.collect()}  # one row a length


def gram(rows: DataFrame, bases: dict[int, np.ndarray], sums: dict) -> dict[int, np.ndarray]:
    """{length: covariance of all centred rows after the basis is applied}."""

    def run(batches):
        import pyarrow as pa

        own = {d: np.zeros((b.shape[1], b.shape[1])) for d, b in bases.items()}
        for batch in batches:
            for _, x in integers(batch):
                d = x.shape[1]
                y = centred(x, *sums[d]) @ bases[d]
                own[d] += y.T @ y
        for d, h in own.items():
            i, j = np.triu_indices(len(h))
            if h.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(h[i, j])], ["d", "i", "j", "h"])

    out = {d: np.zeros((b.shape[1], b.shape[1])) for d, b in bases.items()}
    parts = rows.select("v").mapInArrow(run, "d int, i int, j int, h double")
    for d, i, j, h in parts.groupBy("d", "i", "j").agg(F.sum("h")).collect():  # half of d * d rows
        out[d][i, j] = out[d][j, i] = h / sums[d][0]
    return out


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """x - S / n, from whole quotients and remainders, so that nothing is lost between large numbers."""
    whole = np.array([v // n for v in s], float)
    return (x - whole) - np.array([v % n for v in s], float) / n


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n x - S) ** 2; None where a long cannot hold it."""
    far = np.abs(centred(x, n, s)).max() * n + 1
    if far * far * len(s) < 2.0**62 and abs(n) * np.abs(x).max() < 2.0**62:
        y = n * x.astype(np.int64) - np.array(s, np.int64)
        return (y * y).sum(1).tolist()
    exact = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and leading component."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(df, id_col, vector_col)
    scratch = Scratch(df.sparkSession, "whitening")
    sums = totals(rows)
    bases = {d: np.linalg.qr(s.basis)[0] for d, s in spectra(rows, scratch).items()}
    model = {}
    for d, h in gram(rows, bases, sums).items():
        values, turn = np.linalg.eigh(h)
        order = np.argsort(-values, kind="stable")[:most]
        order = order[values[order] > FLAT * np.trace(h)]
        u = bases[d] @ turn[:, order]
        u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
        model[d] = (u / np.sqrt(values[order]), values[order] / np.trace(h) if len(order) else values[order])
    check = gram(rows, {d: m[0] for d, m in model.items()}, sums)
    error = {d: float(np.abs(h - np.eye(len(h))).max()) if len(h) else 0.0 for d, h in check.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in integers(batch):
                d = x.shape[1]
                n, s = sums[d]
                axes, share = model[d]
                k, m = axes.shape[1], len(at)
                if not k:
                    continue
                y = centred(x, n, s) @ axes
                away = pa.array(deviations(x, n, s), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), away, pa.array(y.reshape(-1)), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error[d]))], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("id").alias(id_col), "v").mapInArrow(run, schema)

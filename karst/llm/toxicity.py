"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of 3 to 6 bytes of its lower-cased words (letters, digits and wider bytes; each
word with a space on both sides), hashed to 2**BITS numbers. The classifier is fitted on a bounded sample: the SAMPLE
labelled ids of each class with the smallest hashes. Their documents are found without moving any text: the sampled ids, at
most 2 * SAMPLE, are broadcast. In how many documents of each class a feature occurs is counted by Spark; the log-count ratio
r of these counts scales the feature in a logistic regression. A score is the logistic of the sum of r * w * value over the
distinct n-grams of the whole text.

A feature's value in a text is log(1 + RATE * its count / the text's words), so that a word that comes once by chance in a
long text weighs less than one that keeps coming. A ratio that is less than SURE standard errors from zero is taken as
zero: what the classes share says nothing, and a long text would otherwise add up thousands of such nothings.

Cases: a null text is an empty one and scores like any text without words; without labels of both classes every score is
0.5; rows with a null id are scored but not learned from; labels with a null mark or id are left out, and of several
labels of one id the larger mark counts; repeated rows are scored alike; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, utf8_blocks

#: The bound of the sample that the classifier is fitted on, ids a class.
SAMPLE = 4000
BITS, SIZES, SURE, SMOOTH, RIDGE, FIT_STEPS, RATE = 18, (3, 4, 5, 6), 3.0, 1.0, 1e-3, 300, 300
WIDTH = 1 << BITS


def _words():
    """Byte -> lower case for letters, itself for digits and bytes of wider characters, a space for the rest."""
    to = np.full(256, 0x20, np.uint8)
    for c in range(0x41, 0x5B):
        to[c] = to[c + 32] = c + 32
    to[0x30:0x3A] = np.arange(0x30, 0x3A)
    to[0x80:] = np.arange(0x80, 0x100)
    return to


WORDS = _words()


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature numbers of the n-grams of a block, where each row's start, words of each row).

    An n-gram may begin or end with a space, not hold one inside."""
    n = len(offsets) - 1
    b = np.full(len(data) + 2 * n, 0x20, np.uint8)
    b[np.repeat(np.arange(n), np.diff(offsets)) * 2 + np.arange(len(data)) + 1] = WORDS[data]
    first = offsets[:-1] + 2 * np.arange(n)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    keep[first] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    b, starts = b[keep].astype(np.uint64), kept[np.append(first, len(keep))]
    # each row ends with a space of its own, so the next space at or after i + 1 lies in the same row as i
    spaces = np.append(np.flatnonzero(b == 0x20), len(b) + 8)
    reach = spaces[np.searchsorted(spaces, np.arange(1, len(b) + 1))] - np.arange(len(b)) + 1
    last = np.zeros(len(b), bool)
    last[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    reach[last] = 0
    out = np.zeros((len(b), len(SIZES)), np.int32)
    ok = np.zeros((len(b), len(SIZES)), bool)
    for j, size in enumerate(SIZES):
        m = len(b) - size + 1
        if m <= 0:
            continue
        packed = np.zeros(m, np.uint64)
        for k in range(size):
            packed |= b[k : k + m] << np.uint64(8 * k)
        out[:m, j] = ((packed + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        ok[:m, j] = reach[:m] >= size
    total = np.concatenate(([0], np.cumsum(ok.sum(1))))
    begins = np.concatenate(([0], np.cumsum((b[1:] != 0x20) & (b[:-1] == 0x20)), [0]))
    begins[-1] = begins[-2] if len(begins) > 1 else 0
    return out[ok], total[starts], np.diff(begins[starts])


def distinct(features: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The same numbers once each; `place` is any array of WIDTH numbers to work in."""
    at = np.arange(len(features), dtype=place.dtype)
    place[features] = at
    return features[place[features] == at]


def values(column, use: np.ndarray):
    """Yield (row, distinct features among those marked in `use`, their values) for every text of an Arrow column."""
    for lo, hi, data, offsets in utf8_blocks(column):
        grams, at, words = ngrams(data, offsets)
        marked = use[grams]
        at = np.concatenate(([0], np.cumsum(marked)))[at]
        grams = grams[marked]
        for i in range(hi - lo):
            features, counts = np.unique(grams[at[i] : at[i + 1]], return_counts=True)
            yield lo + i, features, np.log1p(RATE * counts / max(1, words[i]))


def class_counts(labelled: DataFrame) -> DataFrame:
    """(feature, toxic, n): in how many documents (text, toxic) of a class each feature occurs; feature -1 counts the documents."""

    def run(batches):
        import pyarrow as pa

        counts, place = np.zeros((2, WIDTH + 1), np.int64), np.zeros(WIDTH, np.int64)
        for batch in batches:
            toxic = np.asarray(batch.column(1))
            for lo, hi, data, offsets in utf8_blocks(batch.column(0)):
                grams, at, _ = ngrams(data, offsets)
                for i in range(hi - lo):
                    counts[toxic[lo + i], distinct(grams[at[i] : at[i + 1]], place) + 1] += 1
                    counts[toxic[lo + i], 0] += 1
        for mark in (0, 1):
            at = np.flatnonzero(counts[mark])
            for lo in range(0, len(at), 1 << 16):
                own = at[lo : lo + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(own - 1), pa.array(np.full(len(own), mark, np.int32)), pa.array(counts[mark, own])], ["feature", "toxic", "n"])

    parts = small_batches(labelled).select("text", F.col("toxic").cast("int")).mapInArrow(run, "feature long, toxic int, n long")
    return parts.groupBy("feature", "toxic").agg(F.sum("n").alias("n"))


def ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-count ratios of features from (2 x WIDTH) counts and the number of documents of each class; zero where not sure."""
    p, q = counts[1] + SMOOTH, counts[0] + SMOOTH
    r = np.log(p / (totals[1] + 2 * SMOOTH)) - np.log(q / (totals[0] + 2 * SMOOTH))
    error = np.sqrt(1 / p + 1 / q)
    return np.where(np.abs(r) > SURE * error, r, 0.0)


class Model:
    """One number a feature, r * w, and an offset."""

    def __init__(self, weights: np.ndarray, offset: float):
        self.weights, self.offset, self.use = weights, offset, weights != 0


def fit(features: list[np.ndarray], value: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray) -> Model:
    """Logistic regression on features of which some are in each text, scaled by their ratios; classes weigh alike.

    Accelerated gradient, with the largest curvature found by power iteration as the step's bound."""
    use, at = np.unique(np.concatenate(features), return_inverse=True)
    row, n, width = np.repeat(np.arange(len(features)), [len(f) for f in features]), len(features), len(use)
    value = np.concatenate(value) * ratio[use][at]
    weight = np.where(toxic == 1, 0.5 / (toxic == 1).sum(), 0.5 / (toxic == 0).sum())
    sign = np.where(toxic == 1, 1.0, -1.0)

    def scores(w):
        return np.bincount(row, value * w[at], n) + w[-1]

    def back(slope):
        return np.append(np.bincount(at, value * slope[row], width), slope.sum())

    u = np.ones(width + 1)
    for _ in range(20):
        u = back(weight * scores(u / np.linalg.norm(u)))
    step = 1 / (np.linalg.norm(u) / 3 + RIDGE)
    w = y = np.zeros(width + 1)
    t = 1.0
    for _ in range(FIT_STEPS):
        slope = weight * sign / (1 + np.exp(np.clip(sign * scores(y), -50, 50)))
        g = back(slope) - RIDGE * np.append(y[:-1], 0)
        new = y + step * g
        turn = g @ (new - w) < 0
        t2 = 1.0 if turn else (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (0 if turn else (t - 1) / t2) * (new - w)
        w, t = new, t2
    weights = np.zeros(WIDTH)
    weights[use] = w[:-1] * ratio[use]
    return Model(weights, float(w[-1]))


def sample(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the documents of at most SAMPLE ids of each class, those with the smallest hashes, of (doc_id, toxic)."""
    there = marks.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", F.lit(13)))
    few = [there.where(F.col("toxic") == mark).orderBy("h", "doc_id").limit(SAMPLE) for mark in (0, 1)]
    ids = [tuple(r) for part in few for r in part.select("doc_id", "toxic").collect()]  # 2 * SAMPLE at most
    known = docs.sparkSession.createDataFrame(ids, marks.select("doc_id", "toxic").schema)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def train(labelled: DataFrame) -> Model | None:
    """Fit a model on a sample (doc_id, text, toxic 0 or 1); None without both classes."""
    counts, totals = np.zeros((2, WIDTH), np.int64), np.zeros(2, np.int64)
    table = class_counts(labelled).toArrow()  # at most 2 * (WIDTH + 1) rows at any size
    feature, mark, n = (np.asarray(table.column(i).combine_chunks()) for i in range(3))
    totals[mark[feature < 0]] = n[feature < 0]
    counts[mark[feature >= 0], feature[feature >= 0]] = n[feature >= 0]
    if not totals.all():
        return None
    ratio = ratios(counts, totals)
    use = ratio != 0

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = [(f.astype("<i4").tobytes(), v.tobytes()) for _, f, v in values(batch.column(1), use)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in own], pa.binary()) for i in (0, 1)), batch.column(2)], ["h", "features", "vals", "toxic"])

    sized = labelled.select(F.xxhash64("doc_id", "text", F.lit(13)).alias("h"), "text", F.col("toxic").cast("int"))
    few = small_batches(sized).mapInArrow(run, "h long, features binary, vals binary, toxic int")
    # ids that have many documents do not make the sample longer: SAMPLE rows a class, of features that are sure
    order = F.row_number().over(Window.partitionBy("toxic", F.pmod("h", F.lit(64))).orderBy("h", "features"))
    few = few.withColumn("place", order).where(F.col("place") <= SAMPLE // 64 * 2)
    rows = sorted(few.select("h", "features", "vals", "toxic").collect(), key=lambda r: (r[3], r[0], r[1]))
    rows = [r for mark in (0, 1) for r in [r for r in rows if r[3] == mark][:SAMPLE]]
    return fit([np.frombuffer(r[1], "<i4") for r in rows], [np.frombuffer(r[2], float) for r in rows], np.array([r[3] for r in rows]), ratio)


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """Add score to the given columns of documents, from text alone."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            score = np.full(len(batch), 0.5)
            if model is not None:
                for row, features, value in values(batch.column(0), model.use):
                    score[row] = 1 / (1 + np.exp(-np.clip(model.weights[features] @ value + model.offset, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])

    return small_batches(docs).select(F.col("text").alias("karst text"), *columns).mapInArrow(run, docs.select(*columns).schema.add("score", "double"))


def held_out():
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Train on the labelled documents that are not held out and score all: doc_id, held_out, score, predicted."""
    marks = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    out = predict(docs.select("doc_id", "text").withColumn("held_out", held_out()), train(sample(docs, marks)), ["doc_id", "held_out"])
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Language identification in two steps: the family first, then one-versus-one linear support vector machines.

Features are counts of hashed 3- and 4-byte n-grams of the lower-cased letters of the whole text. Families are learned:
languages whose mean profiles are more alike than the languages are on average are merged, most alike first. One
linear machine per family (against the rest) picks the family, and one for each pair of its languages votes within it.

The machines are fitted on a bounded sample: at most SAMPLE documents of each language, those with the smallest hashes
of their ids; prediction reads every whole text. Weights are linear in counts, so a text's decision is the mean
weight of its n-grams.

Cases: a null text, or one without any letter, is `und` with score 0; with no labelled text everything is `und`; null
ids and repeated rows are predicted like others; ties go to the language first in order; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, utf8_blocks

SAMPLE, BITS, FIT_STEPS, SOFT = 400, 15, 60, 1.0
WIDTH = 2 << BITS
#: Bytes of text whose n-grams are worked out at once; they take some 80 times as much.
GRAM_BYTES = 1 << 17


def _letters():
    """Byte -> itself in lower case, a space for what is no letter; bytes of wider characters stay."""
    to = np.full(256, 0x20, np.uint8)
    for c in range(0x41, 0x5B):
        to[c] = to[c + 32] = c + 32
    to[0x80:] = np.arange(0x80, 0x100)
    return to


LETTERS = _letters()


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers of the n-grams of a block, where each row's start, and which rows have an ASCII letter or wider bytes.

    Every row is padded with a space at both ends and runs of spaces count as one, so n-grams never cross rows."""
    n = len(offsets) - 1
    at = np.repeat(np.arange(n), np.diff(offsets)) * 2 + np.arange(len(data)) + 1
    b = np.full(len(data) + 2 * n, 0x20, np.uint8)
    b[at] = LETTERS[data]
    first = offsets[:-1] + 2 * np.arange(n)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    keep[first] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    b, starts = b[keep].astype(np.uint32), kept[np.append(first, len(keep))]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    three = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    h3 = (three * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    four = three[:-1] | b[3:] << np.uint32(24)
    h4 = ((four * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)
    out = np.zeros((len(b), 2), np.int64)
    out[: len(h3), 0] = h3
    out[: len(h4), 1] = h4
    # n-grams that would reach into the next row are left out: the last two positions of a row for 3, three for 4
    size = np.diff(starts)
    ok = np.zeros((len(b), 2), bool)
    left = np.repeat(starts[1:], size) - np.arange(len(b))
    ok[:, 0] = left >= 3
    ok[:, 1] = left >= 4
    ok = ok.reshape(-1)
    total = np.concatenate(([0], np.cumsum(ok)))
    return out.reshape(-1)[ok], total[2 * starts], size >= 3


def profiles(docs: DataFrame) -> DataFrame:
    """(lang, features as 16-bit numbers, counts as 32-bit numbers) of documents (lang, text); as long as the features at most."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, hi, data, offsets in utf8_blocks(batch.column(1), GRAM_BYTES):
                grams, at, _ = ngrams(data, offsets)
                own = [np.unique(grams[at[i] : at[i + 1]], return_counts=True) for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.astype("<u2").tobytes() for x, _ in own], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in own], pa.binary())], ["lang", "feature", "n"])

    return small_batches(docs).select("lang", "text").mapInArrow(run, "lang string, feature binary, n binary")


class Rows:
    """Sparse rows of unit length, worked on a few at a time."""

    def __init__(self, features: list[bytes], counts: list[bytes]):
        self.ends = np.cumsum([0, *(len(f) // 2 for f in features)])
        self.feature = np.frombuffer(b"".join(features), "<u2")
        self.value = np.frombuffer(b"".join(counts), "<u4").astype(np.float32)
        n = len(self.ends) - 1
        # runs of rows of about 200,000 features
        self.runs = [0]
        while self.runs[-1] < n:
            self.runs.append(max(self.runs[-1] + 1, int(np.searchsorted(self.ends, self.ends[self.runs[-1]] + 200_000, "right")) - 1))
        for lo, hi, at in self._parts():
            own = self.value[self.ends[lo] : self.ends[hi]]
            own /= np.repeat(np.sqrt(np.add.reduceat(own * own, at)), np.diff(self.ends[lo : hi + 1])).astype(np.float32)
        self.total = self._each(lambda own, _: own)

    def _parts(self):
        for lo, hi in zip(self.runs[:-1], self.runs[1:], strict=True):
            yield lo, hi, self.ends[lo:hi] - self.ends[lo]

    def _each(self, f):
        return np.concatenate([np.add.reduceat(f(self.value[self.ends[lo] : self.ends[hi]], self.feature[self.ends[lo] : self.ends[hi]]), at, dtype=float) for lo, hi, at in self._parts()])

    def dot(self, w):
        return self._each(lambda own, feature: own * w[feature])

    def back(self, r):
        out = np.zeros(WIDTH)
        for lo, hi, _ in self._parts():
            if r[lo:hi].any():
                a, z = self.ends[lo], self.ends[hi]
                out += np.bincount(self.feature[a:z], self.value[a:z] * np.repeat(r[lo:hi], np.diff(self.ends[lo : hi + 1])), WIDTH)
        return out


def machine(rows: Rows, sign: np.ndarray, use: np.ndarray) -> np.ndarray:
    """A linear support vector machine without offset: squared hinge loss, accelerated gradient; classes weigh alike."""
    weight = np.where(sign > 0, 1 / max(1, (use & (sign > 0)).sum()), 1 / max(1, (use & (sign < 0)).sum())) * use
    weight = weight / weight.sum() * use.sum()
    w = y = np.zeros(WIDTH)
    step, t = 1 / (1 + 2 * SOFT * weight.max() * use.sum()), 1.0
    step = max(step, 0.02)
    for _ in range(FIT_STEPS):
        slack = np.maximum(0, 1 - sign * rows.dot(y)) * weight
        new = y - step * (y - 2 * SOFT * rows.back(sign * slack))
        gain = (new - w) @ (y - new)
        t2 = 1.0 if gain > 0 else (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (0 if gain > 0 else (t - 1) / t2) * (new - w)
        w, t = new, t2
        if not np.isfinite(w).all():
            raise ArithmeticError("the machine did not settle")
    return w


class Model:
    def __init__(self, languages, families, weights, scales, plan):
        self.languages, self.families, self.weights, self.scales, self.plan = languages, families, weights, scales, plan


def families_of(means: np.ndarray) -> list[list[int]]:
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    like = unit @ unit.T
    n = len(like)
    groups = [[i] for i in range(n)]
    least = like[np.triu_indices(n, 1)].mean() if n > 1 else 1.0
    while len(groups) > 1:
        best = max(((like[np.ix_(a, b)].mean(), -i, -j) for (i, a), (j, b) in combinations(enumerate(groups), 2)))
        if best[0] <= least or len(groups) == 2:
            break
        i, j = -best[1], -best[2]
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def fit(lang: list[str], features: list[bytes], counts: list[bytes]) -> Model | None:
    """Fit families and machines on a bounded sample, as `profiles` writes it; every row has a feature."""
    if not lang:
        return None
    rows = Rows(features, counts)
    languages = sorted(set(lang))
    y = np.array([languages.index(name) for name in lang])
    means = np.stack([rows.back((y == k) / max(1, (y == k).sum())) for k in range(len(languages))])
    families = families_of(np.sqrt(means))
    family = np.array([next(i for i, f in enumerate(families) if k in f) for k in range(len(languages))])[y]
    weights, scales, plan = [], [], []
    everything = np.ones(len(y), bool)

    def add(sign, use, what):
        w = machine(rows, sign, use)
        # how many times the mean weight of a text's n-grams its margin is: a slope fitted to the sample, with which the logistic gives a score
        margin = sign * rows.dot(w) / np.maximum(rows.total, 1e-12)
        a = 1 / max(np.abs(margin[use]).mean(), 1e-9)
        weights.append(w)
        scales.append(3 * a)
        plan.append(what)

    if len(families) > 1:
        for i in range(len(families) if len(families) > 2 else 1):
            add(np.where(family == i, 1.0, -1.0), everything, ("family", i, -1))
    for f in families:
        for a, b in combinations(f, 2):
            add(np.where(y == a, 1.0, -1.0), (y == a) | (y == b), ("pair", a, b))
    w = np.array(weights, np.float32).reshape(-1, WIDTH)
    return Model(languages, families, w, np.array(scales), plan)


def decide(model: Model, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean weights (texts x machines) -> language numbers and scores."""
    n = len(means)
    p = 1 / (1 + np.exp(-np.clip(means * model.scales, -30, 30)))
    kin = np.ones((n, len(model.families)))
    for j, (what, i, _) in enumerate(model.plan):
        if what == "family":
            kin[:, i] = p[:, j]
            if len(model.families) == 2:
                kin[:, 1 - i] = 1 - p[:, j]
    family = np.argmax(kin, 1)
    sure = kin[np.arange(n), family]
    votes = np.zeros((n, len(model.languages)))
    support = np.zeros((n, len(model.languages)))
    rivals = np.zeros(len(model.languages))
    for j, (what, a, b) in enumerate(model.plan):
        if what == "pair":
            votes[:, a] += p[:, j] >= 0.5
            votes[:, b] += p[:, j] < 0.5
            support[:, a] += p[:, j]
            support[:, b] += 1 - p[:, j]
            rivals[[a, b]] += 1
    out = np.full((n, len(model.languages)), -1.0)
    for i, f in enumerate(model.families):
        out[np.ix_(family == i, f)] = (votes + support / (1 + rivals))[np.ix_(family == i, f)]
    best = np.argmax(out, 1)
    share = np.where(rivals[best] > 0, support[np.arange(n), best] / np.maximum(rivals[best], 1), 1.0)
    return best, np.clip(sure * share, 0, 1)


def predict(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """Add lang_pred and score to the given columns of documents, from text alone."""
    extra = [] if "text" in columns else [F.col("text").alias("_text")]
    skip, place = len(extra), 0 if extra else columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            text = batch.column(place)
            names, scores = np.full(len(text), "und", object), np.zeros(len(text))
            if model is not None:
                for lo, hi, data, offsets in utf8_blocks(text, GRAM_BYTES):
                    grams, at, some = ngrams(data, offsets)
                    sums, means = np.zeros(len(grams) + 1), np.zeros((hi - lo, len(model.plan)))
                    for j in range(len(model.plan)):
                        np.cumsum(model.weights[j][grams], out=sums[1:], dtype=float)
                        means[:, j] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
                    best, sure = decide(model, means)
                    ascii_letters = np.concatenate(([0], np.cumsum(LETTERS[data] - 0x61 < 26)))
                    some &= at[1:] > at[:-1]
                    for i in np.flatnonzero(some):
                        if ascii_letters[offsets[i + 1]] > ascii_letters[offsets[i]] or any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))):
                            names[lo + i], scores[lo + i] = model.languages[best[i]], sure[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], pa.array(names.tolist(), pa.string()), pa.array(scores)], [*batch.schema.names[skip:], "lang_pred", "score"])

    return small_batches(docs).select(*extra, *columns).mapInArrow(run, docs.select(*columns).schema.add("lang_pred", "string").add("score", "double"))


def sample(labelled: DataFrame) -> DataFrame:
    """At most SAMPLE rows (lang, text) of each language, those with the smallest hashes of their ids."""
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # as many rows as languages
    h = F.xxhash64("doc_id", F.lit(11))
    share = F.lit(1.0)
    for name, n in counts.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, 2.0 * SAMPLE / n + 20.0 / n))).otherwise(share)
    rows = labelled.withColumn("_h", h).where(F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30))
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(f"_r <= {SAMPLE}").select("lang", "text")


def train(labelled: DataFrame) -> Model | None:
    """Fit a model on documents (doc_id, text, lang) of which lang is known."""
    got = sorted(tuple(r) for r in profiles(sample(labelled)).where("length(feature) > 0").collect())  # at most SAMPLE rows a language
    return fit(*([r[i] for r in got] for i in range(3)))


def held_out():
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Train on the labelled documents that are not held out and predict all: columns, held_out, lang_pred, score."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    return predict(docs.withColumn("held_out", held_out()), train(labelled), [*(columns or ["doc_id"]), "held_out"])

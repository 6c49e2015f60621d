"""Personal data: exact base patterns, and a semi-Markov conditional random field that adds spans in other spellings.

The field scores whole candidate segments (their digit grouping, check digit, signs, neighbours), entities being at
most MAX_TOKENS tokens, and sums or maximises over all segmentations of a region, so boundaries and types are chosen
together. It is trained here: on a bounded sample of the corpus' own regions that hold base matches, rewritten into
other spellings (no plus sign, dots or brackets, "at" and "dot" written out) as positives, with numbers, dates and
versions among them as the rest. Only regions around digits or written-out signs can hold entities, so a text without
them is left alone. Base matches always stay, and added spans never overlap them.

Cases: a null text is empty: no spans, the hash of the empty string; null and repeated ids are rows like others; an
empty table gives no rows; whole texts of any length are read; columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A match can only begin where a run of its first class begins, or where the last match ended; so runs are tried once.
EMAIL_AT, EMAIL_IN = re.compile(EMAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + EMAIL.replace("]+@", "]++@", 1))
IP_AT, IP_IN = re.compile(IP), re.compile(r"(?<![0-9])" + IP.replace("[0-9]+", "[0-9]++", 1))
DIGIT = re.compile("[0-9]")

MAX_TOKENS, AROUND = 24, 48
SAMPLE, EPOCHS = 240, 14


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _runs(at, inside, text):
    pos = 0
    while True:
        m = (at.match(text, pos) if pos else None) or inside.search(text, pos)
        if m is None:
            return
        yield m
        pos = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, leftmost and non-overlapping per kind, sorted."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _runs(EMAIL_AT, EMAIL_IN, text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _runs(IP_AT, IP_IN, text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


# ---------------------------------------------------------------- regions, tokens, segments

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")
#: What an entity in another spelling needs: several digits close together, or a written-out "at" and "dot", or an "at"
#: in brackets before a host with a plain dot. Four short numbers are looked for apart, by their tokens (`_fours`).
_AT, _DOT, _LABEL = r"(?:\[at\]|\(at\)|\bat\b)", r"(?:\[dot\]|\(dot\)|\bdot\b)", "[A-Za-z0-9-]{1,63}"
TRIGGER = re.compile(rf"[0-9](?:[^A-Za-z0-9]{{0,3}}[0-9]){{5,}}|(?<=[A-Za-z0-9._-])\s?(?:{_AT}\s?{_LABEL}(?:\s?(?:{_DOT}|\.)\s?{_LABEL}){{0,10}}?\s?{_DOT}|[\[(]at[\])]\s?{_LABEL}\.[A-Za-z0-9])", re.I)
HOST = re.compile(rf"[\[(]at[\])]\s?(?:{_LABEL}\.)+[A-Za-z0-9]", re.I)
NUMBER = re.compile("[0-9]+")
WORD_AT, WORD_DOT = re.compile(r"[\[(]?at[\])]?$", re.I), re.compile(r"dot", re.I)
MAYBE = re.compile(r"dot|[0-9]|[\[(]at[\])]", re.I)


def _fours(text: str, lo: int, hi: int):
    """(start, end) of each four successive numbers of at most three digits that one segment can hold."""
    near: list[tuple[int, int, int]] = []  # start, end, tokens between it and the number before
    for m in NUMBER.finditer(text, lo, hi):
        if m.end() - m.start() > 3:
            near = []
            continue
        if near:
            between = sum(1 for _ in islice(TOKEN.finditer(text, near[-1][1], m.start()), MAX_TOKENS - 3))
            near = [*near[-3:], (m.start(), m.end(), between)] if between <= MAX_TOKENS - 4 else [(m.start(), m.end(), 0)]
        else:
            near = [(m.start(), m.end(), 0)]
        if len(near) == 4 and sum(n for _, _, n in near[1:]) <= MAX_TOKENS - 4:
            yield near[0][0], m.end()


def regions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Stretches between base matches that may hold further entities; clipped to bounded length around the triggers."""
    if not MAYBE.search(text):
        return []
    out: list[tuple[int, int]] = []
    lo = 0
    for s, e in [*((s, e) for s, _, e in base), (len(text), len(text))]:
        if lo < s:
            for x, y in sorted([*(m.span() for m in TRIGGER.finditer(text, lo, s)), *_fours(text, lo, s)]):
                a, z = max(lo, x - AROUND), min(s, y + AROUND)
                if out and a < out[-1][1]:
                    out[-1] = (out[-1][0], max(z, out[-1][1]))
                else:
                    out.append((a, z))
        lo = max(lo, e)
    return out


#: The last dot of a host may be plain only after an "at" in brackets.
SHAPE = re.compile(r"[A-Za-z0-9._-]+\s?(?:(?:\[at\]|\(at\)|at)\s?[A-Za-z0-9-]+(?:\s?(?:\[dot\]|\(dot\)|dot|\.)\s?[A-Za-z0-9-]+)*\s?(?:\[dot\]|\(dot\)|dot)\s?|(?:\[at\]|\(at\))\s?(?:[A-Za-z0-9-]+\.)+)[A-Za-z]{2,6}", re.I)
GROUPS = ("3-3-4", "3-4", "4-4-4-4", "4-6-5", "1-3-3-4", "2-3-3-4", "1-3-4")
NAMES = ("one", "tokens", "digits<7", "digits7", "digits8-9", "digits10", "digits11", "digits12", "digits13-15", "digits16", "digits17-19", "digits>19", "luhn", "ip4", "dots", "dashes", "spaces", "slashes", "colons", "brackets", "open", "plus", "at", "dot", "at and dot", "tld", "letters", "joined before", "joined after", "edge", "email shape", *GROUPS)


def features(tokens: list[str], i: int, j: int) -> np.ndarray | None:
    """Features of the segment tokens[i:j], or None if no entity could look so."""
    first, last = tokens[i], tokens[j - 1]
    if not (first.isalnum() or first in "(+") or not last.isalnum():
        return None
    part = tokens[i:j]
    text = "".join(part)
    groups = [t for t in part if t.isdigit()]
    digits = "".join(groups)
    n = len(digits)
    words = [t for t in part if t.isalpha()]
    at, dot = any(w.lower() == "at" for w in words) or "@" in part, any(w.lower() == "dot" for w in words)
    dot = dot or at and "." in part and HOST.search(text) is not None
    if n < 7 and not (at and dot) and not (len(groups) == 4 and max(map(len, groups)) <= 3):
        return None
    f = np.zeros(len(NAMES))
    put = lambda name, value=1.0: f.__setitem__(NAMES.index(name), value)
    put("one")
    put("tokens", (j - i) / MAX_TOKENS)
    put("digits<7" if n < 7 else "digits7" if n == 7 else "digits8-9" if n < 10 else "digits10" if n == 10 else "digits11" if n == 11 else "digits12" if n == 12 else "digits13-15" if n < 16 else "digits16" if n == 16 else "digits17-19" if n < 20 else "digits>19")
    put("luhn", float(12 <= n <= 19 and luhn(digits)))
    put("ip4", float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and not words))
    for name, c in (("dots", "."), ("dashes", "-"), ("spaces", " "), ("slashes", "/"), ("colons", ":")):
        put(name, min(3, text.count(c)) / 3)
    put("brackets", float("(" in text and ")" in text))
    put("open", float(text.count("(") != text.count(")") or text.count("[") != text.count("]")))
    put("plus", float(first == "+"))
    put("at", float(at))
    put("dot", float(dot))
    put("at and dot", float(at and dot))
    put("tld", float(last.isalpha() and 2 <= len(last) <= 6 and last.lower() not in ("dot", "at")))
    put("letters", min(6, len(words)) / 6)
    put("joined before", float(i > 0 and (tokens[i - 1].isalnum() or tokens[i - 1] in "-./+@_")))
    put("joined after", float(j < len(tokens) and (tokens[j].isalnum() or tokens[j] in "-/@_")))
    put("edge", float(i == 0 or j == len(tokens)))
    put("email shape", float(SHAPE.fullmatch(text) is not None))
    shape = "-".join(str(len(g)) for g in groups)
    if shape in GROUPS and not words:
        put(shape)
    return f


class Lattice:
    """All candidate segments of a region."""

    def __init__(self, text: str):
        found = list(TOKEN.finditer(text))
        self.tokens = [m.group() for m in found]
        self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]
        own = []
        self.at = []
        for i in range(len(self.tokens)):
            for j in range(i + 1, min(len(self.tokens), i + MAX_TOKENS) + 1):
                f = features(self.tokens, i, j)
                if f is not None:
                    own.append(f)
                    self.at.append((i, j))
        self.f = np.array(own).reshape(-1, len(NAMES))

    def by_end(self):
        out = [[] for _ in range(len(self.tokens) + 1)]
        for k, (i, j) in enumerate(self.at):
            out[j].append((i, k))
        return out

    def best(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (start, kind, end) in characters."""
        score = self.f @ w
        n = len(self.tokens)
        value, back = np.zeros(n + 1), [None] * (n + 1)
        ends = self.by_end()
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, k in ends[j]:
                y = int(np.argmax(score[k]))
                if value[i] + score[k, y] > value[j]:
                    value[j], back[j] = value[i] + score[k, y], (i, y)
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, y = back[j]
                out.append((self.starts[i], y, self.ends[j - 1]))
                j = i
        return out[::-1]

    def gradient(self, w: np.ndarray, truth: dict[tuple[int, int], int]) -> np.ndarray:
        """Of the log-likelihood of the true segmentation: features seen less those expected."""
        score = self.f @ w
        n = len(self.tokens)
        ends = self.by_end()
        starts = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(self.at):
            starts[i].append((j, k))
        total = np.logaddexp.reduce(score, 1) if len(score) else np.zeros(0)
        a, b = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            a[j] = np.logaddexp.reduce([a[j - 1], *(a[i] + total[k] for i, k in ends[j])])
        for i in range(n - 1, -1, -1):
            b[i] = np.logaddexp.reduce([b[i + 1], *(b[j] + total[k] for j, k in starts[i])])
        out = np.zeros_like(w)
        for k, (i, j) in enumerate(self.at):
            p = np.exp(np.minimum(0, a[i] + b[j] - a[n] + score[k]))
            out -= np.outer(self.f[k], p)
            if (i, j) in truth:
                out[:, truth[i, j]] += self.f[k]
        return out


# ---------------------------------------------------------------- training

def respelled(kind: int, text: str, rng: random.Random) -> str:
    """A base match of a kind in a spelling that the base patterns do not take."""
    digits = re.sub(r"\D", "", text)
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) ")])
        user, _, host = text.partition("@")
        return user + at + host.replace(".", dot)
    if kind == 1:
        sign, parts = rng.choice(["[.]", "(.)", " . "]), text.split(".")
        if rng.random() < 0.5:  # short addresses, which are rare in a corpus, are learned from long ones
            parts = [p[: rng.randint(1, 2)] for p in parts]
        return sign.join(parts)
    if kind == 2:
        return rng.choice([".", "/", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:].rjust(10, "2")
    return rng.choice(["({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0} {1} {2}", "1-{0}-{1}-{2}", "({0}){1}-{2}"]).format(local[:3], local[3:6], local[6:])


def distractor(rng: random.Random) -> str:
    """A number that is no personal data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    made = rng.choice(["{0}-{1:02d}-{2:02d}", "{1:02d}/{2:02d}/{0}", "{0}-{1:02d}-{2:02d} {1:02d}:{2:02d}:{2:02d}", "{3}", "{4}", "{5},{6}.{7}", "{1}.{2}.{3}", "{0} {0} {0}", "{8}", "1. 2. 3. {1}. {2}.", "{0}, {0}, {0}", "{5},{6},{6}", "{1}, {2}, {1}, {2}", "{1} {2} {1} {2} {1}", "{1}-{2} {1}-{2}", "{1}. {2}. {1}. {2}."])
    long = n(rng.choice([7, 8, 9, 10, 11, 12, 13, 16, 18, 22]))
    while len(long) >= 12 and luhn(long):
        long = n(len(long))
    return made.format(rng.randint(1900, 2090), rng.randint(1, 12), rng.randint(1, 28), n(3), long, rng.randint(1, 999), n(3), n(2), "0x" + n(8))


def fit(contexts: list[tuple[str, int, str, str]], seed: int = 1) -> np.ndarray:
    """Weights from (text before, kind, match, text after) of a bounded sample."""
    rng = random.Random(seed)
    lattices = []
    for before, kind, match, after in contexts:
        spelled = respelled(kind, match, rng)
        for text, truth in ((spelled, (0, len(spelled))), (distractor(rng), None)):
            own = Lattice(before + text + after)
            want = {}
            if truth:
                try:
                    want[own.starts.index(len(before)), own.ends.index(len(before) + len(text)) + 1] = kind
                except ValueError:
                    continue
                if not set(want) <= set(own.at):
                    continue
            if own.at:
                lattices.append((own, want))
    w = np.zeros((len(NAMES), len(KINDS)))
    w[0] = -2
    square = np.ones_like(w)
    for epoch in range(EPOCHS):
        rng.shuffle(lattices)
        for own, want in lattices:
            g = own.gradient(w, want) - 0.002 * w
            square += g * g
            w += 0.5 * g / np.sqrt(square)
    return w


def sample(docs: DataFrame) -> list[tuple[str, int, str, str]]:
    """Contexts of base matches, at most SAMPLE of each kind: those with the smallest hashes over the corpus."""

    def run(batches):
        import heapq

        import pyarrow as pa

        best: dict[int, list] = {k: [] for k in range(len(KINDS))}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for s, kind, e in base_spans(text or ""):
                    before, match, after = text[max(0, s - 30) : s], text[s:e], text[e : e + 30]
                    if MAYBE.search(before) or MAYBE.search(after) or len(match) > 60:
                        continue
                    key = hashlib.blake2b(f"{before}|{match}|{after}".encode(), digest_size=7).digest()
                    own = best[kind]
                    item = (-int.from_bytes(key, "big"), before, match, after)
                    if len(own) < SAMPLE:
                        heapq.heappush(own, item)
                    elif item > own[0]:
                        heapq.heapreplace(own, item)
        rows = [(kind, -x[0], *x[1:]) for kind, own in best.items() for x in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["kind", "key", "before", "match", "after"])

    from pyspark.sql import Window

    found = small_batches(docs).select("text").mapInArrow(run, "kind int, key long, before string, match string, after string").distinct()
    # first within parts of a kind, then among what they leave
    rank = lambda *by: F.row_number().over(Window.partitionBy("kind", *by).orderBy("key"))
    few = found.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(64))).withColumn("r", rank("part")).where(f"r <= {SAMPLE}")
    rows = few.withColumn("r", rank()).where(f"r <= {SAMPLE}").orderBy("kind", "key").collect()  # at most 4 SAMPLE rows
    return [(r["before"], r["kind"], r["match"], r["after"]) for r in rows]


# ---------------------------------------------------------------- the operator

def spans(text: str, w: np.ndarray | None) -> tuple[list, list]:
    """(base spans, all spans), both sorted."""
    base = base_spans(text)
    more = []
    if w is not None:
        for a, z in regions(text, base):
            more += [(a + s, kind, a + e) for s, kind, e in Lattice(text[a:z]).best(w)]
    starts, ends, furthest = [s for s, _, _ in base], [], 0
    for _, _, e in base:
        furthest = max(furthest, e)
        ends.append(furthest)

    def free(x):
        at = bisect_left(starts, x[2])  # those before begin before x ends
        return not at or ends[at - 1] <= x[0]

    return base, sorted(base + [x for x in more if free(x)])


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in found)


def train(docs: DataFrame) -> np.ndarray | None:
    contexts = sample(docs)
    return fit(contexts) if contexts else None


def find(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Columns of documents (text), n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    w = train(docs)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts, hashes, lists = [], [], []
            for text in batch.column(0):
                base, every = spans(text.as_py() or "", w)
                counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
                hashes.append(hashlib.sha256(written(base).encode()).hexdigest())
                lists.append(written(every))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(n[:, i]) for i in range(len(KINDS))), pa.array(hashes, pa.string()), pa.array(lists, pa.string())], [*batch.schema.names[1:], *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = small_batches(docs).select(F.col("text").alias("_text"), *(columns or ["doc_id"]))
    schema = rows.drop("_text").schema
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return rows.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def redact(docs: DataFrame) -> DataFrame:
    """The same documents with every span in `text` replaced by its kind in brackets; null texts stay null."""
    w = train(docs)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for value in batch.column(at):
                text = value.as_py()
                if text is not None:
                    parts, pos = [], 0
                    for s, kind, e in spans(text, w)[1]:
                        if s >= pos:
                            parts += [text[pos:s], f"[{KINDS[kind].upper()}]"]
                        elif e <= pos:
                            continue
                        pos = max(pos, e)
                    text = "".join(parts) + text[pos:] if parts else text
                texts.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return small_batches(docs).mapInArrow(run, docs.schema)

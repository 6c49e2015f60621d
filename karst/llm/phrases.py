"""Phrase collocations by best-first growth of a prefix tree under admissible score bounds.

A phrase's score is its lowest over all cuts, 1000 a n / (l r), where a is its own count, l and r those of the parts
and n the words of its language. As r is at least a, no phrase that begins with the word w scores above 1000 n / f(w):
the count of the first word bounds all that can grow from it. So the rarest words with at least LEAST occurrences are the best
roots. A round opens the best unopened roots of each language and counts all phrases that grow from them; the lowest of
the best TOP surviving scores so far then tells which other roots may still reach it (ties included), and the next
round opens those, and no others. A language is settled when none is left; with fewer than TOP survivors all its roots are opened.

Counting reads the texts once a round, in vectorised blocks, and passes on (language, phrase, count) once a block. Only
phrases that can reach LEAST are counted, and only parts that a contending cut asks for: sketches of fixed size, in which different
phrases share slots, rule out the others, which affects time and not results. Counts are exact: Spark groups by the text
of a phrase. A phrase lies inside a longer one as often as itself if, and only if, one word stands before all its
occurrences or after all of them, so the words on both sides are kept as their extremes, a hash each.

Within a block of at most a million bytes (or one longer text) phrases are told apart by 64-bit hashes, whose bytes are
not compared.

Cases: a null text is an empty one; a null language is `und`; repeated rows, rows of a null id, and ids at all, count like any
rows; phrases of the same score are ordered by count and then by bytes; an empty table, or one without candidates, gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, SpanHash, mix, small_batches, utf8_blocks

LONGEST, LEAST, TOP = 5, 100, 2000
BLOCK, FULL, CHUNK = 1 << 20, 200, 1 << 16
#: Share of a language's words at which the first round's roots stop; each later round without a settled bound takes eight times more.
FIRST_SHARE = 1 / 16
#: Bounds of a sketch's slots, as powers of two: from the smallest corpus to the largest.
LEAST_BITS, MOST_BITS = 16, 26
HASH, STEP = SpanHash(29), np.uint64(0x9E3779B97F4A7C15)
BREAKS = b".,;:!?\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
IS_BREAK = np.isin(np.arange(256), list(BREAKS))
IS_WORD = ~IS_BREAK & ~np.isin(np.arange(256), [0x20, 0x09])
COUNT = "lang string, phrase string, words int, a long, before_min long, before_max long, after_min long, after_max long"


# ---------------------------------------------------------------- words and phrases of a block of texts


class Words:
    """The words of some texts: each one's hash (with its text's language), piece and text number, and all joined by spaces."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        n = len(offsets) - 1
        b = np.full(len(data) + n, 0x0A, np.uint8)
        b[np.repeat(np.arange(n), np.diff(offsets)) + np.arange(len(data))] = LOWER[data]
        inside = IS_WORD[b]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        self.piece = np.cumsum(IS_BREAK[b], dtype=np.int32)[starts]
        self.text = np.searchsorted(offsets + np.arange(n + 1), starts, "right") - 1
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.joined = np.full(int((size + 1).sum()), 0x20, np.uint8)
        letters = b[inside]
        self.joined[np.repeat(np.arange(len(size)), size) + np.arange(len(letters))] = letters
        h = mix(HASH(self.joined, self.start, self.end) + langs[self.text] * STEP) if len(size) else np.zeros(0, np.uint64)
        h[h == 0] = 1
        self.hashes = {1: h}

    def __len__(self):
        return len(self.piece)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the phrases of k words that begin at each word (all but the last k - 1)."""
        if k not in self.hashes:
            before = self.grams(k - 1)
            self.hashes[k] = mix(before[:-1] * STEP + self.hashes[1][k - 1 :]) if len(before) else before
        return self.hashes[k]

    def within(self, k: int) -> np.ndarray:
        """Whether the k words from each word on lie in one piece."""
        return self.piece[: len(self) - k + 1] == self.piece[k - 1 :] if len(self) >= k else np.zeros(0, bool)

    def strings(self, at: np.ndarray, k: int):
        """The phrases of k words that begin at the given words, as an Arrow array."""
        import pyarrow as pa

        lo, size = self.start[at], self.end[at + k - 1] - self.start[at]
        ends = np.cumsum(size)
        data = self.joined[np.repeat(lo - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = np.concatenate(([0], ends)).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.string())


def language_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def blocks(batch):
    """Yield (first text, Words) of an Arrow batch of (language, text)."""
    names = batch.column(0).to_pylist()
    known = {name: language_hash(name) for name in set(names)}
    langs = np.array([known[name] for name in names], np.uint64)
    for lo, hi, data, offsets in utf8_blocks(batch.column(1), BLOCK):
        yield lo, Words(data, offsets, langs[lo:hi])


def counted(batch, lo: int, words: Words, at: np.ndarray, k: int):
    """One record a distinct phrase: language, phrase, k, count, and extremes of the words before and after (0: none)."""
    import pyarrow as pa

    h = words.hashes[1].view(np.int64)
    piece, n = words.piece, len(words)
    before = np.where((at > 0) & (piece[at - 1] == piece[at]), h[at - 1], 0)
    last = at + k - 1
    follow = np.minimum(last + 1, n - 1)
    after = np.where((last + 1 < n) & (piece[follow] == piece[last]), h[follow], 0)
    key = words.grams(k)[at]
    order = np.argsort(key, kind="stable")
    key, before, after = key[order], before[order], after[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    chosen = at[order[first]]
    columns = [batch.column(0).take(pa.array(words.text[chosen] + lo)), words.strings(chosen, k), pa.array(np.full(len(first), k, np.int32)), pa.array(np.diff(np.append(first, len(key))))]
    columns += [pa.array(f.reduceat(c, first)) for c in (before, after) for f in (np.minimum, np.maximum)]
    return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "words", "a", "before_min", "before_max", "after_min", "after_max"])


def texts(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def totals(counts: DataFrame) -> DataFrame:
    extremes = [f(c).alias(c) for c, f in (("before_min", F.min), ("before_max", F.max), ("after_min", F.min), ("after_max", F.max))]
    return counts.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("a").alias("a"), *extremes)


# ---------------------------------------------------------------- sketches


class Sketch:
    """Counts up to FULL in 2**bits slots a level; written as blocks of CHUNK slots, sparse where that is shorter."""

    def __init__(self, levels, bits: int):
        self.bits, self.cells = bits, {k: np.zeros(1 << bits, np.uint8) for k in levels}

    def add(self, level: int, hashes: np.ndarray) -> None:
        slots, n = np.unique(hashes >> np.uint64(64 - self.bits), return_counts=True)
        cells = self.cells[level]
        cells[slots] = np.minimum(cells[slots] + n, FULL)

    def records(self):
        import pyarrow as pa

        for level, cells in self.cells.items():
            for block, lo in enumerate(range(0, len(cells), CHUNK)):
                own = cells[lo : lo + CHUNK]
                at = np.flatnonzero(own)
                if len(at):
                    sparse = len(at) * 3 < len(own)
                    data = at.astype("<u2").tobytes() + own[at].tobytes() if sparse else own.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([level], pa.int32()), pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["level", "block", "data"])


def bitmaps(parts: DataFrame, bits: int, least: int) -> dict[int, np.ndarray]:
    """{level: which slots reach `least`} of sketches that tasks wrote; blocks are added up one at a time, in the order of a sort."""
    size, least = min(CHUNK, 1 << bits), min(least, FULL)

    def run(batches):
        import pyarrow as pa

        key, total = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["level", "block", "data"])

        for batch in batches:
            for level, block, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                now = (level.as_py(), block.as_py())
                if now != key:
                    if key is not None:
                        yield out()
                    key, total = now, np.zeros(size, np.uint16)
                data = data.as_py()
                if len(data) == size:
                    total += np.frombuffer(data, np.uint8)
                else:
                    n = len(data) // 3
                    total[np.frombuffer(data[: 2 * n], "<u2")] += np.frombuffer(data[2 * n :], np.uint8)
                np.minimum(total, FULL, out=total)
        if key is not None:
            yield out()

    schema = "level int, block int, data binary"
    got = parts.repartition("level", "block").sortWithinPartitions("level", "block").mapInArrow(run, schema).collect()  # a bit a slot
    marks: dict = {}
    for level, block, data in got:
        own = marks.setdefault(level, np.zeros(1 << bits, bool))
        own[block * size : (block + 1) * size] = np.unpackbits(np.frombuffer(data, np.uint8))[:size].view(bool)
    return {level: np.packbits(own) for level, own in marks.items()}


class Marks:
    """Sets of hashes as bits; a hash may be marked by another's account, never missing."""

    def __init__(self, levels: dict[int, np.ndarray], bits: int):
        self.levels, self.shift = levels, np.uint64(64 - bits)

    def __call__(self, level: int, hashes: np.ndarray) -> np.ndarray:
        own = self.levels.get(level)
        if own is None:
            return np.zeros(len(hashes), bool)
        slot = hashes >> self.shift
        return (own[slot >> np.uint64(3)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8)) & 1).view(bool)


def slots_for(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, int(n).bit_length()))


def marks_of(phrases: DataFrame, n: int) -> Marks:
    """The set of the (lang, phrase) rows, as bits by the number of words; n rows at most."""
    bits = slots_for(16 * n)

    def run(batches):
        sketch = Sketch(range(1, LONGEST + 1), bits)
        for batch in batches:
            for _, words in blocks(batch):
                first = np.flatnonzero(np.append(True, words.text[1:] != words.text[:-1])) if len(words) else np.zeros(0, int)
                size = np.diff(np.append(first, len(words)))
                for k in range(1, LONGEST + 1):
                    sketch.add(k, words.grams(k)[first[size == k]])
        yield from sketch.records()

    return Marks(bitmaps(small_batches(phrases).select("lang", "phrase").mapInArrow(run, "level int, block int, data binary"), bits, 1), bits)


# ---------------------------------------------------------------- scans of the texts


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, phrase, a) of all words; the empty phrase counts a language's words."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo, words in blocks(batch):
                if len(words):
                    own = counted(batch, lo, words, np.arange(len(words)), 1)
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(3)], ["lang", "phrase", "a"])
                    per = np.bincount(words.text)
                    at = np.flatnonzero(per)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + lo)), pa.array([""] * len(at)), pa.array(per[at])], ["lang", "phrase", "a"])

    return texts(docs).mapInArrow(run, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def often(docs: DataFrame, common: Marks, n: int, least: int) -> Marks:
    """Which phrases of 2 to LONGEST words, all common, may occur `least` times."""
    bits = slots_for(n // 8)

    def run(batches):
        sketch = Sketch(range(2, LONGEST + 1), bits)
        for batch in batches:
            for _, words in blocks(batch):
                known = common(1, words.hashes[1])
                use = known
                for k in range(2, min(LONGEST, len(words)) + 1):
                    use = use[:-1] & known[k - 1 :]
                    sketch.add(k, words.grams(k)[use & words.within(k)])
        yield from sketch.records()

    return Marks(bitmaps(texts(docs).mapInArrow(run, "level int, block int, data binary"), bits, least), bits)


def grown(docs: DataFrame, roots: Marks, common: Marks, may: Marks) -> DataFrame:
    """Counts of all phrases of 2 to LONGEST words that begin with a root and may be frequent enough."""

    def run(batches):
        for batch in batches:
            for lo, words in blocks(batch):
                known = common(1, words.hashes[1])
                root, use = roots(1, words.hashes[1]), known
                for k in range(2, min(LONGEST, len(words)) + 1):
                    use = use[:-1] & (known[k - 1 :] if k == 2 else use[1:]) & words.within(k)
                    use[use] = may(k, words.grams(k)[use])
                    at = np.flatnonzero(use & root[: len(use)])
                    if len(at):
                        yield counted(batch, lo, words, at, k)

    return totals(texts(docs).mapInArrow(run, COUNT))


def asked(docs: DataFrame, wanted: Marks) -> DataFrame:
    """Counts of the phrases of 2 to LONGEST - 1 words in a set (and of a few others)."""

    def run(batches):
        for batch in batches:
            for lo, words in blocks(batch):
                for k in range(2, min(LONGEST - 1, len(words)) + 1):
                    at = np.flatnonzero(wanted(k, words.grams(k)) & words.within(k))
                    if len(at):
                        yield counted(batch, lo, words, at, k)

    return totals(texts(docs).mapInArrow(run, COUNT)).select("lang", "phrase", "a")


# ---------------------------------------------------------------- scores


def score(a, n, part1, part2):
    """floor(1000 a n / (l r)), exactly, for counts below 10**14."""
    wide = [f"cast({c} AS decimal(14,0))" for c in (a, n, part1, part2)]
    return F.expr(f"cast(1000 AS decimal(4,0)) * ({wide[0]} * {wide[1]}) div ({wide[2]} * {wide[3]})")


def best(rows: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language, with rank; a language is ranked in 32 parts before it is ranked as a whole."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(32))
    few = rows.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` collocations."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    every = scratch.save(word_counts(docs).where((F.col("a") >= least) | (F.col("phrase") == "")), "words")
    sizes = {r[0]: r[1] for r in every.where("phrase = ''").select("lang", "a").collect()}  # as many rows as languages
    schema = "lang string, rank int, phrase string, a long, l long, r long, n long, score long"
    words = every.where("phrase <> ''")
    # how many words of a language each power of 2**(1/4) of a count holds: a bounded number of rows a language
    power = F.floor(F.log2("a") * 4).cast("int")
    steps: dict = {}
    for lang, step, occurrences, least_a, most_a, distinct in words.groupBy("lang", power.alias("step")).agg(F.sum("a"), F.min("a"), F.max("a"), F.count("*")).collect():
        steps.setdefault(lang, []).append((step, occurrences, least_a, most_a, distinct))
    if not steps:
        return spark.createDataFrame([], schema)
    total = sum(sizes.values())
    common = marks_of(words, sum(s[4] for own in steps.values() for s in own))
    may = often(docs, common, total, least)

    opened, settled, share = dict.fromkeys(steps, 0), set(), FIRST_SHARE
    bound: dict = {}  # the lowest of the best `top` surviving scores so far
    grams = parts = scored = None
    turn = 0
    while len(settled) < len(steps):
        turn += 1
        limits, roots_n = {}, 0
        for lang, own in steps.items():
            if lang in settled:
                continue
            if lang in bound:
                limit = 1000 * sizes[lang] // max(1, bound[lang])
            else:
                limit, taken = 0, 0
                for _, occurrences, _, most_a, _ in sorted(own):
                    if limit > opened[lang] and taken + occurrences > share * sizes[lang]:
                        break
                    limit, taken = most_a, taken + occurrences
            limit = min(limit, max(s[3] for s in own))
            if limit > opened[lang] and any(s[3] > opened[lang] and s[2] <= limit for s in own):
                limits[lang] = (opened[lang], limit)
                roots_n += sum(s[4] for s in own if s[3] > opened[lang] and s[2] <= limit)
            else:
                settled.add(lang)
        share *= 8
        if not limits:
            break
        frontier = spark.createDataFrame([(lang, lo, hi, sizes[lang], bound.get(lang)) for lang, (lo, hi) in limits.items()], "lang string, lo long, hi long, n long, bound long")
        roots = words.join(frontier, "lang").where("a > lo and a <= hi").select("lang", F.col("phrase").alias("first"), F.col("a").alias("first_n"), "n", "bound")
        new = grown(docs, marks_of(roots.withColumnRenamed("first", "phrase"), roots_n), common, may).where(F.col("a") >= least)
        new = scratch.save(new.withColumn("first", F.substring_index("phrase", " ", 1)).join(roots, ["lang", "first"]), f"grown{turn}")
        grams = new.select("lang", "phrase", "a")
        covered = ((F.col("before_min") == F.col("before_max")) & (F.col("before_min") != 0)) | ((F.col("after_min") == F.col("after_max")) & (F.col("after_min") != 0))
        alive = new.where(~covered | (F.col("words") == LONGEST)).select("lang", "phrase", "words", "a", "n", "bound")
        # every cut of a candidate, with the count of its first part; a first part grows from the same root
        cut = alive.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        cut = cut.select("lang", "phrase", "words", "a", "n", "bound", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.expr("array_join(slice(w, k + 1, words - k), ' ')").alias("right"))
        firsts = words.select("lang", "phrase", "a").union(grams).select("lang", F.col("phrase").alias("left"), F.col("a").alias("l"))
        singles = words.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r"))
        cut = cut.join(firsts, ["lang", "left"]).join(singles, ["lang", "right"], "left")
        cut = scratch.save(cut.withColumn("score", F.when(F.col("r").isNotNull(), score("a", "n", "l", "r"))), f"cut{turn}")
        # pairs have but one cut; their scores, with earlier rounds', are a first bound for the longer ones
        pairs = cut.where("words = 2").select("lang", "phrase", "a", "l", "r", "n", "score")
        before = pairs if scored is None else pairs.union(scored)
        line = best(before.select("lang", "phrase", "a", "score"), top).where(F.col("rank") == top).select("lang", F.col("score").alias("line"))
        longer = cut.where("words > 2").join(F.broadcast(line), "lang", "left")
        # 1000 n / l bounds a cut whose second part is not counted yet
        longer = longer.withColumn("one", F.lit(1)).withColumn("ceiling", F.coalesce("score", score("n", "one", "l", "one")))
        hopeful = longer.groupBy("lang", "phrase").agg(F.min("ceiling").alias("ceiling"), F.max("line").alias("line")).where("line is null or ceiling >= line").select("lang", "phrase")
        longer = scratch.save(longer.join(hopeful, ["lang", "phrase"], "left_semi").select("lang", "phrase", "a", "n", "k", "l", "r", "right", "score"), f"longer{turn}")
        wanted = scratch.save(longer.where("r is null").select("lang", F.col("right").alias("phrase")).distinct(), f"wanted{turn}")
        wanted_n = wanted.count()
        if wanted_n:
            parts = scratch.save(asked(docs, marks_of(wanted, wanted_n)).join(wanted, ["lang", "phrase"], "left_semi"), f"parts{turn}")
            rest = parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("rest"))
            longer = longer.join(rest, ["lang", "right"], "left").withColumn("r", F.coalesce("r", "rest"))
            longer = longer.withColumn("score", F.coalesce("score", score("a", "n", "l", "r")))
        lowest = F.min(F.struct("score", "k", "l", "r")).alias("s")
        whole = longer.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")
        scored = scratch.save(best(before.unionByName(whole), top).drop("rank").select("lang", "phrase", "a", "l", "r", "n", "score"), f"scored{turn}")
        reached = scored.groupBy("lang").agg(F.count("*").alias("m"), F.min("score").alias("s")).where(F.col("m") >= top)
        bound |= {r[0]: r[2] for r in reached.collect()}  # as many rows as languages
        opened |= {lang: hi for lang, (_, hi) in limits.items()}
        scratch.drop(*(f"{name}{turn}" for name in ("grown", "cut", "longer", "wanted", "parts")), f"scored{turn - 1}")
    return best(scored, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows from all phrases of all texts.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[ \\t]+') IF x <> ''] AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS r(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, array_to_string(w[2:], ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(w[:k - 1], ' '), a FROM c),
held AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
alive AS (SELECT c.* FROM c LEFT JOIN held USING (lang, phrase) WHERE held.most IS NULL OR held.most < c.a),
cuts AS (SELECT lang, k, phrase, a, j, array_to_string(w[:j], ' ') AS first, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM alive)),
scores AS (SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, n.n, x.j, 1000 * x.a * n.n // (l.a * r.a) AS score
    FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest JOIN n ON n.lang = x.lang),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scores),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE o = 1)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= 2000
"""

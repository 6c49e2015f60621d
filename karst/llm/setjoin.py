"""Set-similarity join of documents on word shingles, with a token-group matrix.

Every link of Jaccard similarity at or above the threshold counts; none is estimated.

1. Of two documents at or above the threshold, the first n - ceil(t n) + l tokens of each, in any one order of all
   tokens, have l in common. The order here: tokens that few documents have come first. How many have a token is counted
   over all documents in a sketch of fixed size; an error there costs time, never a link. l is LEAD, or less for a set
   so small that it must match in fewer.
2. Documents with equal sets are one class. Only classes that share l leading tokens with others go on.
3. Similar documents form groups (equal min-hash, at most about GROUP documents): within a group all pairs are compared
   with numpy, and so most of a large cluster falls into one component without listing its pairs.
4. The token-group matrix: leading tokens -> components and their groups. Two components that share leading tokens
   are compared, the smaller one's classes being queries to the larger one's groups, unless the number of tokens they
   share, or the place of the first, shows that no two of their classes can link. A query's overlap with the union of a
   group's tokens bounds that with every member, and only groups whose bound reaches ceil(t n) are opened. Each
   token's major component is asked first; what it does not take in then meets everyone, so no token's classes are
   paired off. Links inside a component need no comparison, for they cannot change the answer.

Cases: null or word-less texts have an empty set and link with nothing; fewer than k words are one shingle; rows
with a null doc_id take no part (their component is null); repeated doc_ids are one document that links if either
text does; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, Scratch, SpanHash, components, mix, utf8_blocks

#: Documents of one group, about; and tokens of one group, about.
GROUP, GROUP_TOKENS = 48, 2_000_000
#: Slots of the sketch, as a power of two, and the ranges in which they travel; bits of a bitmap of ids.
SLOT_BITS, RANGES, MAP_BITS = 24, 1024, 25
#: Leading tokens that two sets must share.
LEAD = 4
#: Queries that meet a group in one task.
QUERIES = 256
#: Components of a token beyond which they meet by classes of length, each STEP-th of a power of e.
MANY, STEP = 256, 16

_words = SpanHash(4_049)
_weights = np.random.default_rng(7_907).integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def lower(b: np.ndarray) -> np.ndarray:
    return b + (((b >= 65) & (b <= 90)).astype(np.uint8) << 5)


def word_bounds(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of the rows of a block, and the rows' first words."""
    word = ~((b == 0x20) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def shingle_sets(column, k: int):
    """Yield (row, sorted distinct 64-bit shingle hashes) for an Arrow string column."""
    for lo, hi, data, offsets in utf8_blocks(column, BLOCK_BYTES):
        data = lower(data)
        starts, ends, at = word_bounds(data, offsets)
        words = _words(data, starts, ends)
        sums = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            sums += words[j : len(words) - k + 1 + j] * _weights[j]
        for i in range(hi - lo):
            a, z = at[i], at[i + 1]
            if z - a >= k:
                yield lo + i, np.unique(mix(sums[a : z - k + 1]))
            elif z > a:
                yield lo + i, mix(np.array([(words[a:z] * _weights[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)]))
            else:
                yield lo + i, np.zeros(0, np.uint64)


def must(n: int, percent: int) -> int:
    """The least overlap of a set of n with any that it links with."""
    return -(-percent * n // 100)


def lead(n: int, percent: int) -> int:
    """How many leading tokens of a set of n must hold min(LEAD, must(n)) common ones."""
    least = must(n, percent)
    return n - least + min(LEAD, least)


def sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Of each slot of the top bits of a token, the level of how many tokens of documents fall in it (15: 15; above: by doublings).

    Each task counts in an array of its own (up to 255), sent compressed by ranges; ranges are summed as they stream in."""

    def count(batches):
        import pyarrow as pa

        own = np.zeros(1 << SLOT_BITS, np.uint8)
        shift = np.uint64(64 - SLOT_BITS)

        def put(parts):
            slot, n = np.unique(np.concatenate(parts) >> shift, return_counts=True)
            own[slot] = np.minimum(own[slot].astype(np.int64) + n, 255)

        for batch in batches:
            parts, size = [], 0
            for _, tokens in shingle_sets(batch.column(0), k):
                parts.append(tokens)
                size += len(tokens)
                if size > 250_000:
                    put(parts)
                    parts, size = [], 0
            if parts:
                put(parts)
        if own.any():
            rows = own.reshape(RANGES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array([pa.compress(r.tobytes(), "zstd", asbytes=True) for r in rows], pa.binary())], ["range", "z"])

    def add(batches):
        import pyarrow as pa

        width = (1 << SLOT_BITS) // RANGES
        sums = {}
        for batch in batches:
            for r, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(pa.decompress(z, width, "zstd", asbytes=True), np.uint8)
                if r not in sums:
                    sums[r] = np.zeros(width, np.int64)
                sums[r] += part
        for r, n in sums.items():
            level = np.where(n < 16, n, 11 + np.log2(np.maximum(n, 1)).astype(np.int64)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["range", "level"])

    parts = docs.select("text").mapInArrow(count, "range int, z binary")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros((RANGES, (1 << SLOT_BITS) // RANGES), np.uint8)
    for r, level in parts.repartition(n, "range").mapInArrow(add, "range int, level binary").collect():  # the sketch's size in all
        out[r] = np.frombuffer(level, np.uint8)
    return out.reshape(-1)


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """A bitmap of 2**MAP_BITS bits over the top bits of a 64-bit column; its size does not depend on the rows."""
    shift = 64 - MAP_BITS
    words = values.select(F.shiftrightunsigned(column, shift).alias("bit")).groupBy(F.shiftrightunsigned("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("bits"))
    got = words.toArrow()  # columns: rows would be an object a word in the driver
    out = np.zeros(1 << (MAP_BITS - 5), np.uint32)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return out


def in_bitmap(bits: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    at = tokens >> np.uint64(64 - MAP_BITS)
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def packed(tokens: np.ndarray) -> bytes:
    """Sorted tokens as the differences of their upper 48 bits, low bytes together, compressed: about 5 bytes each."""
    import pyarrow as pa

    own = tokens >> np.uint64(16)
    own = own[np.append(True, own[1:] != own[:-1])]
    planes = np.diff(own, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T
    return len(own).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int.from_bytes(raw[:4], "little")
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :6] = np.frombuffer(pa.decompress(raw[4:], 6 * n, "zstd", asbytes=True), np.uint8).reshape(6, n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64)


def _second(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens ^ np.uint64(0xA24BAED4963EE407))


def _described(docs: DataFrame, k: int, percent: int, levels) -> DataFrame:
    """(doc_id, n, class, ga, gb, leading tokens) of every document."""

    def run(batches):
        import pyarrow as pa

        level_of = levels.value
        shift = np.uint64(64 - SLOT_BITS)
        for batch in batches:
            names = batch.column(0)
            rows, n, sig, ga, gb, leads = [], [], [], [], [], []
            for row, tokens in shingle_sets(batch.column(1), k):
                rows.append(row)
                n.append(len(tokens))
                sig.append(hashlib.blake2b(tokens, digest_size=16).digest())
                ga.append(int(tokens[0].view(np.int64)) if len(tokens) else None)
                gb.append(int(_second(tokens).min().view(np.int64)) if len(tokens) else None)
                p = lead(len(tokens), percent)
                # tokens are sorted by hash, so a stable sort by level gives the order (level, hash)
                leads.append(tokens[np.argsort(level_of[tokens >> shift], kind="stable")[:p]].view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in leads]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(leads) if leads else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([names.take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(ga, pa.int64()), pa.array(gb, pa.int64()), lists], ["doc_id", "n", "class", "ga", "gb", "leads"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, class binary, ga long, gb long, leads array<long>")


def _tokens_of(docs: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """(cid, n, tokens) of the documents of some ids, read from the texts again; a bitmap of the ids leaves out nearly all others."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("cid").alias("h")), "h"))

    def run(batches):
        import pyarrow as pa

        bits = wanted.value
        for batch in batches:
            keep = in_bitmap(bits, np.asarray(batch.column(2)).view(np.uint64))
            if not keep.any():
                continue
            batch = batch.filter(pa.array(keep))
            names, rows, done = batch.column(0), [], 0
            for row, tokens in shingle_sets(batch.column(1), k):
                if len(tokens):
                    rows.append((row, len(tokens), packed(tokens)))
                    done += len(tokens)
                if done > 250_000:
                    yield _rows(names, rows)
                    rows, done = [], 0
            yield _rows(names, rows)

    def _rows(names, rows):
        import pyarrow as pa

        row, n, tokens = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([names.take(pa.array(row, pa.int64())), pa.array(n, pa.int64()), pa.array(tokens, pa.binary())], ["cid", "n", "tokens"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long"))).mapInArrow(run, "cid long, n long, tokens binary")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the pairwise intersections of a bounded number of sets."""
    m = len(sets)
    token, inverse, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    keep = many[inverse] > 1
    number = np.cumsum(many > 1) - 1
    owner, column = owner[keep], number[inverse[keep]]
    out = np.zeros((m, m), np.int64)
    width = max(1, 4_000_000 // m)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int((many > 1).sum()), width):
        a, z = np.searchsorted(column, (lo, lo + width))
        part = np.zeros((m, min(width, column[z - 1] - lo + 1)), np.float32)
        part[owner[a:z], column[a:z] - lo] = 1
        out += (part @ part.T).astype(np.int64)
    return out


def _pairs_of(percent: int):
    def run(group):
        import pyarrow as pa

        cid = np.asarray(group.column("cid").combine_chunks())
        sets = [unpacked(t) for t in group.column("tokens").to_pylist()]
        size = np.array([len(s) for s in sets])
        inter = overlaps(sets)
        link = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
        a, b = np.nonzero(np.triu(link, 1))
        return pa.table({"u": pa.array(cid[a]), "v": pa.array(cid[b])})

    return run


def _parts(ids: DataFrame, key: str, least: int) -> DataFrame:
    """(cid, key, part) of the classes in groups of one min-hash that at least so many classes share."""
    sizes = ids.groupBy(key).agg(F.count("*").alias("c"), F.sum("n").alias("total")).where(F.col("c") >= least)
    parts = F.ceil(F.greatest(F.col("c") / GROUP, F.col("total") / GROUP_TOKENS))
    rows = ids.select(key, "cid").join(sizes, key)
    return rows.select("cid", F.lit(key).alias("by"), F.col(key).alias("key"), F.pmod(F.xxhash64("cid", F.lit(key)), parts).alias("part"))


def _opened(percent: int):
    """Query classes against one group: bound by the union of its tokens, then member by member."""

    def run(members, queries):
        import pyarrow as pa

        u, v = [], []
        if members.num_rows and queries.num_rows:
            names = members.column("cid").to_pylist()
            sets = [unpacked(t) for t in members.column("tokens").to_pylist()]
            union, inverse = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            order = np.argsort(inverse, kind="stable")
            owner, starts = owner[order], np.searchsorted(inverse[order], np.arange(len(union) + 1))
            size = np.array([len(s) for s in sets])
            for cid, raw in zip(queries.column("cid").to_pylist(), queries.column("tokens").to_pylist(), strict=True):
                own = unpacked(raw)
                at = np.searchsorted(union, own)
                at[at == len(union)] = 0
                at = at[union[at] == own]
                if 100 * len(at) < percent * len(own):  # no member can reach the threshold
                    continue
                n = starts[at + 1] - starts[at]
                row = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                inter = np.bincount(owner[row], minlength=len(sets))
                for i in np.flatnonzero(100 * inter >= percent * (len(own) + size - inter)):
                    if names[i] != cid:
                        u.append(cid)
                        v.append(names[i])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _asked(by: DataFrame, members: DataFrame, percent: int, scratch: Scratch, name: str, everyone: bool) -> DataFrame:
    """(gid, cid): groups that a class must be compared with, of components that share leading tokens.

    by: (token, comp, c, low, high, first), one row a token and component; members: (cid, gid, comp). Components meet a
    token's major component, the one of most classes there, or all others (everyone), each pair once a token."""
    major = by.groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp"))["comp"].alias("major")).where("comps > 1").select("token", "comps", "major")
    matrix = scratch.save(by.join(major, "token"), f"{name}_matrix")
    # Nothing before a pair's first common token is common, and one of the first LEAD common ones has LEAD - 1 before it at
    # most: with the lengths that bounds the overlap, so most rows can only meet much shorter ones, and hot tokens' rows
    # meet by classes of length. That leaves at least the first LEAD common tokens of every pair that can link.
    size = lambda c: F.floor(F.log(F.greatest(c, F.lit(1))) * STEP)
    least = F.ceil(F.col("low") * percent / 100)
    most = F.floor(((F.col("high") - F.col("first") + LEAD - 1) * (100 + percent) - F.col("low") * percent) / percent)
    bounded = matrix.select("*", least.alias("least"), most.alias("most"))
    hot, once_only = F.col("comps") > MANY, F.array(F.lit(0).cast("long"))
    own = F.struct("comp", "low", "high", "first", "least", "most")
    one = bounded.where("comp <> major AND most >= least").select("token", "comps", F.explode(F.when(hot, F.sequence(size("least"), size("most"))).otherwise(once_only)).alias("length"), own.alias("one"))
    two = (bounded if everyone else bounded.where("comp = major")).select("token", "major", F.explode(F.when(hot, F.sequence(size("low"), size("high"))).otherwise(once_only)).alias("length"), own.alias("two"))
    fits = (F.col("one.comp") != F.col("two.comp")) & (F.col("one.least") <= F.col("two.high")) & (F.col("two.least") <= F.col("one.high")) & (F.col("two.low") <= F.col("one.most")) & (F.col("one.low") <= F.col("two.most"))
    once = (F.col("two.comp") == F.col("major")) | (F.col("one.comp") < F.col("two.comp"))
    # several classes of length may bring a pair together: it counts in the first
    once = once & (~hot | (F.col("length") == F.greatest(size("two.low"), size("one.least"))))
    pairs = one.join(two, ["token", "length"]).where(fits & once)
    ordered = F.col("one.comp") < F.col("two.comp")
    pairs = pairs.select(F.when(ordered, F.col("one")).otherwise(F.col("two")).alias("p"), F.when(ordered, F.col("two")).otherwise(F.col("one")).alias("q"))
    sides = [f(f"{side}.{c}").alias(f"{side}_{c}") for side in "pq" for f, c in ((F.min, "low"), (F.max, "high"), (F.min, "first"))]
    pairs = pairs.groupBy(F.col("p.comp").alias("p"), F.col("q.comp").alias("q")).agg(F.count("*").alias("common"), *sides)
    if everyone:
        # nothing before the first common token is common: that bounds the overlap from either side
        least = (F.col("p_low") + F.col("q_low")) * percent
        few = F.least(F.lit(LEAD), F.ceil(F.least("p_low", "q_low") * percent / 100))
        pairs = pairs.where((F.col("common") >= few) & ((F.col("p_high") - F.col("p_first")) * (100 + percent) >= least) & ((F.col("q_high") - F.col("q_first")) * (100 + percent) >= least))
    # the smaller of two components asks the groups of the larger
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    pairs = pairs.select("p", "q").join(sizes.select(F.col("comp").alias("p"), F.col("size").alias("ps")), "p").join(sizes.select(F.col("comp").alias("q"), F.col("size").alias("qs")), "q")
    p_asks = F.col("ps") <= F.col("qs")
    pairs = pairs.select(F.when(p_asks, F.col("p")).otherwise(F.col("q")).alias("asker"), F.when(p_asks, F.col("q")).otherwise(F.col("p")).alias("asked"))
    groups = members.select(F.col("comp").alias("asked"), "gid").distinct()
    return pairs.join(members.select(F.col("comp").alias("asker"), "cid"), "asker").join(groups, "asked").select("gid", "cid").distinct()


def _across(docs: DataFrame, k: int, asked: DataFrame, groups: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Links between queries and the groups they ask."""
    parts = scratch.save(asked.groupBy("gid").agg(F.ceil(F.count("*") / QUERIES).alias("parts")), f"{name}_parts")
    queries = asked.join(parts, "gid").withColumn("part", F.pmod(F.xxhash64("cid"), "parts")).select("gid", "part", "cid")
    members = groups.join(parts, "gid").select("gid", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), "cid")
    # written, so that few ids are known to be few before the sets are joined to them
    queries, members = scratch.save(queries, f"{name}_queries"), scratch.save(members, f"{name}_members")
    tokens = scratch.save(_tokens_of(docs, k, queries.select("cid").union(members.select("cid")).distinct()), f"{name}_tokens", "none")
    queries, members = (df.join(scratch.load(f"{name}_tokens", tokens.schema).select("cid", "tokens"), "cid").select("gid", "part", "cid", "tokens") for df in (queries, members))
    return members.groupBy("gid", "part").cogroup(queries.groupBy("gid", "part")).applyInArrow(_opened(percent), "u long, v long")


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """documents (doc_id, text) -> (doc_id, n_shingles, component_id), by word k-shingles and Jaccard >= percent / 100."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "setjoin")
    levels = spark.sparkContext.broadcast(sketch(docs, k))
    scratch.free()
    described = scratch.save(_described(docs, k, percent, levels), "with_leads")
    leads, described = described, scratch.save(described.select("doc_id", "n", "class"), "described")

    classes = described.where("doc_id is not null and n > 0").groupBy("class").agg(F.min("doc_id").alias("cid"))
    classes = scratch.save(classes, "classes")
    first = leads.join(classes, "class").where("doc_id = cid").select("cid", "n", "ga", "gb", "leads")
    # every leading token travels twice, so with as little as can be: lengths are joined to what is left of them
    postings = first.select(F.posexplode("leads").alias("pos", "token"), "cid")
    twice = postings.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    shared = scratch.save(postings.join(twice, "token"), "shared")

    few = F.least(F.lit(LEAD), F.ceil(F.col("n") * percent / 100 * percent / 100))
    some = shared.groupBy("cid").agg(F.count("*").alias("c"))
    ids = scratch.save(first.select("cid", "n", "ga", "gb").join(some, "cid").where(F.col("c") >= few).drop("c"), "ids")
    scratch.drop("with_leads")
    scratch.free()
    parts = scratch.save(_parts(ids, "ga", 2).union(_parts(ids, "gb", GROUP)), "near_parts")
    tokens = _tokens_of(docs, k, parts.select("cid").distinct())
    near = parts.join(tokens.select("cid", "tokens"), "cid").groupBy("by", "key", "part").applyInArrow(_pairs_of(percent), "u long, v long")
    # written before its components are made: two Python steps in one stage would keep twice as many workers
    found = scratch.save(components(scratch.save(near, "near"), scratch, "near_cc"), "found")
    scratch.drop("near")
    scratch.free()

    comp, comp_now = (F.coalesce("component", c).alias("comp") for c in ("cid", "comp"))
    grouped = ids.select("cid", "n", "ga").join(found.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "n", "ga", comp)
    chunk = grouped.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("chunks"))
    groups = grouped.join(chunk, "comp").select("cid", F.xxhash64("comp", F.pmod(F.xxhash64("ga", "cid"), "chunks")).alias("gid"))
    groups = scratch.save(groups, "groups")
    shared = shared.join(ids.select("cid", "n").distinct(), "cid").select("token", "pos", "cid", "n")

    # First against each token's major component alone, which takes in most of what is left of large clusters; then
    # everyone, without the questions that have been asked.
    links, asked = found.select(F.col("node").alias("u"), F.col("component").alias("v")), None
    for name in ("major", "all"):
        members = scratch.save(groups.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("cid", "gid", comp), f"{name}_ids")
        if name == "major":
            facts = [F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("first")]
            by = shared.join(members.select("cid", "comp"), "cid").groupBy("token", "comp").agg(*facts)
        else:
            # components have only merged since, so a token of one component then has one now, and facts merge as they are
            facts = [F.sum("c").alias("c"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("first").alias("first")]
            before = scratch.load("major_matrix").select("token", "comp", "c", "low", "high", "first")
            merged = before.join(found.withColumnRenamed("node", "comp"), "comp", "left")
            by = merged.groupBy("token", comp_now).agg(*facts)
        ask = _asked(by, members, percent, scratch, name, name == "all")
        asked = scratch.save(ask if asked is None else ask.join(asked, ["gid", "cid"], "left_anti"), f"{name}_asked")
        far = scratch.save(_across(docs, k, asked, groups, percent, scratch, name), f"{name}_far")
        scratch.drop(f"{name}_tokens", *(["major_matrix", "all_matrix"] if name == "all" else []))
        scratch.free()
        links = links.union(far.select("u", "v"))
        if name == "major":
            found = scratch.save(components(links, scratch, "major_cc"), "major_found")

    final = scratch.save(components(links, scratch, "cc"), "final")
    ids = classes.join(final.withColumnRenamed("node", "cid"), "cid", "left").select("class", F.coalesce("component", "cid").alias("component_id"))
    out = described.select("doc_id", "n", "class").join(ids, "class", "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))

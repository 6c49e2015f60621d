"""The corpus operators against brute force on small fixtures, with nulls, empty and long texts, ties, repeated rows,
empty tables and columns of clashing names."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from karst.llm import addquant, common, idfile, langid, linededup, nearvec, packing, pieces, pii, queries, setjoin, tokens, warc

BPE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(BPE)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, length string, key string, n double, score string, row int, held_out int, n_chunks string"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 400)) for _ in range(n))


def rows():
    rng = random.Random(5)
    base = sentence(rng, 90)
    near = base.replace(base.split()[40], "changed")
    texts = [base, near, base, None, "", "   \n\t ", "short", "a b c", "a b c", "12 34 !!", "<|endoftext|> a <|endoftext|>", "x y\nz", "日本語 テキスト 😀 é", "w " * 4000, sentence(rng, 3000)]
    texts += [sentence(rng, rng.randint(4, 60)) for _ in range(12)]
    passage = "\n".join(sentence(rng, 12) for _ in range(9))
    texts += [sentence(rng, 8) + "\n" + sentence(rng, 9) + "\n" + passage + "\n" + sentence(rng, 7) for _ in range(4)]
    out = [(i, t, "en" if i % 2 else "de", "s", len(t or ""), i, "L", "k", 0.5, "sc", 7, 1, "c") for i, t in enumerate(texts)]
    return out + [out[0], (None, base, None, None, None, None, None, None, None, None, None, None, None), (None, None, *[None] * 11)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids_of(text, end):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], "<u4")


# ------------------------------------------------ tokens, packing, id files


def test_pieces_encode_alone():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", ".", "'s", "'", "é", " ", " ", "7", "日", "😀", "-", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    got = [ids[at[i] : at[i + 1]].tolist() for _, _, ids, at in tokens.token_blocks(pa.array(texts), BPE) for i in range(len(at) - 1)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    lengths, counts = np.unique(np.minimum(rng.geometric(0.01 if seed % 2 else 0.004, 3000), 256), return_counts=True)
    keys, first, offset, _ = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)), 256)
    seq = collections.defaultdict(list)
    for length, n in zip(lengths, counts, strict=True):
        for rank in range(n):
            at = np.searchsorted(keys, (int(length) << 40) | rank, "right") - 1
            seq[first[at] + rank - (keys[at] & ((1 << 40) - 1))].append((offset[at], length))
    for own in seq.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 256
    assert len(seq) <= -(-int((lengths * counts).sum()) // 256) * 1.02 + 2


def check_packing(packed, source, limit=1024):
    seen, seq = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        seen[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    want = collections.Counter()
    for r in source:
        ids = ids_of(r[1], 2)
        first = len(ids) % limit or limit
        cuts = [0, *range(first, len(ids) + 1, limit)]
        for k, (a, z) in enumerate(itertools.pairwise(cuts)):
            want[r[0], k, a, z - a, zlib.crc32(ids[a:z])] += 1
    assert seen == want
    for own in seq.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= limit


def test_packing(docs, none):
    check_packing(packing.pack_documents(docs, BPE).collect(), rows())
    assert packing.pack_documents(none, BPE).count() == 0
    full = packing.sequences(packing.pack_documents(docs, BPE, with_ids=True))
    total = sum(len(ids_of(r[1], 2)) for r in rows())
    assert full.selectExpr("sum(length(ids)) / 4").first()[0] == total


def test_id_file(spark, docs, none):
    path = common.Scratch(spark, "t").base
    idfile.write(docs, path, BPE)
    got = sorted(idfile.read(spark, path, with_ids=True).collect(), key=lambda r: r["start"])
    at, before = 0, None
    for r in got:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert before is None or r["doc_id"] >= before
        at, before = at + r["n_tokens"], r["doc_id"]
    assert collections.Counter((r["doc_id"], bytes(r["ids"])) for r in got) == collections.Counter((r[0], ids_of(r[1], 0).tobytes()) for r in rows())
    empty = common.Scratch(spark, "t").base
    idfile.write(none, empty, BPE)
    assert idfile.read(spark, empty).count() == 0


def test_byte_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        x = rng.integers(0, [256, 70000, 2**32][n % 3], n).astype("<u4")
        control, data = idfile.encode(x)
        back, took = idfile.decode(control, data, n)
        assert (back == x).all() and took == len(data)


# ------------------------------------------------ WARC


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<html lang=en><title>T &amp; t</title><script>var a='<p>';</script><p>Hi<br>you</p><!-- no --><a href=x>l</a>", 3), (2, None, None, 3), (None, "u", "", 3), (1, "http://a/x", "<p>open <b", 3)], "page_id long, url string, html string, record int")
    made = warc.responses(pages)
    out = warc.derivatives(made)
    source = {r["record_id"]: r for r in made.collect()}
    got = out.collect()
    assert len(got) == 8 and {r["warc_type"] for r in got} == {"metadata", "conversion"}
    for r in got:
        (headers, block), = warc.parse(bytes(r["record"]))
        assert r["refers_to"] in source and headers["WARC-Target-URI"] == source[r["refers_to"]]["target_uri"]
        assert r["payload_digest"] == source[r["refers_to"]]["payload_digest"] and r["block_digest"] == warc.digest(block) and int(headers["Content-Length"]) == len(block)
    texts = [bytes(r["record"]).split(b"\r\n\r\n", 1)[1].strip() for r in got if r["warc_type"] == "conversion"]
    assert b"T & t\nHi\nyou\nl" in texts and b"open" in texts
    path = common.Scratch(spark, "t").base
    warc.write_files(out, path)
    assert sorted(bytes(r["record"]) for r in warc.read_records(spark, path).collect()) == sorted(bytes(r["record"]) for r in got)
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


# ------------------------------------------------ lines


def plain_line_dedup(source):
    def lone(line):
        return len(re.findall("[^ \t-\r]+", line)) > linededup.LONE

    def free(c):
        return len("\n".join(c)) >= linededup.LEAST if len(c) > 1 else lone(c[0])

    def chunks(text):
        lines, out, own = text.split("\n"), [], []
        h = [0] + [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        r = [(a * 31 + b) % linededup.MODULUS for a, b in itertools.pairwise(h)]
        for i, x in enumerate(lines):
            own.append(x)
            low = 0 < i < len(lines) - 2 and r[i - 1] > r[i] <= r[i + 1]
            if i == len(lines) - 1 or lone(x) or lone(lines[i + 1]) or low and not lone(lines[i - 1]) and not lone(lines[i + 2]):
                out.append(own)
                own = []
        return out

    first = {}
    for r in sorted((r for r in source if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        for k, c in enumerate(chunks(r[1])):
            if free(c):
                first.setdefault("\n".join(c), (r[0], k))
    out = []
    for r in source:
        if r[0] is None or r[1] is None:
            out.append((r[0], r[1]))
            continue
        kept = ["\n".join(c) for k, c in enumerate(chunks(r[1])) if not free(c) or first.get("\n".join(c), (r[0], k)) == (r[0], k)]
        out.append((r[0], "\n".join(kept)))
    return out


def test_passages_of_lines(spark):
    rng = random.Random(11)
    long_line, block = sentence(rng, 60), [sentence(rng, 6) for _ in range(30)]
    around = [[sentence(rng, rng.randint(2, 30)) for _ in range(5)] for _ in range(6)]
    texts = [long_line, "\n".join([around[0][0], long_line]), "\n".join([*around[1], *block, *around[2]]), "\n".join([*around[3], *block, *around[4]]), "\n".join(around[5])]
    source = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in linededup.remove(spark.createDataFrame(source, "doc_id long, text string")).collect()}
    assert got == dict(plain_line_dedup(source))
    # a lone long line goes from all texts but the first, and of a long block at most the lines at its ends stay
    assert [got[i] for i in (0, 2, 4)] == [texts[i] for i in (0, 2, 4)] and got[1] == around[0][0]
    assert set(around[3] + around[4]) <= set(got[3].split("\n")) and len(set(block) & set(got[3].split("\n"))) < 15


def test_line_dedup(docs, none):
    got = linededup.remove(docs.drop("n_chunks")).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in got) == collections.Counter(plain_line_dedup(rows()))
    assert sum(r["n_removed"] for r in got) > 0
    assert linededup.remove(none.select("doc_id", "text")).count() == 0
    plan = linededup.remove(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ------------------------------------------------ languages


def test_language_id(spark):
    out = queries.op5_hierarchical_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_language_id_cases(docs, none):
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(docs.drop("score", "held_out"), ["doc_id", "text"]).collect()}
    for (_, text), r in got.items():
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, text or ""))), text
        assert r["lang_pred"] != "und" or r["score"] == 0
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# ------------------------------------------------ sets


def plain_components(source, k, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = []
    for doc, text, *_ in source:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets.append((doc, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    return collections.Counter((d, len(s), None if d is None else find(d) if s else d) for d, s in sets)


def near_rows():
    """Clusters of edited copies, chains, shared passages, and copies in numbers."""
    rng = random.Random(11)
    texts = []
    passage = sentence(rng, 60)
    for c in range(6):
        base = sentence(rng, rng.choice([12, 40, 120])).split()
        for _ in range(rng.choice([2, 9, 30])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 99)}"
            texts.append(" ".join(own))
    texts += [sentence(rng, 50) + " " + passage for _ in range(25)] + [passage + " " + sentence(rng, 6) for _ in range(12)]
    chain = sentence(rng, 60).split()
    for i in range(12):
        chain[5 * i % 60] = f"step{i}"
        texts.append(" ".join(chain))
    texts += ["one copy of many words here"] * 40 + ["A  b"] * 3 + ["a b"] * 2
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_set_join(spark, k, percent, monkeypatch):
    monkeypatch.setattr(setjoin, "GROUP", 5)  # several groups a cluster
    monkeypatch.setattr(setjoin, "QUERIES", 4)
    source = near_rows()
    got = setjoin.link_components(spark.createDataFrame(source, "doc_id long, text string"), k, percent).collect()
    assert collections.Counter(map(tuple, got)) == plain_components(source, k, percent)


def test_set_join_cases(docs, none):
    got = setjoin.link_components(docs, 4, 85).collect()
    assert collections.Counter(map(tuple, got)) == plain_components(rows(), 4, 85)
    assert setjoin.link_components(none, 4, 85).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 560)] + [tuple(rng.sample(range(1000, 1400), 2)) for _ in range(150)]
    parent = {}
    for e in edges:
        for x in e:
            parent.setdefault(x, x)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    got = common.components(spark.createDataFrame(edges, "u long, v long").repartition(7), common.Scratch(spark, "t")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent}


def test_components_end_with_stars(spark, monkeypatch):
    saved, save = [], common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, name, *a: saved.append(name) or save(self, df, name, *a))
    for edges, rounds in (([], 0), ([(5, 1), (5, 1), (9, 1), (3, 2)], 0), ([(5, 1), (1, 5), (7, 7), (9, 5)], 0)):
        saved.clear()
        got = common.components(spark.createDataFrame(edges, "u long, v long").coalesce(1), common.Scratch(spark, "t"), "s").collect()
        assert saved == [f"s{i}" for i in range(rounds + 1)]
        assert {r["node"]: r["component"] for r in got} == ({} if not edges else {1: 1, 5: 1, 9: 1, 3: 2, 2: 2} if (3, 2) in edges else {1: 1, 5: 1, 9: 1})
    saved.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long").repartition(40, "u")
    got = common.components(chain, common.Scratch(spark, "t"), "c").collect()
    assert len(saved) > 1 and {r["node"]: r["component"] for r in got} == {i: 0 for i in range(41)} and len(got) == 41


# ------------------------------------------------ vectors


def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16)).round(3)
    for i in range(60, 120):
        v[i] = v[i % 7] + rng.normal(scale=0.08, size=16)
    v[130] = v[131] = v[132]
    data = [(i, [float(x) for x in v[i]], int(i % 3)) for i in range(300)]
    data += [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 1), (303, [None] + [1.0] * 15, 1), (304, data[5][1], None), (305, [1.0, 2.0], 0), (None, data[5][1], 2)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("v", F.lit(1)).withColumn("id", F.lit("x"))


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearvec, "BLOCK", 30)
    data, df = vectors(spark)
    good = {i: (np.array(v), lab) for i, v, lab in data if i is not None and lab is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    links, parent = collections.Counter(), {i: i for i, _, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, (x, p)), (b, (y, q)) in itertools.combinations(good.items(), 2):
        if p == q and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
            links[a] += 1
            links[b] += 1
            s, t = sorted((find(a), find(b)))
            parent[t] = s
    assert sum(links.values()) > 20
    got = {r["vec_id"]: r for r in nearvec.near_duplicates(df).collect()}
    assert len(got) == len(data)
    for i, r in got.items():
        assert (r["n_links"], r["component_id"]) == (links[i], find(i) if i is not None else None), i
        assert r["kept"] == (i is None or find(i) == i)
    assert nearvec.near_duplicates(df.limit(0)).count() == 0


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 48))
    y = x + rng.normal(scale=0.3, size=x.shape)
    u, w = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    turned, _, _ = nearvec.codes(u)
    _, bits, factor = nearvec.codes(w)
    may = nearvec.candidates(turned, bits, factor, 0.9)
    assert may[u @ w.T >= 0.9].all() and may.mean() < 0.05


def test_search(spark):
    data, df = vectors(spark)
    got = addquant.search(df, "id % 20 = 0", k=7).collect()
    good = {i: np.array(v) for i, v, _ in data if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in [i for i in good if i % 20 == 0]:
        want = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:7]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 8)) and all(abs(r["score"] - float(good[q] @ good[r["vec_id"]])) < 1e-12 for r in own)
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits, total = hits + len({i for _, i in want} & {r["vec_id"] for r in own}), total + 7
    assert hits >= 0.9 * total
    assert addquant.search(df.limit(0), "id % 20 = 0").count() == 0
    assert addquant.search(df.where("vec_id < 3"), "id = 0", k=7).count() == 2


def test_search_recall(spark):
    got = queries.op6_additive_quantisation(spark, SF).collect()
    rows_ = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in rows_]), np.array([r["embedding"] for r in rows_], float)
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(want & {r["vec_id"] for r in got if r["query_id"] == ids[i]}), total + 20
    assert hits >= 0.9 * total


# ------------------------------------------------ pieces


def unigram_library(path):
    """The library with the same pieces and scores, its model type set to the unigram lattice."""
    import sentencepiece

    raw = open(path, "rb").read()

    def number(b, i):
        out = shift = 0
        while True:
            out |= (b[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if not b[i - 1] & 128:
                return out, i

    def coded(n):
        out = b""
        while True:
            out += bytes([(n & 127) | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    out, i = b"", 0
    while i < len(raw):
        tag, j = number(raw, i)
        n, k = number(raw, j)
        body = raw[k : k + n]
        if tag >> 3 == 2:
            body += coded(3 << 3) + b"\x01"  # the last value of a field counts
        out += coded(tag) + coded(len(body)) + body
        i = k + n
    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(out)
    return sp


def test_pieces_match_the_library():
    path = queries.PIECES
    sp, memo = unigram_library(path), pieces.words(path)
    rng = random.Random(6)
    # the first of the library's n-best segmentations is its lattice's best path
    texts = ["the a", "Hello world", "the theta", "ñandú Über", *(re.sub("[0-9]", lambda m: "abcdefghij"[int(m[0])], sentence(rng, 3)) for _ in range(60))]
    score = {i: sp.get_score(i) for i in range(sp.get_piece_size())}
    for t in texts:
        chars = pieces.characters(t)
        ids = memo.run(chars, np.array([0, len(chars)]))[0]
        assert abs(sum(score[i] for i in ids) - sum(score[i] for i in sp.nbest_encode_as_ids(t, 2)[0])) < 1e-3, t
        assert pieces.decode(ids.astype("<u4").tobytes(), path) == t


@pytest.mark.parametrize("chunk", [40, 101])
def test_chunks_give_the_best_score(spark, docs, chunk):
    path = queries.PIECES
    memo = pieces.words(path)
    got = collections.defaultdict(list)
    long = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).where("doc_id <> 13")
    for r in pieces.encode(long, path, chunk, with_ids=True).collect():
        assert r["round_trip"], r
        got[r["doc_id"]].append((r["chunk"], bytes(r["ids"])))
    texts = {r[0]: r[1] for r in rows()}
    assert set(got) == {r["doc_id"] for r in long.collect()}
    score = lambda ids: sum(memo.model.score[np.flatnonzero(memo.model.id == i)[0]] for i in ids if i in known)
    known = set(memo.model.id[memo.model.id >= 0].tolist())
    for doc, parts in got.items():
        ids = b"".join(b for _, b in sorted(parts))
        text = texts[doc] or ""
        assert [k for k, _ in sorted(parts)] == list(range(len(parts)))
        assert pieces.decode(ids, path) == text
        chars = pieces.characters(text)
        whole = memo.run(chars, np.array([0, len(chars)]))[0]
        assert abs(score(np.frombuffer(ids, "<u4")) - score(whole)) < 1e-6


def test_product_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((6, 6)) < 0.3, pieces.NONE, rng.normal(size=(6, 6))) for _ in range(3))
    left, right = pieces.product(pieces.product(a, b), c), pieces.product(a, pieces.product(b, c))
    assert np.allclose(np.maximum(left, -1e17), np.maximum(right, -1e17))


# ------------------------------------------------ personal data


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "x@y.z", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111111111111111", "+1 (415) 555-2671", "+", "-", " ", "(", ")", "%", "é", "😀", "12", "9", "."]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_field_adds_other_spellings(spark):
    w = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    found = lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t, w)[1]]
    assert found("write to jane.doe [at] mail [dot] example [dot] com today") == [("email", "jane.doe [at] mail [dot] example [dot] com")]
    assert found("call (415) 555-2671 now") == [("phone", "(415) 555-2671")]
    clean = ["In 2021-03-04 we met at 10 dots.", "It cost 1,234,567.89 in all", "version 1.2.3 of 2020", "look at the dot", "order 123456 of 78", ""]
    assert [found(t) for t in clean] == [[]] * len(clean)


def test_pii(docs, none):
    extra = docs.withColumn("text", F.concat("text", F.lit(" a.b@c.de, +1 (415) 555-2671 and 10.0.0.1")))
    for r in pii.find(extra, ["doc_id", "text"]).collect():
        base = plain_base(r["text"] or "")
        assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[1] == i for b in base) for i in range(4)]
        assert set(filter(None, pii.written(base).split(","))) <= set(r["spans"].split(","))
    out = pii.redact(extra)
    assert out.columns == docs.columns and not out.where("text like '%a.b@c.de%'").count()
    assert pii.find(none).count() == 0


# ------------------------------------------------ the pipeline


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    source = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "personal_data", "packing"]
    own = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = own.collect()
        own = stage(spark, own, str(tmp_path))
        assert own.columns == docs.columns and [t for _, t in own.dtypes] == [t for _, t in docs.dtypes]
        after = own.collect()
        if name == "language_id":
            assert collections.Counter(map(tuple, after)) == collections.Counter(tuple(r) for r in before if any(map(str.isalpha, r["text"] or "")))
        if name == "near_duplicates":
            groups = {c for _, _, c in plain_components([(r["doc_id"], r["text"]) for r in before], 5, 80) if c is not None}
            assert {r["doc_id"] for r in after} == groups and len(after) == len(groups)
    check_packing(corpus_pipeline.run(spark, str(tmp_path)).collect(), [(r["doc_id"], r["text"]) for r in own.collect()])


def test_pipeline_of_nothing(spark, none, tmp_path):
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    json.dumps(__spark_entry__.oracle_sql())

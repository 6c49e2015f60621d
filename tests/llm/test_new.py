"""Whitening, phrase collocations and toxicity against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from karst.llm import phrases, toxicity, whitening

# ------------------------------------------------ whitening


def spectrum_of(x):
    out = whitening.Spectrum(x.shape[1])
    for row in x:
        out.add(row)
    return out


@pytest.mark.parametrize("kind", ["plain", "repeated", "binary", "constant", "one", "flat", "huge"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(4)
    x = {
        "plain": rng.normal(size=(300, 20)) * np.linspace(1, 9, 20) + 1e5,
        "repeated": np.repeat(rng.normal(size=(7, 12)), 30, 0),
        "binary": rng.integers(0, 2, (200, 6)).astype(float),
        "constant": np.full((50, 5), 3.0),
        "one": rng.normal(size=(80, 1)),
        "flat": rng.normal(size=(60, 3)) @ rng.normal(size=(3, 16)),
        "huge": np.concatenate([np.zeros((40, 4)), 1e9 * rng.normal(size=(40, 4))]),
    }[kind]
    a, b = spectrum_of(x[: len(x) // 3]), spectrum_of(x[len(x) // 3 :])
    a.merge(b)
    for got in (spectrum_of(x), a):
        want = (x - x.mean(0)).T @ (x - x.mean(0))
        assert np.abs(got.basis * got.values @ got.basis.T - want).max() <= 1e-10 * max(1, np.abs(want).max())
        assert np.abs(got.basis.T @ got.basis - np.eye(x.shape[1])).max() < 1e-10
        assert np.allclose(got.mean, x.mean(0)) and got.n == len(x)


def vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1 * (j + 1)) for j in range(6)], 1, 2) for i in range(300)]
    rows += [rows[0], rows[0], (None, [0.0] * 6, 1, 1), (500, None, 1, 1), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 1), (502, [float("nan")] * 6, 1, 1)]
    rows += [(503, [float("inf")] * 6, 1, 1), (504, [], 1, 1), (505, [1.0, 2.0, 3.0], 1, 1), (506, [0.5, 0.5, -3.0], 1, 1), (507, [1.5] * 11, 1, 1), (508, [1e300] * 6, 1, 1)]
    return rows


def test_whiten(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component int, n int").repartition(5)
    got = whitening.whiten(df).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["vec_id"]].append(r)
    good = [(r[0], np.floor(1024 * np.array(r[1])).astype(int) + 100000) for r in rows if r[1] and len(r[1]) == 6 and all(c is not None and np.isfinite(c) and abs(c) < 2**42 for c in r[1])]
    x = np.array([v for _, v in good])
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    assert sum(len(v) for k, v in by.items() if k not in (505, 506)) == 6 * n
    for i, (key, v) in enumerate(good):
        own = [r for r in by[key] if r["n"] == n]
        assert {r["deviation"] for r in own} == {int(((n * v - s) ** 2).sum())}
        for r in own:
            k = r["component"] - 1
            assert abs(abs(r["whitened"]) - abs(y[i] @ u[:, k]) / np.sqrt(e[k])) < 1e-9
            assert abs(r["explained"] - e[k] / e.sum()) < 1e-12 and r["identity_error"] < 1e-9
    assert [(r["component"], r["n"]) for r in by[505]] == [(1, 2)] and 507 not in by
    assert whitening.whiten(df.where("vec_id = 3")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0


def test_deviation_without_a_long():
    x = np.array([[2.0**45, 0.0], [0.0, 0.0]])
    assert whitening.deviations(x, 2, [2**45, 0]) == [None, None]
    assert whitening.deviations(np.array([[5.0], [8.0]]), 2, [13]) == [9, 9]


# ------------------------------------------------ phrases


def plain_phrases(rows, least, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang or "und", tuple(w[i : i + k])] += 1
    out = []
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for (lang, w), a in cand.items():
        if inside[lang, w] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    out.sort()
    ranks, got = collections.Counter(), []
    for lang, score, a, p, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            got.append((lang, ranks[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(got)


def phrase_rows(seed):
    rng = random.Random(seed)
    common, rare = ["the", "of", "a", "É", "日本"], [f"w{i}" for i in range(12)]
    out = []
    for i in range(160):
        words = []
        for _ in range(rng.randint(0, 60)):
            words += rng.choice([[rng.choice(common)], [rng.choice(common)], [rng.choice(rare)], ["New", "York", "City"], ["a", "a", "a"], ["x1", "of", "x2", "x3", "x4", "x5"]])
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]) for w in words)
        out.append((i, text, rng.choice(["en", "en", "en", None, "und", "de"])))
    return [*out, out[0], out[0], (None, "the of the of", "en"), (7, None, "en"), (8, "", None), (9, " .,\n", "xx"), (10, "the of " * 9000, "de")]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 20, 2000), (2, 20, 7), (3, 40, 3), (4, 300, 50)])
def test_phrases(spark, seed, least, top):
    rows = phrase_rows(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = sorted(map(tuple, phrases.collocations(df, top, least).collect()))
    assert got == plain_phrases(rows, least, top) and got


def test_phrases_without_any(spark):
    df = spark.createDataFrame([(1, "a b", "en", 1, 2)], "doc_id long, text string, lang string, phrase int, a int")
    assert phrases.collocations(df).count() == phrases.collocations(df.limit(0)).count() == 0
    assert [r["a"] for r in phrases.collocations(df, 5, 1).collect()] == [1]


def test_small_sketches_change_nothing(spark, monkeypatch):
    rows = phrase_rows(5)
    monkeypatch.setattr(phrases, "slots_for", lambda n: 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(df, 9, 20).collect())) == plain_phrases(rows, 20, 9)


def test_scores_pass_64_bits(spark):
    df = spark.createDataFrame([(10**13, 10**13, 10**13, 10**13 - 1), (7, 5, 3, 2)], "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases.score("a", "n", "l", "r")).collect()]
    assert got == [1000 * 10**26 // (10**13 * (10**13 - 1)), 1000 * 35 // 6]


# ------------------------------------------------ toxicity


def test_ngrams():
    texts = ["Ab cd!", "", "é", "   ", "abcdefgh", "x"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    grams, at, words = toxicity.ngrams(data, offsets)

    def number(gram):
        return ((int.from_bytes(gram, "little") + (len(gram) << 56)) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - toxicity.BITS)

    for i, text in enumerate(texts):
        own = [b" " + w + b" " for w in bytes(toxicity.WORDS[list(text.encode())]).split()] if text else []
        want = [number(w[j : j + k]) for w in own for j in range(len(w)) for k in toxicity.SIZES if j + k <= len(w)]
        assert grams[at[i] : at[i + 1]].tolist() == want and words[i] == len(own)


def tables(spark):
    rng = random.Random(9)
    plain, bad = [f"word{i}" for i in range(60)], ["vile", "wretch", "filth"]
    rows, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(words) // 40):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", "s", 0.5, True))
        if i % 5:
            labels.append((i, 0, int(toxic)))
    rows += [rows[0], (None, rows[4][1], None, None, None, None), (900, None, None, None, None, None), (901, "", None, None, None, None), (902, "!!", None, None, None, None), (903, "vile " * 30000, None, None, None, None), (904, "日本 " * 300, None, None, None, None)]
    labels += [(None, 1, 1), (1, 0, None), (2, 0, 7), (3, 0, 0), (3, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic string, score double, held_out boolean").repartition(3)
    return rows, docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    rows, docs, labels = tables(spark)
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    seen = {r["doc_id"]: r for r in got}
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert seen[903]["predicted"] == 1 and seen[900]["score"] == seen[901]["score"] == seen[902]["score"] < 0.7
    assert abs(seen[None]["score"] - seen[4]["score"]) < 1e-12


def test_toxicity_ignores_held_out_labels(spark):
    _, docs, labels = tables(spark)
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(string(doc_id) as binary)) % 3 = 1, 1 - toxic, toxic) toxic")
    a, b = (sorted((str(r["doc_id"]), r["score"]) for r in toxicity.score(docs, t).collect()) for t in (labels, turned))
    assert a == b


def test_toxicity_without_labels(spark):
    _, docs, labels = tables(spark)
    assert {r["score"] for r in toxicity.score(docs, labels.where("toxic = 1")).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}


# ------------------------------------------------ line dedup of repeated ids, web records of others


def test_many_texts_of_one_id(spark):
    import time

    from karst.llm import linededup

    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(400)]
    shared = "\n".join("".join(rng.choice("xyz ") for _ in range(50)) for _ in range(30))
    rows = [(1, "\n".join(rng.choice(lines) for _ in range(60))) for _ in range(1000)] + [(1, shared)] * 1000 + [(2, shared), (None, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    start = time.time()
    got = linededup.remove(df).collect()
    assert len(got) == len(rows) and time.time() - start < 60
    kept = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert kept[1, shared] == 1000 and kept[None, shared] == 1 and sum(r["n_removed"] for r in got if r["doc_id"] == 2) > 0


def record(headers, http, payload):
    block = http + b"\r\n\r\n" + payload
    return b"WARC/1.0\r\n" + headers + b"\r\ncontent-length:" + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_others(spark):
    import gzip

    from karst.llm import warc

    page = "<title>caf\u00e9</title><p>d\u00e9j\u00e0 vu</p>"
    latin, packed = page.encode("latin-1"), gzip.compress(page.encode())
    chunked = b"".join(b"%x;q=1\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    cases = [
        record(b"warc-type:response\r\nWARC-Record-Id: <a>\r\nWARC-Target-URI:http://x/\r\n  y\r\nnonsense", b"HTTP/1.1 200 OK\r\ncontent-type:text/html;\r\n\tcharset=ISO-8859-1", latin),
        record(b"WARC-Type: response", b"HTTP/1.0 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip", chunked),
        record(b"WARC-Type: response", b"HTTP/1.0 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=nonsense", page.encode()),
        record(b"WARC-Type: response", b"HTTP/1.0 200 OK", b'<meta charset="latin-1">' + latin),
    ]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "page_id long, record binary")
    got = [r for r in warc.derivatives(df).collect() if r["warc_type"] == "conversion"]
    assert len(got) == len(cases)
    for r in got:
        _, block = next(warc.parse(bytes(r["record"])))
        assert "d\u00e9j\u00e0 vu" in block.decode(), r["page_id"]
    first = next(r for r in got if r["page_id"] == 0)
    assert first["refers_to"] == "<a>" and first["target_uri"] == "http://x/ y"


@pytest.mark.parametrize("piece", ["<a ", "<html ", "<meta ", "<title ", "<a href", "<title>x", "<svg ", "<!-- "])
def test_long_pages_take_little_time(piece):
    import time

    from karst.llm import warc

    start = time.time()
    _, block = next(warc.parse(warc.response("u", piece * (1_000_000 // len(piece)))))
    warc.derive({"WARC-Record-ID": "<a>"}, block)
    assert time.time() - start < 8

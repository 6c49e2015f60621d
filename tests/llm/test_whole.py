"""Cases in which the corpus operators once did less than the whole job."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import corpus_pipeline
from karst.llm import addquant, langid, linededup, nearvec, packing, pieces, pii, queries, warc


@pytest.fixture(scope="module")
def found(spark):
    w = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    return lambda t: [(pii.KINDS[k], t[s:e]) for s, k, e in pii.spans(t, w)[1]]


def test_pii_beside_base_matches(found):
    assert found("call (415) 555-2671, 10.0.0.1") == [("phone", "(415) 555-2671"), ("ip", "10.0.0.1")]
    assert found("(415) 555-2671, 4111 1111 1111 1111") == [("phone", "(415) 555-2671"), ("card", "4111 1111 1111 1111")]
    assert pii.regions("1.2.3.4 x 5.6.7.8", pii.base_spans("1.2.3.4 x 5.6.7.8")) == []


@pytest.mark.parametrize("text", ["10[.]0[.]0[.]1", "8[.]8[.]8[.]8", "bob [at] example.com", "jane at mail.example dot com"])
def test_pii_in_short_and_mixed_spellings(found, text):
    assert pii.regions(f"see {text} now", [])
    assert [t for _, t in found(f"see {text} now")] == [text]


def test_pii_of_plain_numbers(found):
    for text in ("meet us at example.com today", "1, 2, 3, 4", "steps 1. 2. 3. 4.", "scores 1-2 3-4 5-6", "In 2 of 3 cases we saw 4 or 5 of them"):
        assert found(text) == []


def test_text_behind_custom_and_closed_tags():
    for tag in ("<svg-icon name=x></svg-icon>", "<template-card>", "<script-loader />", "<svg width=1 />", "<svg>", "<noscript>", "<template x=1>"):
        assert warc.plain_text(f"<p>a</p>{tag}<p>rest</p>") == "a\nrest", tag
    for block in ("<!-- x -->", "<script >x</script >", "<STYLE>x</style>", "<svg><path/>x</svg>", "<svg\n>x</svg>", "<template>x</template>"):
        assert warc.plain_text(f"<p>a</p>{block}<p>rest</p>") == "a\nrest", block
    for tail in ("<!-- x", "<script>x", "<style/>x"):
        assert warc.plain_text(f"<p>a</p>{tail}<p>rest</p>") == "a", tail
    assert warc.plain_text("<svg>" * 20000 + "x" + "<template>" * 20000) == "x"


TEXTS = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abc"}


def test_near_duplicates_of_one_id(spark, tmp_path):
    rows = [(1, TEXTS["a"], "x"), (1, TEXTS["a"], "w"), (1, TEXTS["b"], "x"), (2, TEXTS["b"], "x"), (3, TEXTS["c"], "x"), (3, TEXTS["a"], "x"), (-(2**40), TEXTS["c"] + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, hash string")
    for order in (docs, docs.orderBy(F.desc("doc_id"), F.desc("text"), "hash")):
        got = corpus_pipeline.near_duplicates(spark, order, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == sorted([(1, TEXTS["a"], "w"), (1, TEXTS["b"], "x"), (-(2**40), TEXTS["c"] + " more", "x")])


def test_documents_without_labels_stay(spark, tmp_path):
    docs = spark.createDataFrame([(1, "words", None), (2, "12 !", None), (3, None, None), (4, "\u65e5", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, str(tmp_path)).collect()} == {1, 4}


def test_near_duplicates_without_ids(spark, tmp_path):
    rows = [(None, TEXTS["a"], "x"), (None, TEXTS["b"], "x"), (None, TEXTS["b"], "w"), (7, TEXTS["a"], "x"), (None, None, "x"), (8, "  ", "x"), (9, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, further string")
    got = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(7, TEXTS["a"], "x"), (None, TEXTS["b"], "w"), (None, None, "x"), (8, "  ", "x"), (9, "", "x")], key=repr)


def test_lines_of_clashing_names(spark):
    copied = "one line of words\nand a second line\nand a third one\nthe fourth line"
    rows = [(1, copied, 5, 6, "c", 7), (2, copied, 5, 6, "c", 7), (3, "x\n" + copied, 5, 6, "c", 7), (3, "y", 5, 6, "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _lines int, row int, _ends string, n_removed int")
    got = linededup.remove(docs)
    assert got.columns == ["doc_id", "text", "_lines", "row", "_ends", "n_chunks", "n_removed"]
    assert {tuple(r)[2:5] for r in got.collect()} == {(5, 6, "c")} and got.count() == 4
    plain = linededup.remove(docs.select("doc_id", "text"))
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((r["doc_id"], r["text"]) for r in plain.collect())


@pytest.mark.parametrize("text", ["ab" * 900 + " " * 70 + "xyz" * 50, "a" * 300 + " b" * 40 + "日本" * 60, "the theta of all the words " * 40])
def test_ids_do_not_depend_on_chunks(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = set()
    for chunk in (17, 40, 101, 100_000):
        made.add(b"".join(bytes(r["ids"]) for r in sorted(pieces.encode(docs, queries.PIECES, chunk, with_ids=True).collect(), key=lambda r: r["chunk"])))
    assert len(made) == 1 and pieces.decode(made.pop(), queries.PIECES) == text


def test_vectors_of_any_size(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in (v[i % 3] + 1e-3 * v[i]) * s], 1) for i, s in enumerate((1e200, 1e-200, 1.0, 1e-300, 1e300, 1e150))]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nearvec.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (1, i % 3) for i in range(6)}


def test_cosines_at_the_threshold(spark):
    angle = np.arccos(0.93) + np.array([-1e-9, 1e-9, -1e-5, 1e-5, -1e-13])
    rows = [(0, [3.0, 0.0, 0.0], 1)] + [(i + 1, [float(np.cos(a)) * 7, float(np.sin(a)) * 7, 0.0], 1) for i, a in enumerate(angle)]
    want = {i: sum(j != i and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93 for j, y, _ in rows) for i, x, _ in rows}
    got = {r["vec_id"]: r["n_links"] for r in nearvec.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == want


def test_search_within_each_length(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=5 if i % 3 else 9) * 1e30]) for i in range(120)] + [(400, [1.0])]
    got = addquant.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 10 = 0", k=4).collect()
    v = {i: np.array(x) for i, x in rows}
    for q in range(0, 120, 10):
        want = sorted((-float(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:4]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == [i for _, i in want] and np.allclose([r["score"] for r in own], [-s for s, _ in want], rtol=1e-12)
    assert all(r["query_id"] != 400 for r in got)


def test_recall_with_a_short_list(spark):
    """A shortlist of 40 of 10,000 rows: what the codes' errors open beside it must find the rest."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(10_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = addquant.search(df, "id % 100 = 0", k=20, shortlist=40).collect()
    exact = v.astype(float) @ v[::100].astype(float).T
    hits = 0
    for j in range(100):
        exact[100 * j, j] = -np.inf
        hits += len(set(np.argsort(-exact[:, j])[:20].tolist()) & {r["vec_id"] for r in got if r["query_id"] == 100 * j})
    assert hits >= 0.9 * 2000


def test_spans_beside_many_matches():
    text = "a@b.cd " * 3000 + "call (415) 555-2671 " * 3
    base, every = pii.spans(text, np.zeros((len(pii.NAMES), len(pii.KINDS))))
    assert len(base) == 3000 and set(base) <= set(every)


def test_lengths_take_no_python_of_their_own(spark):
    rows = spark.range(40).select("id", (F.col("id") % 3).alias("length"))
    ranked = packing.ranked(rows, {0: 14, 1: 13, 2: 13}, "length", ["id"])
    assert sorted((r["length"], r["rank"]) for r in ranked.collect()) == sorted((i % 3, i // 3) for i in range(40))
    assert "ExistingRDD" not in ranked._jdf.queryExecution().toString()  # what Python workers would make
    assert packing.ranked(rows.limit(0), {}, "length", ["id"]).count() == 0


@pytest.mark.parametrize("step", ["profiles", "predict"])
def test_language_of_long_batches_takes_little_memory(monkeypatch, step):
    class Docs:  # gives the function that a task would run
        schema = StructType()
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(langid, "small_batches", lambda docs: docs)
    text = ["plain words of some length " * 400] * 200
    model = langid.Model(["a", "b"], [[0, 1]], np.ones((1, langid.WIDTH), np.float32), np.ones(1), [("pair", 0, 1)])
    run = langid.profiles(Docs()) if step == "profiles" else langid.predict(Docs(), model, ["lang", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in run([pa.RecordBatch.from_pydict({"lang": ["a"] * 200, "text": text})])) == 200
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6, most

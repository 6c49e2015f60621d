"""Chains, walks, permissions, import spans and manifests on small cases; columns of callers that look like helpers."""

from pyspark.sql import functions as F

from karst.operators import aggregates, graphs, joins, windows
from karst.sources import documents, manifests


def test_chains_of_any_length(spark):
    calls = [(f"n{i:03}", f"n{i + 1:03}", i % 3 > 0) for i in range(40)] + [("n005", "x", False), ("n000", "x", False), ("other", "lost", True)]
    reached = graphs.reachable(spark.createDataFrame(calls, "from_key string, to_key string, certain boolean"), spark.createDataFrame([("n000",)], "node string"))
    got = {r["node"]: r for r in graphs.path_to_entry(reached).collect()}
    assert set(got) == {f"n{i:03}" for i in range(41)} | {"x"}
    for i in (0, 1, 7, 40):
        assert got[f"n{i:03}"]["chain"] == [f"n{k:03}" for k in range(i + 1)]
        assert got[f"n{i:03}"]["uncertain"] == sum(k % 3 == 0 for k in range(i))
    assert got["x"]["chain"] == ["n000", "x"] and got["x"]["uncertain"] == 1
    assert graphs.path_to_entry(reached.limit(0)).count() == 0


def plain_walk(edges, trees, start, most):
    order, depth, gaps, i = [start], {start: 0}, [], 0
    while i < len(order):
        src = order[i]
        for dst in sorted({d for s, d, _ in edges if s == src}):
            if dst in depth:
                continue
            if dst not in trees or len(order) >= most:
                gaps.append((dst, src, "cap" if dst in trees else "not loaded"))
            else:
                depth[dst] = depth[src] + 1
                order.append(dst)
        i += 1
    return [(t, n, depth[t]) for n, t in enumerate(order)], sorted(gaps)


def test_install_walks(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randint(0, 30), rng.randint(0, 30), rng.choice("ab")) for _ in range(90)]
    trees = [t for t in range(31) if t % 6 != 5]
    for most in (1, 4, 50):
        got = graphs.install_walk(spark.createDataFrame(edges, "src int, dst int, kind string"), spark.createDataFrame([(t,) for t in trees], "tree int"), spark.createDataFrame([(0,), (3,), (3,), (None,)], "tree int"), most).collect()
        for start in (0, 3):
            want = plain_walk(edges, set(trees), start, most)
            own = [r for r in got if r["primary"] == start]
            assert sorted((r["tree"], r["pos"], r["depth"]) for r in own if r["why"] is None) == sorted(want[0])
            assert sorted((r["tree"], r["via"], r["why"]) for r in own if r["why"]) == want[1]


def test_nested_groups_and_wildcards(spark):
    make = spark.createDataFrame
    grants = make([("g3", "top"), ("g1", "low"), ("eve", "all"), ("g1", None), (None, "all")], "principal string, role string")
    members = make([("ann", "g1"), ("g1", "g2"), ("g2", "g3"), ("g3", "g2"), ("bob", "g3"), ("ann", "g1"), (None, "g1"), ("zoe", "empty")], "user string, grp string")
    roles = make([("top", "doc:*"), ("low", "job:run"), ("all", "*")], "role string, permission string")
    catalog = make([("doc:read",), ("doc:write",), ("job:run",), ("docs:read",), (None,)], "permission string")
    got = {tuple(r) for r in aggregates.permission_union(grants, members, roles, catalog).collect()}
    every = ["doc:read", "doc:write", "job:run", "docs:read"]
    assert got == {("ann", "doc:read"), ("ann", "doc:write"), ("ann", "job:run"), ("bob", "doc:read"), ("bob", "doc:write"), *(("eve", p) for p in every)}
    assert {tuple(r) for r in aggregates.permission_union(grants, members, roles).collect()} == {("ann", "doc:*"), ("ann", "job:run"), ("bob", "doc:*"), ("eve", "*")}
    assert aggregates.permission_union(grants.limit(0), members, roles, catalog).count() == 0


def test_spans_over_lines(spark):
    text = "\nimport a\nfrom p import (\n x,\n y)\nq as r as s\nximport b\nimport a\nimport c"
    files = spark.createDataFrame([(1, text), (1, text), (2, None), (3, ""), (4, "nothing")], "doc int, content string")
    got = documents.import_spans(files, {"import": r"(?m:^)import \w+", "from": r"from \w+ import \([^)]*\)", "as": r"\b\w+ as \w+", "blank": r"\n\w+ as"}, 12).collect()
    assert sorted(map(tuple, got)) == sorted([(1, "import", 2, "import a", False), (1, "from", 3, "from p impor", True), (1, "as", 6, "q as r", False), (1, "as", 6, "r as s", False)])


def test_manifests(spark):
    docs = [
        (1, "requirements.txt", "a==1 \\\n  ; x\n# no \\\nb[e]>=1,<2 # why\n-r other.txt\n./local\nc"),
        (2, "x/requirements.txt", "a==1\\"),
        (3, "pyproject.toml", "[project]\ndependencies=['a>1', \"b # no\", # yes ]\n'c']\n[project.optional-dependencies]\n'x y' = [\n]\n[tool.poetry.dependencies]\nd = {version='1', optional=true}\n"),
        (4, "pyproject.toml", "[project]\ndependencies = ['a'"),
        (5, "package.json", '{"peerDependencies": {"r": "1"}}'),
        (6, "package.json", "["),
        (7, "package.json", "[]"),
        (8, "package.json", None),
        (9, "pom.xml", "a==1"),
    ]
    declared, files = manifests.manifests(spark.createDataFrame(docs, "doc int, name string, content string"))
    got = sorted((r["doc"], r["line"], r["section"], r["name"], r["spec"]) for r in declared.collect())
    assert got == [(1, 1, "main", "a", "==1"), (1, 4, "main", "b", ">=1,<2"), (1, 7, "main", "c", ""), (3, 2, "main", "a", ">1"), (3, 2, "main", "b", ""), (3, 3, "main", "c", ""), (3, 8, "main", "d", "1"), (4, 2, "main", "a", ""), (5, 1, "peerDependencies", "r", "1")]
    assert {r["doc"]: r["readable"] for r in files.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False, 7: False, 8: False}
    none, no_files = manifests.manifests(spark.createDataFrame([], "doc int, name string, content string"))
    assert none.count() == no_files.count() == 0


def test_columns_of_callers_stay(spark):
    left = spark.createDataFrame([(1, "a", 5, "m", 9), (2, "b", 6, None, 9)], "k int, _hit string, _n int, _m string, _sum int")
    right = spark.createDataFrame([(1, "z", 7)], "k int, _ok string, _r int")
    assert tuple(joins.enrich_coverage(left, right.withColumn("_hit", F.lit(1)), "k").first()) == (2, 1, 1)
    paired = joins.nth_occurrence(left, right, ["k"], ["_n"], ["_r"]).orderBy("k").collect()
    assert [(r["k"], r["_n"], r["_r"], r["n"]) for r in paired] == [(1, 5, 7, 1), (2, 6, None, 1)]
    assert windows.tail_budget(left, "_sum", "k", "_hit", 1, 10).select("_n", "_sum").collect()[0] == (6, 9)
    page = windows.keyset_page(left, ["k"], None, 1).first()
    assert page["_n"] == 5 and page["has_more"]
    newest = windows.last_activity(left, right, "k", "k", "_r").orderBy("k").collect()
    assert [(r["_m"], r["last_activity"]) for r in newest] == [("m", 7), (None, 2)]
    edges = spark.createDataFrame([("t", "a:1", "b:1", "mine")], "edge_type string, from_key string, to_key string, _ok string")
    row = graphs.edge_contract(edges, spark.createDataFrame([("t", "a", "b")], "edge_type string, from_scheme string, to_scheme string")).first()
    assert row["legal"] and row["_ok"] == "mine"

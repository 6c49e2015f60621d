"""Graph loops end with the graph, never in silence before it."""

import pytest

from karst.operators import graphs

CHAIN = [(i, i + 1) for i in range(6)]


def test_rounds_have_no_limit_of_their_own(spark):
    edges = spark.createDataFrame(CHAIN, "from_key long, to_key long")
    root = spark.createDataFrame([(0,)], "node long")
    assert sorted((r["node"], r["distance"]) for r in graphs.shortest_chain(edges, root).collect()) == [(i, i) for i in range(7)]
    reads = spark.createDataFrame([(b, a) for a, b in CHAIN] + [(None, 0)], "job long, reads long")
    assert {(r["job"], r["wave"]) for r in graphs.waves(reads).collect()} == {(None, None), *((i, i + 1) for i in range(7))}
    numbers = iter(graphs.rounds_of(1, None))
    assert [next(numbers) for _ in range(2000)][-1] == 2000
    assert graphs.reach(edges, root, 2).count() == 3


def test_rounds_that_end_too_early_raise(spark):
    edges = spark.createDataFrame(CHAIN, "from_key long, to_key long")
    root = spark.createDataFrame([(0,)], "node long")
    certain = edges.selectExpr("*", "true AS certain")
    for run in (lambda: graphs.shortest_chain(edges, root, 3), lambda: graphs.reachable(certain, root, 3), lambda: graphs.waves(edges.selectExpr("to_key AS job", "from_key AS reads"), 3)):
        with pytest.raises(RuntimeError):
            run()


def test_loops_work_edges_out_once_and_broadcast_nothing(spark, monkeypatch):
    from karst.operators import graphs

    plans, plain = [], graphs.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(graphs, "cut", seen)
    edges = spark.range(1, 40).selectExpr("id AS job", "id div 2 AS reads")
    steps = edges.selectExpr("job AS from_key", "reads AS to_key")
    assert {r["node"]: r["distance"] for r in graphs.blast_radius(steps, spark.createDataFrame([(1,)], "node long")).collect()}[39] == 5
    assert {r["job"]: r["wave"] for r in graphs.waves(edges).collect()} == {0: 1, **{k: k.bit_length() + 1 for k in range(1, 40)}}
    cycle = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (4, 5), (4, 6), (6, 5), (7, None), (None, 5)], "job long, reads long")
    assert {r["job"]: r["wave"] for r in graphs.waves(cycle).collect()} == {1: None, 2: None, 3: None, 4: 3, 5: 1, 6: 2, 7: None, None: None}
    assert not any("BroadcastHashJoin" in p for p in plans)
    assert sum("Range (1, 40" in p for p in plans) == 2

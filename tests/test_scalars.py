"""Hand-worked cases of the public specifications, and properties of set and worst-of operators."""

import hashlib

from pyspark.sql import functions as F

from karst.functions import scalars as S
from karst.operators import aggregates as A
from karst.operators import filters as P
from karst.operators import graphs as G
from karst.operators import joins as J
from karst.operators import lifecycle as L
from karst.operators import planning as N
from karst.operators import sets


def one(spark, expr, *values):
    return spark.createDataFrame([values], [f"c{i}" for i in range(len(values))]).select(expr(*(F.col(f"c{i}") for i in range(len(values))))).first()[0]


def test_cvss3(spark):
    for vector, score in [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8), ("CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N", 6.1), ("CVSS:3.0/AV:L/AC:H/PR:L/UI:N/S:U/C:H/I:N/A:N", 4.7),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0), ("CVSS:3.1/AV:P/AC:H/PR:H/UI:R/S:U/C:N/I:N/A:N", 0.0), ("CVSS:3.1/AV:N", None), ("nonsense", None),
    ]:
        assert one(spark, S.cvss3_base, vector) == score, vector


def test_pep440_order(spark):
    versions = ["1.0.dev1", "1.0a1", "1.0a2", "1.0b1", "1.0rc1", "1.0", "1.0.post1", "1.1.dev1", "1.1", "1.10", "1!0.1"]
    df = spark.createDataFrame([(v,) for v in reversed(versions)], ["v"])
    assert [r[0] for r in df.orderBy(S.pep440_key(F.col("v"))).collect()] == versions
    assert one(spark, lambda a, b: S.pep440_key(a) == S.pep440_key(b), "1.0", "1.0.0")
    assert one(spark, S.pep440_key, "not a version") is None


def test_semver_order(spark):
    versions = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(versions)], ["v"])
    assert [r[0] for r in df.orderBy(S.semver_key(F.col("v"))).collect()] == versions


def test_blob_id(spark):
    assert one(spark, S.file_blob_id, "hello\n") == hashlib.sha1(b"blob 6\0hello\n").hexdigest() == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_nulls_are_neither_true_nor_false(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, flag boolean")
    assert {r[0] for r in df.where(P.not_true("flag")).collect()} == {2, 3}
    assert {r[0] for r in df.where(P.distinct_from("flag", True)).collect()} == {2, 3}


def test_delta_partitions(spark):
    base, head = spark.createDataFrame([(i,) for i in range(10)], "fingerprint int"), spark.createDataFrame([(i,) for i in range(6, 15)], "fingerprint int")
    state = {}
    for key, s in sets.scan_delta(base, head).collect():
        state.setdefault(s, set()).add(key)
    assert state["fixed"] | state["unchanged"] == set(range(10)) and state["new"] | state["unchanged"] == set(range(6, 15))


def test_worst_of_never_loosens(spark):
    order = ["pass", "warn", "fail"]
    df = spark.createDataFrame([("a", "pass"), ("a", "fail"), ("b", "warn"), ("b", "odd"), ("c", "pass")], "k string, verdict string")
    assert {r["k"]: r["verdict"] for r in A.worst_of(df, ["k"], "verdict", order).collect()} == {"a": "fail", "b": "odd", "c": "pass"}
    more = df.union(spark.createDataFrame([("c", "fail")], df.schema))
    assert {r["k"]: r["verdict"] for r in A.worst_of(more, ["k"], "verdict", order).collect()}["c"] == "fail"


def test_cycles_have_no_wave(spark):
    reads = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x")], "job string, reads string")
    assert {r["job"]: r["wave"] for r in G.waves(reads).collect()} == {"a": 1, "b": 2, "c": 3, "x": None, "y": None, "z": None}


def test_terms():
    assert P.parse_terms('one "two words" -three') == [("one", True), ("two words", True), ("three", False)]


def test_unreadable_fixes_come_last(spark):
    row = lambda *values: spark.createDataFrame([values], "i string, f array<string>").select(S.lowest_fix_above(F.col("i"), F.col("f"))).first()[0]
    assert row("3.0", ["???", "2.0"]) == "2.0" and row("1.0", ["???", "10.0", "9.0", None]) == "9.0"
    assert row("1.0", ["???"]) == "???" and row(None, ["2.0", "10.0"]) == "2.0" and row("1.0", []) is None


def signatures(spark, old, new):
    kind = "symbol string, params array<struct<name:string,kind:string,default:string,type:string>>"
    return N.signature_change(spark.createDataFrame([("f", old)], kind), spark.createDataFrame([("f", new)], kind))


def test_calls_bind_by_position(spark):
    a, issuer, subject = ("a", "pos", None, "int"), ("issuer", "pos", None, "str"), ("subject", "pos", "None", "str")
    facts = signatures(spark, [a, issuer], [a, subject, issuer])
    assert facts.first()["change"] == "params_changed"

    def safety(facts, positional, keywords=(), spread=False):
        calls = spark.createDataFrame([("f", positional, list(keywords), spread)], "symbol string, positional int, keywords array<string>, spread boolean")
        return N.call_safety(calls, facts).first()["safety"]

    assert safety(facts, 2) == "breaks" and safety(facts, 1, ["issuer"]) == "safe" and safety(facts, 1, ["issuer"], True) == "unknown"
    behind = signatures(spark, [a, issuer], [a, issuer, subject])
    assert behind.first()["change"] == "annotation_only" and safety(behind, 2) == "safe"
    assert safety(signatures(spark, [a, subject], [a, ("subject", "kw", "None", "str")]), 2) == "breaks"
    assert safety(signatures(spark, [a, subject], [a, ("subject", "pos", None, "str")]), 1) == "breaks"
    assert safety(signatures(spark, [a, subject], [a, ("subject", "pos", None, "str")]), 2) == "safe"
    assert safety(signatures(spark, [a, subject], [a, ("subject", "pos", "1", "str")]), 2) == "unknown"
    assert safety(signatures(spark, [("x", "posonly", None, "int")], [("y", "posonly", None, "int")]), 1) == "safe"
    assert safety(signatures(spark, [a, ("rest", "args", None, None)], [a]), 1) == "unknown"


def test_policy_of_its_time(spark):
    rows = spark.createDataFrame([(1, "x", 5), (2, "x", 1), (3, None, 5), (1, "x", 5), (4, "x", 9)], "id int, k string, at int")
    policy = spark.createDataFrame([("x", 3, 10), ("x", 6, 20), ("x", 6, 15)], "k string, valid_from int, days int")
    got = J.policy_asof(rows, policy, "at", ["k"], "days").select("id", "days").collect()
    assert sorted(map(tuple, got)) == [(1, 10), (1, 10), (2, None), (3, None), (4, 20)]
    assert J.policy_asof(rows, policy.limit(0), "at", ["k"], "days").where("days is not null").count() == 0


def test_either_key_cases(spark):
    left = spark.createDataFrame([(1, 10, 20), (2, 10, 10), (3, None, 99)], "id int, a int, b int")
    right = spark.createDataFrame([(7, 10), (8, 20), (9, None), (7, 10)], "own int, k int")
    got = J.either_key(left, right, "id", [("a", "k"), ("b", "k")], "own").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 7), (1, 8), (2, 7), (3, None)], key=str)


def test_routes_of_several_patterns(spark):
    alerts = spark.createDataFrame([(1, "High", "t"), (2, "Low", None), (3, None, "t")], "alert_id int, severity string, scan string")
    routes = spark.createDataFrame([("all", None, None), ("high", "High", None), ("both", "High", "t"), ("scan", None, "t")], "route string, want_severity string, want_scan string")
    got = {tuple(r) for r in L.route_alerts(alerts, routes, ["severity", "scan"]).collect()}
    assert got == {(1, "all"), (2, "all"), (3, "all"), (1, "high"), (1, "both"), (1, "scan"), (3, "scan")}
    assert L.route_alerts(alerts, routes.limit(0), ["severity", "scan"]).count() == 0

"""Readers parse each document once, and rows come from arrays that are there."""

import pytest
from pyspark.sql import functions as F

from karst.sources import documents as D
from karst.sources import manifests


@pytest.mark.parametrize("read", [D.sarif_findings, D.sarif_rules, D.scanner_vulns, D.scanner_packages, D.scan_scope, D.rule_signals, D.edge_documents])
def test_documents_are_parsed_once(spark, read):
    left, right = (spark.range(3).select(F.col("id").alias("doc"), F.col("id").cast("string").alias(c)) for c in ("a", "b"))
    docs = left.join(right, "doc").select("doc", F.concat("a", "b").alias("content"))
    plan = read(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_manifests_are_folded_once_for_their_rows(spark):
    docs = spark.range(3).select(F.col("id").alias("doc"), F.concat(F.lit("a=="), F.col("id")).alias("content"))
    for read in (manifests.requirement_list, manifests.project_table):
        rows = read(docs)[0]
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(split(") == 1


def test_empty_and_missing_arrays_have_no_rows(spark):
    made = spark.createDataFrame([(1, [None, "a"]), (2, []), (3, None), (4, ["b"])], "doc int, xs array<string>")
    assert sorted((r["doc"], r["n"], r["x"]) for r in D.each(made, "xs", "x", "doc", place="n").collect()) == [(1, 0, None), (1, 1, "a"), (4, 0, "b")]


def test_sizes_of_a_scan_are_joined_at_many_places(spark):
    from karst.sources import sinks

    rows = spark.range(1000).selectExpr("1 AS scan", "'t' AS tool", "'r' AS rule", "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        made = sinks.report_document(rows, "scan", "tool", "rule", ["id"], [], 100)
        assert "_salt" in made._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1].split("\n")[0]
        assert made.select(F.explode(F.from_json("content", "struct<runs: array<struct<results: array<struct<id: long>>>>>")["runs"][0]["results"])).count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

"""Queries of predicates, joins, aggregates, windows, orders and set operations over the domain views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..functions import scalars as S
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import joins as J
from ..operators import sets
from ..operators import windows as W
from .policy import Policy
from .registry import query

OPEN = ["Open", "In Progress"]
_OPEN = "is_deleted IS NOT TRUE AND status IN ('Open', 'In Progress') AND is_false_positive IS NOT TRUE AND is_risk_accepted IS NOT TRUE"

# ------------------------------------------------ predicates and projections

query("flt_not_true", "SELECT severity, count(*) AS n FROM findings WHERE is_false_positive IS NOT TRUE GROUP BY 1")(lambda v: v.findings.where(P.not_true("is_false_positive")).groupBy("severity").agg(F.count("*").alias("n")))
query("flt_distinct_from", "SELECT count(*) AS n, count(cve_id) AS with_cve FROM findings WHERE cve_id IS DISTINCT FROM 'CVE-7'")(lambda v: v.findings.where(P.distinct_from("cve_id", "CVE-7")).agg(F.count("*").alias("n"), F.count("cve_id").alias("with_cve")))
query("flt_live_rows", "SELECT (SELECT count(*) FROM findings WHERE is_deleted IS NOT TRUE) AS findings, (SELECT count(*) FROM repositories) AS repositories")(lambda v: P.live_rows(v.findings).agg(F.count("*").alias("findings")).join(P.live_rows(v.repositories).agg(F.count("*").alias("repositories")), F.lit(True)))


@query("flt_open_population", f"SELECT severity, status, count(*) AS n FROM findings WHERE {_OPEN} GROUP BY 1, 2")
def _(v):
    policy = Policy(v.policy)
    return P.open_population(v.findings, policy.values("open_statuses"), policy.switch("include_risk_accepted")).groupBy("severity", "status").agg(F.count("*").alias("n"))


query("flt_history_population", "SELECT status = 'Fixed' AS is_closed, is_deleted, count(*) AS n FROM findings GROUP BY 1, 2")(lambda v: P.history_population(v.findings, ["Fixed"]).groupBy("is_closed", "is_deleted").agg(F.count("*").alias("n")))
query("flt_unreported_counts", "SELECT count(*) AS total, count(*) FILTER (WHERE is_false_positive) AS is_false_positive_true, count(*) FILTER (WHERE is_false_positive IS NULL) AS is_false_positive_unreported, count(*) FILTER (WHERE is_deleted) AS is_deleted_true, count(*) FILTER (WHERE is_deleted IS NULL) AS is_deleted_unreported FROM findings")(lambda v: P.unreported_counts(v.findings, ["is_false_positive", "is_deleted"]))
query("flt_changed_set", "SELECT fingerprint, path FROM scan_head WHERE path IS NULL OR path IN (SELECT path FROM scan_scope)")(lambda v: P.changed_set(v.scan_head, v.scan_scope).select("fingerprint", "path"))
query("flt_closed_domain", "SELECT severity, count(*) AS n FROM findings WHERE severity NOT IN (SELECT severity FROM deadlines) GROUP BY 1")(lambda v: P.closed_domain(v.findings, "severity", v.deadlines))
query("flt_term_search", """
SELECT p_partkey, p_name FROM part p WHERE
 (contains(lower(p_name), 'large') OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND contains(lower(l_returnflag), 'large')))
 AND (contains(lower(p_name), 'r') OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND contains(lower(l_returnflag), 'r')))
 AND NOT (contains(lower(p_name), 'widget') OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND contains(lower(l_returnflag), 'widget')))
""")(lambda v: P.term_search(v.part.select("p_partkey", "p_name"), v.lineitem.withColumnRenamed("l_partkey", "p_partkey"), "p_partkey", "p_name", "l_returnflag", 'large "r" -widget'))
_SAID = "CASE p_size % 5 WHEN 0 THEN concat('a_b ', p_name) WHEN 1 THEN concat('axb ', p_name) WHEN 2 THEN concat('A_B', p_type) WHEN 3 THEN concat('100%_', p_type) END"
query("flt_topic_ilike", f"SELECT p_partkey FROM (SELECT p_partkey, p_type, {_SAID} AS said FROM part) WHERE contains(lower(said), 'a_b') OR contains(lower(p_type), 'a_b')")(lambda v: P.topic(v.part.selectExpr("p_partkey", "p_type", f"{_SAID} AS said"), ["said", "p_type"], "A_b").select("p_partkey"))
query("flt_expression_map", "SELECT finding_id FROM findings WHERE severity IN ('Critical', 'High') AND status = 'Open' AND score >= 0.5 AND cve_id IS DISTINCT FROM 'CVE-3'")(lambda v: P.expression_map(v.findings, {"severity": ["Critical", "High"], "status": "Open", "score": {"op": "ge", "value": 0.5}, "cve_id": {"op": "ne", "value": "CVE-3"}}).select("finding_id"))
query("flt_time_window", "SELECT count(*) AS n FROM findings WHERE first_detected >= TIMESTAMP '1999-01-01 00:00:00' - INTERVAL '900' DAY AND first_detected <= TIMESTAMP '1999-01-01 00:00:00'")(lambda v: P.time_window(v.findings, "first_detected", AS_OF, "900d").agg(F.count("*").alias("n")))
query("flt_ttl_live", f"SELECT finding_id FROM findings WHERE NOT coalesce(is_deleted, false) AND (package_id % 3 = 0 OR first_detected + INTERVAL '1' DAY * CAST(package_id % 3 * 1500 AS INT) > {AS_OF})")(lambda v: P.ttl_live(v.findings.withColumn("ttl", F.expr("CASE WHEN package_id % 3 <> 0 THEN CAST(package_id % 3 * 1500 AS INT) END")), "first_detected", "ttl", "is_deleted", AS_OF).select("finding_id"))
query("flt_tenant_scope", "SELECT finding_id, repository_id FROM findings WHERE repository_id IN (SELECT repository_id FROM repositories WHERE owner = 'owner3')")(lambda v: P.tenant_scope(v.findings, "repository_id", v.repositories.where("owner = 'owner3'")).select("finding_id", "repository_id"))
query("prj_label", "SELECT finding_id, concat_ws(' on ', cve_id, path) AS label FROM findings")(lambda v: v.findings.select("finding_id", P.label("cve_id", "path").alias("label")))
query("prj_keep_null", "SELECT asset_id, team, count(*) FILTER (WHERE team IS NULL) OVER () AS not_recorded FROM assets")(lambda v: v.assets.select("asset_id", "team").join(v.assets.agg(F.count_if(F.col("team").isNull()).alias("not_recorded")), F.lit(True)))
query("prj_drop_unusable", "SELECT asset_id, environment, is_exposed FROM assets WHERE team IS NOT NULL")(lambda v: P.drop_unusable(v.assets.where("team IS NOT NULL"), ["team", "is_deleted"]))
query("prj_compact", "SELECT from_key, to_key FROM edges WHERE edge_type = 'deployed_as'")(lambda v: P.compact(v.edges.where("edge_type = 'deployed_as'"), ["from_key", "to_key"]))
query("prj_redact_rows", "SELECT finding_id, CASE WHEN scan_type IN ('type3') THEN '[REDACTED]' ELSE path END AS path, CASE WHEN scan_type IN ('type3') THEN '[REDACTED]' ELSE cve_id END AS cve_id FROM findings")(lambda v: P.redact_rows(v.findings, "scan_type", ["type3"], ["path", "cve_id"]).select("finding_id", "path", "cve_id"))

# ------------------------------------------------ joins

query("join_enrich_coverage", "SELECT count(*) AS total, count(a.asset_id) AS joined, count(*) FILTER (WHERE a.asset_id IS NULL) AS unmatched FROM findings f LEFT JOIN assets a ON f.asset_id = a.asset_id AND a.is_deleted IS NOT TRUE")(lambda v: J.enrich_coverage(v.findings, v.assets, "asset_id", P.not_true("is_deleted")))


@query("join_trust_report", """
SELECT 'findings.asset_id' AS join_name, count(*) AS keys, count(*) FILTER (WHERE a.asset_id IS NULL) AS orphans, round(100.0 * count(*) FILTER (WHERE a.asset_id IS NULL) / count(*), 2) AS orphan_pct,
  CASE WHEN 1.0 * count(*) FILTER (WHERE a.asset_id IS NULL) / count(*) <= 0.01 THEN 'RELY' WHEN 1.0 * count(*) FILTER (WHERE a.asset_id IS NULL) / count(*) <= 0.2 THEN 'DEGRADED' ELSE 'NORELY' END AS trust
FROM (SELECT DISTINCT asset_id FROM findings) f LEFT JOIN assets a ON f.asset_id = a.asset_id
UNION ALL
SELECT 'findings.repository_id', count(*), count(*) FILTER (WHERE r.repository_id IS NULL), round(100.0 * count(*) FILTER (WHERE r.repository_id IS NULL) / count(*), 2),
  CASE WHEN 1.0 * count(*) FILTER (WHERE r.repository_id IS NULL) / count(*) <= 0.01 THEN 'RELY' WHEN 1.0 * count(*) FILTER (WHERE r.repository_id IS NULL) / count(*) <= 0.2 THEN 'DEGRADED' ELSE 'NORELY' END
FROM (SELECT DISTINCT repository_id FROM findings) f LEFT JOIN repositories r ON f.repository_id = r.repository_id""")
def _(v):
    return J.trust_report(v.findings, v.assets, "asset_id", "findings.asset_id").union(J.trust_report(v.findings, v.repositories, "repository_id", "findings.repository_id"))


query("join_fanout_check", "SELECT (SELECT count(*) FROM packages) AS rows_before, (SELECT count(*) FROM packages p JOIN findings f ON p.package_id = f.package_id) AS rows_after, (SELECT count(*) FROM packages p WHERE (SELECT count(*) FROM findings f WHERE f.package_id = p.package_id) > 1) AS keys_multiplied, true AS multiplies")(lambda v: J.fanout_check(v.packages, v.findings, "package_id"))
query("join_governance_two_path", "SELECT f.finding_id, coalesce(r.team, o.team) AS team, coalesce(r.environment, o.environment) AS environment FROM findings f LEFT JOIN (SELECT asset_id + 1 AS package_id, team, environment FROM assets) r ON f.package_id = r.package_id LEFT JOIN assets o ON f.asset_id = o.asset_id")(lambda v: J.governance_two_path(v.findings.select("finding_id", "package_id", "asset_id"), v.assets.selectExpr("asset_id + 1 AS package_id", "team", "environment"), v.assets, "package_id", "asset_id", ["team", "environment"]).select("finding_id", "team", "environment"))
query("join_owner_with_source", "SELECT coalesce(a.team, r.owner) AS owner, CASE WHEN a.team IS NOT NULL THEN 'declared' WHEN r.owner IS NOT NULL THEN 'repository' ELSE 'none' END AS owner_source, count(*) AS n FROM findings f LEFT JOIN assets a ON f.asset_id = a.asset_id LEFT JOIN repositories r ON f.repository_id = r.repository_id GROUP BY 1, 2")(lambda v: J.owner_with_source(v.findings, v.assets, v.repositories).groupBy("owner", "owner_source").agg(F.count("*").alias("n")))
query("join_either_key", "SELECT DISTINCT f.finding_id, a.asset_id AS running_id FROM findings f LEFT JOIN assets a ON f.asset_id = a.asset_id OR f.package_id = a.asset_id")(lambda v: J.either_key(v.findings.dropDuplicates(["finding_id"]), v.assets.withColumnRenamed("asset_id", "running_id").withColumn("own", F.col("running_id")), "finding_id", [("asset_id", "own"), ("package_id", "own")], "running_id"))
query("join_semi_running", "SELECT finding_id FROM findings f WHERE EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = f.asset_id AND a.environment = 'prod')")(lambda v: J.semi_running(v.findings, v.assets.where("environment = 'prod'"), "asset_id").select("finding_id"))
query("join_anti_orphans", "SELECT finding_id, asset_id FROM findings f WHERE asset_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = f.asset_id)")(lambda v: J.anti_orphans(v.findings, v.assets, "asset_id").select("finding_id", "asset_id"))
query("join_fallback_key", "SELECT s.s_suppkey, coalesce(a.v, b.v) AS found FROM supplier s LEFT JOIN (SELECT package_id, min(name) AS v FROM packages WHERE is_deleted GROUP BY 1) a ON s.s_suppkey = a.package_id LEFT JOIN (SELECT CAST(package_id % 50 AS BIGINT) AS k, min(name) AS v FROM packages WHERE is_deleted GROUP BY 1) b ON s.s_nationkey = b.k")(lambda v: J.fallback_key(v.supplier.selectExpr("s_suppkey", "s_suppkey AS a", "CAST(s_nationkey AS BIGINT) AS b"), v.packages.where("is_deleted").selectExpr("package_id AS a", "package_id % 50 AS b", "name AS found"), "a", "b", "found").select("s_suppkey", "found"))
query("join_nth_occurrence", """
SELECT coalesce(a.path, b.path) AS path, coalesce(a.n, b.n) AS n, a.fingerprint AS base_id, b.fingerprint AS head_id
FROM (SELECT path, fingerprint, row_number() OVER (PARTITION BY path ORDER BY fingerprint) AS n FROM scan_base) a
FULL JOIN (SELECT path, fingerprint, row_number() OVER (PARTITION BY path ORDER BY fingerprint) AS n FROM scan_head) b ON a.path = b.path AND a.n = b.n""")(lambda v: J.nth_occurrence(v.scan_base.selectExpr("path", "fingerprint AS base_id"), v.scan_head.selectExpr("path", "fingerprint AS head_id"), ["path"], ["base_id"], ["head_id"]))
_COVERED = "SELECT DISTINCT concat('f', CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS VARCHAR(20)), '.py') AS covered_path FROM part WHERE p_size > 20"
query("join_path_suffix", f"SELECT c.path, x.covered_path FROM (SELECT DISTINCT path FROM scan_head) c LEFT JOIN ({_COVERED}) x ON x.covered_path = split_part(c.path, '/', 2)")(lambda v: J.path_suffix(v.scan_head, v.part.where("p_size > 20").selectExpr("concat('f', CAST(floor(p_partkey / 5) AS BIGINT), '.py') AS covered_path").distinct()))
query("join_line_range", "SELECT p.p_partkey AS id, r.s_suppkey AS span FROM part p JOIN supplier r ON p.p_partkey % 10 = r.s_suppkey % 10 AND p.p_size * 10 BETWEEN r.s_suppkey * 3 AND r.s_suppkey * 3 + 90")(lambda v: J.line_range(v.part.selectExpr("p_partkey AS id", "p_partkey % 10 AS f", "p_size * 10 AS line"), v.supplier.selectExpr("s_suppkey AS span", "s_suppkey % 10 AS f", "s_suppkey * 3 AS a", "s_suppkey * 3 + 90 AS z"), "f", "line", "a", "z").select("id", "span"))
query("join_policy_asof", """
SELECT f.finding_id, (SELECT max_by(d.days, d.valid_from) FROM (SELECT severity, days, TIMESTAMP '1992-01-01 00:00:00' AS valid_from FROM deadlines UNION ALL SELECT severity, days * 2, TIMESTAMP '1995-06-17 00:00:00' FROM deadlines) d WHERE d.severity = f.severity AND d.valid_from <= f.first_detected) AS days
FROM findings f""")(lambda v: J.policy_asof(v.findings.select("finding_id", "severity", "first_detected"), v.deadlines.selectExpr("severity", "days", "TIMESTAMP '1992-01-01 00:00:00' AS valid_from").union(v.deadlines.selectExpr("severity", "days * 2", "TIMESTAMP '1995-06-17 00:00:00'")), "first_detected", ["severity"], "days").select("finding_id", "days"))
query("join_precedence", "SELECT asset_id, team, origin FROM (SELECT asset_id, team, 'scoped' AS origin FROM assets WHERE environment = 'prod' UNION ALL SELECT s_suppkey, 'general', 'tenant' FROM supplier WHERE s_suppkey NOT IN (SELECT asset_id FROM assets WHERE environment = 'prod'))")(lambda v: J.precedence(v.assets.where("environment = 'prod'").select("asset_id", "team"), v.supplier.selectExpr("s_suppkey AS asset_id", "'general' AS team"), "asset_id"))
query("join_reference_first", "SELECT f.severity, d.days, count(*) AS n FROM findings f JOIN deadlines d ON f.severity = d.severity GROUP BY 1, 2")(lambda v: J.reference_first(v.findings, v.deadlines, "severity").groupBy("severity", "days").agg(F.count("*").alias("n")))
query("join_cve_intel", """
SELECT item_id, cve_id, s AS score, s IS NOT NULL AS known, total, pos, total > 5 AS truncated FROM (
 SELECT item_id, cve_id, s, count(*) OVER (PARTITION BY item_id) AS total, row_number() OVER (PARTITION BY item_id ORDER BY s DESC NULLS LAST, cve_id) AS pos
 FROM (SELECT DISTINCT asset_id AS item_id, cve_id FROM findings WHERE cve_id IS NOT NULL) i
 LEFT JOIN (SELECT concat('CVE-', CAST(p_partkey AS VARCHAR(20))) AS c, p_size AS s FROM part WHERE p_partkey < 500 AND p_partkey % 3 > 0) r ON i.cve_id = r.c) WHERE pos <= 5""")(lambda v: J.cve_intel(v.findings.withColumnRenamed("asset_id", "item_id"), v.part.where("p_partkey < 500 AND p_partkey % 3 > 0").selectExpr("concat('CVE-', CAST(p_partkey AS STRING)) AS cve_id", "p_size AS score"), "cve_id", "score", 5))
query("join_full_diff", "SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN a.fingerprint IS NULL THEN 'added' WHEN b.fingerprint IS NULL THEN 'removed' WHEN a.path IS NOT DISTINCT FROM b.path THEN 'same' ELSE 'changed' END AS state FROM scan_base a FULL JOIN scan_head b ON a.fingerprint = b.fingerprint")(lambda v: J.full_diff(v.scan_base, v.scan_head, "fingerprint", ["path"]).select("fingerprint", "state"))

# ------------------------------------------------ aggregates

query("agg_named_measures", "SELECT severity, count(*) AS findings, count(DISTINCT cve_id) AS distinct_cves, count(*) FILTER (WHERE cve_id IS NULL) AS without_cve FROM findings GROUP BY 1")(lambda v: A.named_measures(v.findings, ["severity"]))
query("agg_filtered_counts", "SELECT scan_type, count(*) FILTER (WHERE status = 'Open') AS open, count(*) FILTER (WHERE is_false_positive) AS dismissed, count(*) FILTER (WHERE score > 0.5) AS scored FROM findings GROUP BY 1")(lambda v: A.filtered_counts(v.findings, ["scan_type"], {"open": F.col("status") == "Open", "dismissed": F.col("is_false_positive"), "scored": F.col("score") > 0.5}))
query("agg_share_total", "SELECT severity, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (), 2) AS share_pct FROM (SELECT severity, count(*) AS n FROM findings GROUP BY 1)")(lambda v: A.share_total(v.findings, ["severity"]))
query("agg_safe_ratio", "SELECT severity, round(100.0 * count(*) FILTER (WHERE status = 'Fixed') / nullif(count(*) FILTER (WHERE status <> 'In Progress'), 0), 1) AS pct FROM findings GROUP BY 1")(lambda v: v.findings.groupBy("severity").agg(A.safe_ratio(F.count_if(F.col("status") == "Fixed"), F.count_if(F.col("status") != "In Progress")).alias("pct")))
query("agg_unknown_bucket", "SELECT coalesce(team, 'Unknown') AS team, count(*) AS n FROM assets GROUP BY 1")(lambda v: A.unknown_bucket(v.assets, "team"))
query("agg_mttr", "SELECT severity, count(*) AS fixed, round(avg(d), 2) AS mean_days, round(quantile_cont(d, 0.5), 2) AS median_days, round(quantile_cont(d, 0.9), 2) AS p90_days FROM (SELECT severity, CAST(date_diff('day', first_detected, fixed_at) AS DOUBLE) AS d FROM findings WHERE status = 'Fixed') GROUP BY 1")(lambda v: A.mttr(v.findings, ["severity"]))
query("agg_monthly_flow", """
SELECT month, CAST(new AS BIGINT) AS new, CAST(fixed AS BIGINT) AS fixed, CAST(new - fixed AS BIGINT) AS net, CAST(sum(new - fixed) OVER (ORDER BY month) AS BIGINT) AS backlog FROM (
 SELECT month, sum(a) AS new, sum(b) AS fixed FROM (SELECT CAST(date_trunc('month', first_detected) AS DATE) AS month, 1 AS a, 0 AS b FROM findings UNION ALL SELECT CAST(date_trunc('month', fixed_at) AS DATE), 0, 1 FROM findings WHERE fixed_at IS NOT NULL) GROUP BY 1)""")(lambda v: A.monthly_flow(v.findings))
query("agg_severity_split", "SELECT CASE WHEN coalesce(rnk, 0) = 0 THEN 'unclassified' WHEN rnk >= 2 THEN 'at_or_above' ELSE 'below' END AS box, count(*) AS n FROM findings f LEFT JOIN severity_rank r ON f.severity = r.severity GROUP BY 1")(lambda v: A.severity_split(v.findings, v.severity_rank, 2))
query("agg_grouping_total", "SELECT coalesce(scan_type, 'all') AS scan_type, count(DISTINCT cve_id) AS n FROM findings GROUP BY GROUPING SETS ((scan_type), ())")(lambda v: A.grouping_total(v.findings, "scan_type", "cve_id"))
query("agg_cube_rollup", "SELECT severity, status, count(*) AS n, CAST(grouping(severity) * 2 + grouping(status) AS BIGINT) AS level FROM findings GROUP BY CUBE (severity, status)")(lambda v: A.cube(v.findings, "severity", "status"))
query("agg_pivot_two_dims", "SELECT severity, count(*) FILTER (WHERE status = 'Open') AS \"Open\", count(*) FILTER (WHERE status = 'Fixed') AS \"Fixed\" FROM findings GROUP BY 1")(lambda v: A.pivot(v.findings, "severity", "status", ["Open", "Fixed"]))
query("agg_alias_merge", """
SELECT package_id, cve_id, max_by(finding_id, (rnk, s, finding_id)) AS finding_id, CAST(count(DISTINCT finding_id) AS BIGINT) AS ids, min(finding_id) AS first_id
FROM (SELECT f.*, r.rnk, coalesce(round(score, 4), -1) AS s FROM findings f JOIN severity_rank r ON f.severity = r.severity WHERE cve_id IS NOT NULL) GROUP BY 1, 2""")(lambda v: A.alias_merge(v.findings.where("cve_id IS NOT NULL").join(v.severity_rank, "severity").withColumn("s", F.round("score", 4)), ["package_id", "cve_id"], "rnk", "s", "finding_id", "path").select("package_id", "cve_id", "finding_id", F.size("ids").cast("long").alias("ids"), F.col("ids")[0].alias("first_id")))
query("agg_fix_targets", "SELECT ecosystem, count(*) AS flaws, count(*) FILTER (WHERE fix IS NULL) AS no_fix, max(fix) AS highest_fix FROM (SELECT ecosystem, CASE WHEN package_id % 4 > 0 THEN lpad(CAST(package_id % 90 AS VARCHAR(20)), 3, '0') END AS fix FROM packages) GROUP BY 1")(lambda v: A.fix_targets(v.packages.withColumn("fix", F.expr("CASE WHEN package_id % 4 > 0 THEN lpad(CAST(package_id % 90 AS STRING), 3, '0') END")), ["ecosystem"], "name", "fix", S.version_key(F.col("fix"))).drop("first_ids"))
query("agg_fix_candidates", "SELECT t.ecosystem, t.fix, (SELECT count(*) FROM packages p WHERE p.ecosystem = t.ecosystem AND p.package_id % 4 > 0 AND p.package_id % 90 <= t.fix) AS cleared, (SELECT count(*) FROM packages p WHERE p.ecosystem = t.ecosystem AND NOT (p.package_id % 4 > 0 AND p.package_id % 90 <= t.fix)) AS left_open FROM (SELECT DISTINCT ecosystem, package_id % 90 AS fix FROM packages WHERE package_id % 4 > 0) t")(lambda v: A.fix_candidates(v.packages.withColumn("fix", F.expr("CASE WHEN package_id % 4 > 0 THEN package_id % 90 END")).withColumn("key", F.col("fix")), ["ecosystem"], "fix", "key"))
query("agg_plan_groups", "SELECT package_id % 2 = 0 AS fixable, CASE WHEN package_id % 2 = 0 THEN ecosystem ELSE name END AS plan_group, count(*) AS n, count(DISTINCT version) AS edits FROM packages GROUP BY 1, 2")(lambda v: A.plan_groups(v.packages.withColumn("fixable", F.expr("package_id % 2 = 0")), "fixable", F.expr("CASE WHEN package_id % 2 = 0 THEN ecosystem ELSE name END"), "version"))
query("agg_edge_merge", "SELECT concat('image:', CAST(l_suppkey AS VARCHAR(20))) AS from_key, concat('pkg:', CAST(l_partkey AS VARCHAR(20))) AS to_key, 'contains' AS edge_type, CASE max(l_linenumber % 3) WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS sightings FROM lineitem GROUP BY 1, 2")(lambda v: A.edge_merge(v.lineitem.selectExpr("concat('image:', CAST(l_suppkey AS STRING)) AS from_key", "concat('pkg:', CAST(l_partkey AS STRING)) AS to_key", "'contains' AS edge_type", "CASE l_linenumber % 3 WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence"), {"low": 0, "medium": 1, "high": 2}))
query("agg_worst_of", "SELECT repository_id, CASE max(CASE severity WHEN 'Critical' THEN 3 WHEN 'High' THEN 2 WHEN 'Medium' THEN 1 ELSE 0 END) WHEN 3 THEN 'Critical' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' ELSE 'Low' END AS verdict, count(*) AS votes FROM findings WHERE severity <> 'Unknown' GROUP BY 1")(lambda v: A.worst_of(v.findings.where("severity <> 'Unknown'"), ["repository_id"], "severity", ["Low", "Medium", "High", "Critical"]))
query("agg_tree_answers", "SELECT package_id, CASE WHEN bool_or(a = 'imported') THEN 'imported' WHEN bool_or(a = 'unreadable') THEN 'unavailable' WHEN bool_or(a = 'inconclusive') THEN 'inconclusive' ELSE 'not_imported' END AS answer, count(*) AS trees FROM (SELECT package_id, CASE repository_id % 9 WHEN 0 THEN 'imported' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'inconclusive' ELSE 'not_imported' END AS a FROM findings) GROUP BY 1")(lambda v: A.tree_answers(v.findings.withColumn("a", F.expr("CASE repository_id % 9 WHEN 0 THEN 'imported' WHEN 1 THEN 'unreadable' WHEN 2 THEN 'inconclusive' ELSE 'not_imported' END")), ["package_id"], "a"))
query("agg_entry_clears", "SELECT package_id, count(*) FILTER (WHERE status <> 'Fixed') AS open, count(*) FILTER (WHERE status = 'Fixed') AS already_closed, count(*) FILTER (WHERE is_deleted) AS gone FROM findings GROUP BY 1")(lambda v: A.filtered_counts(v.findings, ["package_id"], {"open": F.col("status") != "Fixed", "already_closed": F.col("status") == "Fixed", "gone": F.col("is_deleted")}))
query("agg_default_owner", """
SELECT p.package_id, coalesce((SELECT min(team) FROM (SELECT team, n, max(n) OVER () AS m FROM (SELECT a.team, count(*) AS n FROM findings f JOIN assets a ON f.asset_id = a.asset_id WHERE f.package_id = p.package_id AND f.status <> 'Fixed' AND a.team IS NOT NULL GROUP BY 1)) WHERE n = m), 'admin') AS owner
FROM (SELECT DISTINCT package_id FROM findings WHERE status <> 'Fixed') p""")(lambda v: A.default_owner(v.findings.where("status <> 'Fixed'").join(v.assets.select("asset_id", "team"), "asset_id", "left"), "package_id", "team"))
query("agg_batch_rollup", "SELECT count(DISTINCT source) AS sources, count(*) AS runs, count(*) FILTER (WHERE status = 'success') AS succeeded, count(*) FILTER (WHERE status = 'failure') AS failed FROM runs")(lambda v: v.runs.agg(F.count_distinct("source").alias("sources"), F.count("*").alias("runs"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failure").alias("failed")))
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, min(CAST({c} AS VARCHAR)) AS lowest, max(CAST({c} AS VARCHAR)) AS highest FROM assets" for c in ("asset_id", "team", "environment"))
query("agg_table_profile", _PROFILE)(lambda v: A.table_profile(v.assets, ["asset_id", "team", "environment"]))
query("agg_fill_and_shape", f"SELECT column_name, n_rows - n_null AS filled, CASE WHEN n_rows = n_null THEN 'empty' WHEN n_distinct = 1 THEN 'constant' WHEN n_distinct = n_rows - n_null THEN 'key' WHEN n_distinct <= 25 THEN 'enum' ELSE 'high_cardinality' END AS shape FROM ({_PROFILE})")(lambda v: A.fill_and_shape(A.table_profile(v.assets, ["asset_id", "team", "environment"])))
_MEMBERS = """SELECT concat('u', CAST(c_custkey AS VARCHAR(20))) AS user, concat('g', CAST(c_nationkey AS VARCHAR(20))) AS grp FROM customer WHERE c_custkey % 5 > 0 UNION ALL SELECT concat('g', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))) FROM nation
    UNION ALL SELECT concat('r', CAST(r_regionkey AS VARCHAR(20))), 'all' FROM region WHERE r_regionkey < 4 UNION ALL SELECT 'all', 'r1'"""
_GRANTS = """SELECT concat('g', CAST(n_nationkey AS VARCHAR(20))) AS principal, 'reader' AS role FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'r1', 'part_admin' UNION ALL SELECT 'all', 'viewer' UNION ALL SELECT 'all', 'ghost'
    UNION ALL SELECT concat('u', CAST(c_custkey AS VARCHAR(20))), CASE WHEN c_custkey % 50 = 0 THEN 'root' ELSE 'editor' END FROM customer WHERE c_custkey % 50 = 0 OR c_custkey % 7 = 0"""
_ROLES = "SELECT * FROM (VALUES ('viewer', 'part:read'), ('reader', 'order:read'), ('part_admin', 'part:*'), ('editor', 'order:write'), ('root', '*'), ('ghost', 'gone:*'), ('ghost', 'order')) AS t(role, permission)"
_CATALOG = "SELECT * FROM (VALUES ('part:read'), ('part:write'), ('part:sell'), ('order:read'), ('order:write'), ('partner:read')) AS t(permission)"
query("agg_permission_union", f"""
WITH RECURSIVE m AS ({_MEMBERS}), i AS (SELECT user, grp FROM m UNION SELECT i.user, m.grp FROM i JOIN m ON m.user = i.grp), g AS ({_GRANTS}),
h AS (SELECT principal AS user, role FROM g WHERE principal NOT IN (SELECT grp FROM m) UNION SELECT i.user, g.role FROM i JOIN g ON g.principal = i.grp WHERE i.user NOT IN (SELECT grp FROM m))
SELECT DISTINCT h.user, c.permission FROM h JOIN ({_ROLES}) r ON r.role = h.role JOIN ({_CATALOG}) c ON r.permission = '*' OR r.permission = c.permission OR (r.permission LIKE '%:*' AND split_part(c.permission, ':', 1) = split_part(r.permission, ':', 1))
""")(lambda v: A.permission_union(*(v.spark.sql(t.replace("FROM customer", "FROM {customer}").replace("FROM nation", "FROM {nation}").replace("FROM region", "FROM {region}"), **{n: v.table(n) for n in ("customer", "nation", "region") if f"FROM {n}" in t}) for t in (_GRANTS, _MEMBERS, _ROLES, _CATALOG))))
query("agg_sighting_rollup", "SELECT package_id, asset_id, min(first_detected) AS first_seen, max(first_detected) AS last_seen, count(*) AS times_seen, count(DISTINCT scan_type) AS reporters FROM findings GROUP BY 1, 2")(lambda v: A.sighting_rollup(v.findings, ["package_id", "asset_id"], "first_detected", "scan_type"))
query("agg_cve_across", f"SELECT cve_id, count(*) FILTER (WHERE {_OPEN}) AS open, count(*) FILTER (WHERE is_false_positive OR is_risk_accepted) AS set_aside, count(DISTINCT package_id) AS entries, count(DISTINCT asset_id) AS places FROM findings WHERE cve_id IS NOT NULL GROUP BY 1")(lambda v: v.findings.where("cve_id IS NOT NULL").groupBy("cve_id").agg(F.expr(f"count_if({_OPEN})").alias("open"), F.expr("count_if(coalesce(is_false_positive OR is_risk_accepted, false))").alias("set_aside"), F.count_distinct("package_id").alias("entries"), F.count_distinct("asset_id").alias("places")))
query("agg_inbox_counters", "SELECT 'all' AS counter, '' AS part_of, count(*) AS n FROM findings UNION ALL SELECT 'open', 'all', count(*) FILTER (WHERE status = 'Open') FROM findings UNION ALL SELECT 'critical', 'open', count(*) FILTER (WHERE status = 'Open' AND severity = 'Critical') FROM findings")(lambda v: A.counters(v.findings, {"all": (F.lit(True), ""), "open": (F.col("status") == "Open", "all"), "critical": ((F.col("status") == "Open") & (F.col("severity") == "Critical"), "open")}))
query("agg_audit_stats", "SELECT action, ok, count(*) AS n, count(DISTINCT user_id) AS users FROM audit GROUP BY 1, 2")(lambda v: v.audit.groupBy("action", "ok").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))
query("agg_widget_series", "SELECT CAST(severity AS VARCHAR) AS x, count(*) AS y FROM findings GROUP BY 1")(lambda v: A.widget_series(v.findings, "severity", F.count("*")))
query("agg_run_status", "SELECT user_id, CASE WHEN bool_and(ok) THEN 'success' WHEN NOT bool_or(ok) THEN 'failed' WHEN bool_or(ok) FILTER (WHERE p = 'data') AND NOT coalesce(bool_or(ok) FILTER (WHERE p <> 'data'), false) THEN 'data_only' ELSE 'partial' END AS run_status FROM (SELECT user_id, ok, CASE WHEN event_id % 3 = 0 THEN 'data' ELSE 'page' END AS p FROM audit) GROUP BY 1")(lambda v: A.run_status(v.audit.withColumn("p", F.expr("CASE WHEN event_id % 3 = 0 THEN 'data' ELSE 'page' END")), ["user_id"], "p", "ok"))

# ------------------------------------------------ windows and orders

query("win_top_n_per_class", "SELECT severity, finding_id, pos FROM (SELECT severity, finding_id, row_number() OVER (PARTITION BY severity ORDER BY score DESC, finding_id) AS pos FROM findings) WHERE pos <= 10")(lambda v: W.top_n_per_class(v.findings, "severity", [F.desc("score"), F.col("finding_id")], 10).select("severity", "finding_id", "pos"))
query("win_top_n_ties", "SELECT ecosystem, package_id, pos FROM (SELECT ecosystem, package_id, rank() OVER (PARTITION BY ecosystem ORDER BY package_id % 40 DESC) AS pos FROM packages) WHERE pos <= 5")(lambda v: W.top_n_ties(v.packages.withColumn("s", F.expr("package_id % 40")), "ecosystem", "s", 5).select("ecosystem", "package_id", "pos"))
query("win_capped_total", "SELECT severity, finding_id, pos, total FROM (SELECT severity, finding_id, row_number() OVER (PARTITION BY severity ORDER BY finding_id) AS pos, count(*) OVER (PARTITION BY severity) AS total FROM findings) WHERE pos <= 7")(lambda v: W.capped_total(v.findings, "severity", [F.col("finding_id")], 7).select("severity", "finding_id", "pos", "total"))
query("win_occurrence_ordinal", "SELECT fingerprint, path, row_number() OVER (PARTITION BY path, rule ORDER BY fingerprint) - 1 AS ordinal FROM scan_head")(lambda v: W.occurrence_ordinal(v.scan_head, ["path", "rule"], ["fingerprint"]).select("fingerprint", "path", "ordinal"))
query("win_latest_version", "SELECT source, event_id, status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS r FROM runs) WHERE r = 1")(lambda v: W.latest_version(v.runs, ["source"], [F.col("ts"), F.col("event_id")]).select("source", "event_id", "status"))
query("win_tightest_deadline", """
SELECT event_id, cycle, min(due) OVER (PARTITION BY user_id, cycle ORDER BY ts, event_id) AS in_force FROM (
 SELECT event_id, user_id, ts, value AS due, CAST(sum(CASE WHEN action = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS cycle FROM (SELECT a.*, e.value FROM audit a JOIN events e ON a.event_id = e.event_id))""")(lambda v: W.tightest_deadline(v.audit.join(v.events.selectExpr("event_id", "value AS due"), "event_id").withColumn("again", F.col("action") == "signup"), "user_id", ["ts", "event_id"], "due", "again").select("event_id", "cycle", "in_force"))
_ISLANDS = "SELECT *, sum(c) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN lag({state}) OVER (PARTITION BY {key} ORDER BY ts, event_id) IS NOT DISTINCT FROM {state} THEN 0 ELSE 1 END AS c FROM {table})"
query("win_failure_streaks", "SELECT source, first_ts, last_ts, length, island = m AS current FROM (SELECT *, max(island) OVER (PARTITION BY source) AS m FROM (SELECT source, island, min(status) AS s, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS length FROM (" + _ISLANDS.format(key="source", state="status", table="runs") + ") GROUP BY 1, 2)) WHERE s = 'failure'")(lambda v: W.failure_streaks(v.runs, "source", "ts", "event_id"))
query("win_fold_repeats", "SELECT user_id, min(action) AS action, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS times FROM (" + _ISLANDS.format(key="user_id", state="action", table="audit") + ") GROUP BY user_id, island")(lambda v: W.fold_repeats(v.audit, "user_id", ["ts", "event_id"], "action", "ts"))
query("win_state_transition", "SELECT source, event_id, status, previous FROM (SELECT *, lag(status) OVER w AS previous, row_number() OVER w AS r FROM runs WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)) WHERE r = 1 OR status IS DISTINCT FROM previous")(lambda v: W.state_transition(v.runs, "source", ["ts", "event_id"], "status").select("source", "event_id", "status", "previous"))
query("win_reopened", "SELECT source, event_id FROM (SELECT *, lag(status) OVER (PARTITION BY source ORDER BY ts, event_id) AS p FROM runs) WHERE p = 'success' AND status <> 'success'")(lambda v: W.reopened(v.runs, "source", ["ts", "event_id"], "status", "success").select("source", "event_id"))
query("win_carry_block_state", """
SELECT event_id, coalesce(sum(b) OVER (PARTITION BY user_id ORDER BY event_id), 0) > coalesce(sum(e) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_block
FROM (SELECT event_id, user_id, CASE WHEN action = 'click' THEN 1 ELSE 0 END AS b, CASE WHEN action = 'purchase' THEN 1 ELSE 0 END AS e FROM audit)""")(lambda v: W.carry_block_state(v.audit, "user_id", "event_id", F.col("action") == "click", F.col("action") == "purchase").select("event_id", "in_block"))
query("win_tail_budget", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE n <= 4 AND s <= 900")(lambda v: W.tail_budget(v.conversations, "conv_id", "turn", "text", 4, 900).select("conv_id", "turn"))
query("win_trend_delta", """
SELECT severity, month, n, previous, CASE WHEN n > previous THEN 'up' WHEN n < previous THEN 'down' WHEN n = previous THEN 'flat' END AS direction, round(100.0 * (n - previous) / nullif(previous, 0), 1) AS pct FROM (
 SELECT severity, month, n, lag(n) OVER (PARTITION BY severity ORDER BY month) AS previous FROM (SELECT severity, CAST(date_trunc('month', first_detected) AS DATE) AS month, count(*) AS n FROM findings GROUP BY 1, 2))""")(lambda v: W.trend_delta(v.findings.groupBy("severity", F.date_trunc("month", "first_detected").cast("date").alias("month")).agg(F.count("*").alias("n")), "severity", "month", "n"))
query("win_ntile_distribution", "SELECT package_id, round(percent_rank() OVER (PARTITION BY ecosystem ORDER BY package_id % 97), 4) AS pct_rank, ntile(4) OVER (PARTITION BY ecosystem ORDER BY package_id % 97, package_id) AS quartile FROM packages")(lambda v: W.ntile_distribution(v.packages.withColumn("s", F.expr("package_id % 97")), "ecosystem", "s", "package_id").select("package_id", "pct_rank", "quartile"))
query("ord_severity_rank", "SELECT f.finding_id, r.rnk, row_number() OVER (ORDER BY r.rnk DESC, f.finding_id) AS pos FROM findings f JOIN severity_rank r ON f.severity = r.severity ORDER BY pos LIMIT 50")(lambda v: W.capped_strict(v.findings.withColumn("rnk", W.severity_order()), [F.desc("rnk"), F.col("finding_id")], 50).selectExpr("finding_id", "rnk", "row_number() OVER (ORDER BY rnk DESC, finding_id) AS pos"))
query("ord_capped_strict", "SELECT finding_id, severity FROM findings ORDER BY severity <> 'High', score DESC, finding_id LIMIT 100")(lambda v: W.capped_strict(v.findings, [(F.col("severity") != "High"), F.desc("score"), F.col("finding_id")], 100).select("finding_id", "severity"))
query("ord_keyset_page", "SELECT package_id, name, (SELECT count(*) > 25 FROM packages WHERE package_id > 40) AS has_more FROM packages WHERE package_id > 40 ORDER BY package_id LIMIT 25")(lambda v: W.keyset_page(v.packages.select("package_id", "name"), ["package_id"], (40,), 25))
query("ord_uncapped_saved", "SELECT package_id, version FROM packages WHERE NOT is_deleted ORDER BY package_id")(lambda v: P.live_rows(v.packages).select("package_id", "version").orderBy("package_id"))
query("ord_last_activity", "SELECT o.package_id, greatest(TIMESTAMP '1996-01-01 00:00:00', m) AS last_activity FROM packages o LEFT JOIN (SELECT package_id, max(first_detected) AS m FROM findings GROUP BY 1) x ON o.package_id = x.package_id")(lambda v: W.last_activity(v.packages.select("package_id", F.expr("TIMESTAMP '1996-01-01 00:00:00' AS own")), v.findings, "package_id", "own", "first_detected").select("package_id", "last_activity"))
query("ord_member_queue", "SELECT finding_id FROM findings ORDER BY status = 'In Progress' DESC, score DESC, finding_id LIMIT 40")(lambda v: W.capped_strict(v.findings, [F.desc(F.col("status") == "In Progress"), F.desc("score"), F.col("finding_id")], 40).select("finding_id"))

# ------------------------------------------------ sets

query("set_scan_delta", "SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN a.fingerprint IS NULL THEN 'new' WHEN b.fingerprint IS NULL THEN 'fixed' ELSE 'unchanged' END AS state FROM scan_base a FULL JOIN scan_head b ON a.fingerprint = b.fingerprint")(lambda v: sets.scan_delta(v.scan_base, v.scan_head))
query("set_empty_base", "SELECT count(*) FILTER (WHERE a.fingerprint IS NULL) AS new, count(*) FILTER (WHERE b.fingerprint IS NULL) AS fixed, count(*) FILTER (WHERE a.fingerprint = b.fingerprint) AS unchanged, CASE WHEN count(*) FILTER (WHERE a.fingerprint IS NULL) = 0 THEN 'nothing_new' ELSE 'new_findings' END AS answer FROM scan_base a FULL JOIN scan_head b ON a.fingerprint = b.fingerprint")(lambda v: sets.empty_base(sets.scan_delta(v.scan_base, v.scan_head), True))
query("set_union_runs", "SELECT fingerprint, path, rule, CAST(NULL AS VARCHAR) AS extra, 'a' AS engine FROM scan_base UNION ALL SELECT fingerprint, path, NULL, rule, 'b' FROM scan_head")(lambda v: sets.union_runs(a=v.scan_base, b=v.scan_head.withColumnRenamed("rule", "extra")))
query("set_union_distinct_places", "SELECT path, rule FROM scan_base UNION SELECT path, rule FROM scan_head")(lambda v: sets.union_distinct_places(v.scan_base, v.scan_head, keys=["path", "rule"]))
query("set_unserved_types", "SELECT DISTINCT scan_type FROM findings EXCEPT SELECT scan_type FROM findings WHERE scan_type IN ('type1', 'type2')")(lambda v: sets.unserved_types(v.findings.select("scan_type").distinct(), v.findings.where("scan_type IN ('type1', 'type2')"), "scan_type"))
query("set_declared_vs_observed", "SELECT coalesce(a.severity, b.severity) AS severity, CASE WHEN a.severity IS NULL THEN 'observed_only' WHEN b.severity IS NULL THEN 'declared_only' ELSE 'both' END AS side FROM (SELECT severity FROM deadlines UNION SELECT 'Info') a FULL JOIN (SELECT DISTINCT severity FROM findings) b ON a.severity = b.severity")(lambda v: sets.declared_vs_observed(v.deadlines.select("severity").union(v.spark.sql("SELECT 'Info'")), v.findings, "severity"))
query("set_repo_list", "SELECT repository_id, source, row_number() OVER (ORDER BY source, repository_id) AS pos FROM (SELECT repository_id, min(source) AS source FROM (SELECT DISTINCT repository_id, 0 AS source FROM findings WHERE severity = 'Critical' UNION ALL SELECT repository_id, 1 FROM repositories) GROUP BY 1 ORDER BY 2, 1 LIMIT 200)")(lambda v: sets.ordered_union([v.findings.where("severity = 'Critical'"), v.repositories], "repository_id", 200))

"""Queries of scalars, graphs, quality, life cycle, texts, policy, readers, writers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import AS_OF
from ..functions import scalars as S
from ..functions import texts as T
from ..operators import aggregates as A
from ..operators import filters as P
from ..operators import graphs as G
from ..operators import joins as J
from ..operators import lifecycle as L
from ..operators import quality as Q
from ..operators import windows as W
from ..sources import documents as D
from ..sources import sinks as K
from ..streaming import streams as X
from .policy import Policy, at_or_above, bound, param_job
from .registry import query

_OPEN = "is_deleted IS NOT TRUE AND status IN ('Open', 'In Progress') AND is_false_positive IS NOT TRUE AND is_risk_accepted IS NOT TRUE"


@query("open_by_owner", f"""
SELECT owner, severity, n, overdue, round(100.0 * n / sum(n) OVER (), 2) AS share_pct, unreported, with_asset FROM (
 SELECT coalesce(a.team, r.owner, 'Unknown') AS owner, f.severity, count(*) AS n,
  count(*) FILTER (WHERE f.first_detected + INTERVAL '1' DAY * CAST(d.days AS INT) < {AS_OF}) AS overdue,
  count(*) FILTER (WHERE f.is_false_positive IS NULL) AS unreported, count(a.asset_id) AS with_asset
 FROM findings f LEFT JOIN assets a ON f.asset_id = a.asset_id LEFT JOIN repositories r ON f.repository_id = r.repository_id LEFT JOIN deadlines d ON f.severity = d.severity
 WHERE f.{_OPEN.replace(' AND ', ' AND f.')} GROUP BY 1, 2) ORDER BY n DESC, owner, severity LIMIT 100""")
def _(v):
    policy = Policy(v.policy)
    rows = P.open_population(v.findings, policy.values("open_statuses"), policy.switch("include_risk_accepted"))
    rows = rows.join(v.assets.select("asset_id", "team", F.lit(1).alias("_a")), "asset_id", "left").join(v.repositories.select("repository_id", "owner"), "repository_id", "left").join(v.deadlines, "severity", "left")
    due = S.deadline(F.col("first_detected"), F.col("days"))
    out = rows.groupBy(F.coalesce("team", "owner", F.lit("Unknown")).alias("owner"), "severity").agg(F.count("*").alias("n"), F.count_if(S.sla_state(due, F.expr(AS_OF), 14) == "breached").alias("overdue"), F.count_if(F.col("is_false_positive").isNull()).alias("unreported"), F.count("_a").alias("with_asset"))
    from pyspark.sql import Window

    out = out.withColumn("share_pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))
    return W.capped_strict(out, [F.desc("n"), F.col("owner"), F.col("severity")], 100)


# ------------------------------------------------ scalars

_VECTOR = "concat('CVSS:3.1/AV:', CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'A' WHEN 2 THEN 'L' ELSE 'P' END, '/AC:', CASE p_size % 2 WHEN 0 THEN 'L' ELSE 'H' END, '/PR:', CASE p_partkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'L' ELSE 'H' END, '/UI:', CASE p_partkey % 2 WHEN 0 THEN 'N' ELSE 'R' END, '/S:', CASE p_size % 3 WHEN 0 THEN 'C' ELSE 'U' END, '/C:', CASE p_partkey % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END, '/I:', CASE p_size % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'N' END, '/A:', CASE p_partkey % 7 WHEN 0 THEN 'H' WHEN 1 THEN 'L' WHEN 2 THEN 'X' ELSE 'N' END)"
_CVSS = """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 2 THEN NULL WHEN impact <= 0 THEN 0 ELSE ceil(round(least(10, CASE WHEN ch THEN 1.08 * (impact + ex) ELSE impact + ex END) * 100000) / 10000) / 10 END AS score FROM (
 SELECT *, CASE WHEN ch THEN 7.52 * (iss - 0.029) - 3.25 * power(iss - 0.02, 15) ELSE 6.42 * iss END AS impact FROM (
 SELECT p_partkey, p_size % 3 = 0 AS ch, 1 - (1 - CAST(CASE p_partkey % 5 WHEN 0 THEN 0.56 WHEN 1 THEN 0.22 ELSE 0 END AS DOUBLE)) * (1 - CAST(CASE p_size % 5 WHEN 0 THEN 0.56 WHEN 1 THEN 0.22 ELSE 0 END AS DOUBLE)) * (1 - CAST(CASE p_partkey % 7 WHEN 0 THEN 0.56 WHEN 1 THEN 0.22 ELSE 0 END AS DOUBLE)) AS iss,
 8.22 * CAST(CASE p_partkey % 4 WHEN 0 THEN 0.85 WHEN 1 THEN 0.62 WHEN 2 THEN 0.55 ELSE 0.2 END AS DOUBLE) * CAST(CASE p_size % 2 WHEN 0 THEN 0.77 ELSE 0.44 END AS DOUBLE) * CAST(CASE p_partkey % 3 WHEN 0 THEN 0.85 WHEN 1 THEN CASE WHEN p_size % 3 = 0 THEN 0.68 ELSE 0.62 END ELSE CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 0.27 END END AS DOUBLE) * CAST(CASE p_partkey % 2 WHEN 0 THEN 0.85 ELSE 0.62 END AS DOUBLE) AS ex FROM part))"""
query("fn_cvss3_base", _CVSS)(lambda v: v.part.select("p_partkey", S.cvss3_base(F.expr(_VECTOR)).alias("score")))
query("fn_severity_band", "SELECT finding_id, CASE WHEN s >= 9 THEN 'Critical' WHEN s >= 7 THEN 'High' WHEN s >= 4 THEN 'Medium' WHEN s > 0 THEN 'Low' ELSE 'Unknown' END AS band FROM (SELECT finding_id, package_id % 11 AS s FROM findings)")(lambda v: v.findings.select("finding_id", S.severity_band(F.expr("package_id % 11")).alias("band")))
query("fn_severity_precedence", "SELECT finding_id, CASE greatest(CASE WHEN s >= 9 THEN 4 WHEN s >= 7 THEN 3 WHEN s >= 4 THEN 2 WHEN s > 0 THEN 1 ELSE 0 END, CASE severity WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) WHEN 4 THEN 'Critical' WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unknown' END AS stored FROM (SELECT finding_id, severity, package_id % 11 AS s FROM findings)")(lambda v: v.findings.select("finding_id", S.severity_precedence(F.expr("package_id % 11"), F.col("severity"), lambda c: F.when(c == "Critical", 4).when(c == "High", 3).when(c == "Medium", 2).when(c == "Low", 1).otherwise(0)).alias("stored")))
query("fn_level_from_rating", "SELECT severity, CASE WHEN severity IN ('Critical', 'High') THEN 'error' WHEN severity = 'Medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM findings GROUP BY 1, 2")(lambda v: v.findings.groupBy("severity", S.level_from_rating(F.col("severity")).alias("level")).agg(F.count("*").alias("n")))
query("fn_norm_snippet", "SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS t FROM documents")(lambda v: v.documents.select("doc_id", S.norm_snippet(F.col("text")).alias("t")))
query("fn_fingerprint", "SELECT finding_id, substr(sha256(concat_ws('|', scan_type, path, severity)), 1, 32) AS fp FROM findings")(lambda v: v.findings.select("finding_id", S.fingerprint(F.col("scan_type"), F.col("path"), F.col("severity")).alias("fp")))
query("fn_file_blob_id", "SELECT doc_id, sha1(concat('blob ', CAST(strlen(text) AS VARCHAR), chr(0), text)) AS blob_id FROM documents")(lambda v: v.documents.select("doc_id", S.file_blob_id(F.col("text")).alias("blob_id")))
query("fn_edge_id", "SELECT from_key, to_key, sha256(concat_ws('|', 't1', from_key, edge_type, to_key)) AS edge_id FROM edges")(lambda v: v.edges.select("from_key", "to_key", S.edge_id(F.lit("t1"), F.col("from_key"), F.col("to_key"), F.col("edge_type")).alias("edge_id")))
query("fn_repo_key", "SELECT c_custkey, concat('git.example.com/', lower(c_mktsegment), '/r', CAST(c_custkey AS VARCHAR(20))) AS repo FROM customer")(lambda v: v.customer.select("c_custkey", S.repo_key(F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('https://u:p@Git.example.com/', c_mktsegment, '/R', c_custkey, '.git') WHEN 1 THEN concat('git@git.example.com:', c_mktsegment, '/r', c_custkey) ELSE concat('ssh://git@git.example.com/', c_mktsegment, '/r', c_custkey, '/') END")).alias("repo")))
query("fn_norm_uri", "SELECT finding_id, path FROM findings")(lambda v: v.findings.select("finding_id", S.norm_uri(F.expr("CASE package_id % 3 WHEN 0 THEN concat('file://', path) WHEN 1 THEN concat('././', path) ELSE path END")).alias("path")))
query("fn_image_digest", "SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN concat('img@sha256:', md5(p_name)) END AS image FROM part")(lambda v: v.part.select("p_partkey", S.image_digest(F.expr("array(concat('img:', p_size), CASE WHEN p_partkey % 3 > 0 THEN concat('img@sha256:', md5(p_name)) ELSE 'img:latest' END)")).alias("image")))
query("fn_key_parts", "SELECT from_key, split_part(from_key, ':', 1) AS scheme, substr(from_key, strpos(from_key, ':') + 1) AS rest FROM edges")(lambda v: v.edges.select("from_key", S.key_scheme(F.col("from_key")).alias("scheme"), S.key_rest(F.col("from_key")).alias("rest")))
query("fn_ecosystem", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'pypi' WHEN 1 THEN 'npm' WHEN 2 THEN 'golang' END AS ecosystem FROM part")(lambda v: v.part.select("p_partkey", F.try_element_at(F.create_map(*(F.lit(x) for x in ("pip", "pypi", "npm", "npm", "gomod", "golang"))), F.expr("CASE p_size % 4 WHEN 0 THEN 'pip' WHEN 1 THEN 'npm' WHEN 2 THEN 'gomod' ELSE 'other' END")).alias("ecosystem")))
query("fn_package_normalise", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) ELSE p_name END AS name FROM part")(lambda v: v.part.select("p_partkey", S.package_normalise(F.col("p_name"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'PyPI' ELSE 'npm' END")).alias("name")))
query("fn_version_key", "SELECT ecosystem, max_by(version, (a, b, c, package_id)) AS newest FROM (SELECT *, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c FROM packages) GROUP BY 1")(lambda v: v.packages.groupBy("ecosystem").agg(F.max_by("version", F.struct(S.version_key(F.col("version")).alias("k"), "package_id")).alias("newest")))
query("fn_pep440_key", "SELECT ecosystem, max_by(version, (a, b, c, package_id)) AS newest FROM (SELECT *, CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b, CAST(split_part(version, '.', 3) AS INT) AS c FROM packages) GROUP BY 1")(lambda v: v.packages.groupBy("ecosystem").agg(F.max_by("version", F.struct(S.pep440_key(F.col("version")).alias("k"), "package_id")).alias("newest")))
query("fn_lowest_fix_above", "SELECT p_partkey, CASE WHEN p_size < 9 THEN '9.9' WHEN p_size < 20 THEN '20.0' WHEN p_size < 35 THEN '35.1' ELSE '9.9' END AS fix FROM part")(lambda v: v.part.select("p_partkey", S.lowest_fix_above(F.expr("concat(p_size, '.99')"), F.array(F.lit("35.1"), F.lit("9.9"), F.lit("20.0"))).alias("fix")))
query("fn_version_line", "SELECT package_id, CASE WHEN split_part(version, '.', 1) = '0' THEN concat('0.', split_part(version, '.', 2)) ELSE split_part(version, '.', 1) END AS line FROM packages")(lambda v: v.packages.select("package_id", S.version_line(F.col("version")).alias("line")))
query("fn_crosses_major", "SELECT package_id, split_part(version, '.', 1) <> '7' AS crosses FROM packages")(lambda v: v.packages.select("package_id", S.crosses_major(F.col("version"), F.lit("7.3.1")).alias("crosses")))
query("fn_prerelease", "SELECT package_id, package_id % 3 = 0 AS pre FROM packages")(lambda v: v.packages.select("package_id", S.prerelease(F.expr("CASE WHEN package_id % 3 = 0 THEN concat(version, 'rc1') ELSE version END")).alias("pre")))
query("fn_path_scope", "SELECT finding_id, CASE WHEN package_id % 2 = 0 THEN 'tests' END AS scope FROM findings")(lambda v: v.findings.select("finding_id", S.path_scope(F.expr("CASE WHEN package_id % 2 = 0 THEN concat('lib/tests/', path) ELSE path END")).alias("scope")))
query("fn_log_clean", "SELECT turn, conv_id, substr(regexp_replace(text, '[\\x00-\\x08\\x0B-\\x1F\\x7F]', '', 'g'), 1, 400) AS line FROM conversations")(lambda v: v.conversations.select("turn", "conv_id", S.log_clean(F.concat(F.lit("2024-01-02T03:04:05.1Z "), F.lit("\x1b[31m"), "text", F.lit("\x1b[0m"))).alias("line")))
query("fn_secret_mask", "SELECT p_partkey, concat('token = ', '[MASKED]', ' end') AS masked, 'assignment' AS kinds FROM part")(lambda v: v.part.select("p_partkey", S.secret_mask(F.expr("concat('token = ', md5(p_name), ' end')")).alias("masked"), F.array_join(S.secret_kinds(F.expr("concat('token = ', md5(p_name), ' end')")), ",").alias("kinds")))
query("fn_deadline", "SELECT finding_id, CAST(CASE WHEN days IS NOT NULL THEN first_detected + INTERVAL '1' DAY * CAST(days AS INT) END AS DATE) AS due FROM findings f LEFT JOIN deadlines d ON f.severity = d.severity")(lambda v: v.findings.join(v.deadlines, "severity", "left").select("finding_id", S.deadline(F.col("first_detected"), F.col("days")).cast("date").alias("due")))
query("fn_sla_state", f"SELECT CASE WHEN days IS NULL THEN 'none' WHEN due < {AS_OF} THEN 'breached' WHEN due <= {AS_OF} + INTERVAL '14' DAY THEN 'due_soon' ELSE 'on_track' END AS state, count(*) AS n FROM (SELECT days, first_detected + INTERVAL '1' DAY * CAST(days AS INT) AS due FROM findings f LEFT JOIN deadlines d ON f.severity = d.severity) GROUP BY 1")(lambda v: v.findings.join(v.deadlines, "severity", "left").groupBy(S.sla_state(S.deadline(F.col("first_detected"), F.col("days")), F.expr(AS_OF), 14).alias("state")).agg(F.count("*").alias("n")))
query("fn_age_columns", "SELECT finding_id, date_diff('day', CAST(first_detected AS DATE), DATE '1999-01-01') AS age FROM findings")(lambda v: v.findings.select("finding_id", S.age_days(F.col("first_detected"), F.expr(AS_OF)).alias("age")))
query("fn_label_parts", "SELECT finding_id, concat_ws(' on ', cve_id, CAST(asset_id AS VARCHAR(20))) AS title FROM findings")(lambda v: v.findings.select("finding_id", P.label("cve_id", "asset_id").alias("title")))
query("fn_json_bag", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")(lambda v: v.events.select("event_id", F.from_json("props", "k int")["k"].alias("k")))
query("fn_three_clocks", f"SELECT source, CAST(max(ts) AS DATE) AS data_as_of, date_diff('day', CAST(max(ts) AS DATE), DATE '1999-01-01') AS behind FROM runs GROUP BY 1")(lambda v: v.runs.groupBy("source").agg(F.max("ts").cast("date").alias("data_as_of"), F.datediff(F.expr(AS_OF), F.max("ts")).alias("behind")))

# ------------------------------------------------ graphs

query("gr_neighbors", "SELECT DISTINCT from_key AS seed, to_key AS neighbor FROM edges WHERE edge_type = 'deployed_as' AND from_key IN (SELECT concat('image:', CAST(asset_id AS VARCHAR(20))) FROM assets WHERE is_exposed) UNION SELECT DISTINCT to_key, from_key FROM edges WHERE edge_type = 'deployed_as' AND to_key IN (SELECT concat('image:', CAST(asset_id AS VARCHAR(20))) FROM assets WHERE is_exposed)")(lambda v: G.neighbors(v.edges, v.assets.where("is_exposed").selectExpr("concat('image:', asset_id) AS node"), "both", "deployed_as"))
_REACH = "WITH RECURSIVE r(node, d) AS (SELECT package_id, 0 FROM ({seeds}) UNION SELECT q.parent, r.d + 1 FROM r JOIN ({req}) q ON q.child = r.node{limit}) SELECT node, min(d) AS distance FROM r GROUP BY 1"
from ..fixtures import VIEWS as _V  # noqa: E402

#: Where walks begin: packages that were removed.
_REMOVED = f"SELECT package_id FROM ({_V['packages']}) WHERE is_deleted"
_EDGES = lambda v: v.requirements.select(F.col("child").alias("from_key"), F.col("parent").alias("to_key"))
_SEEDS = lambda v: v.packages.where("is_deleted").select(F.col("package_id").alias("node"))
query("gr_k_hop", _REACH.format(req=_V["requirements"], seeds=_REMOVED, limit=" WHERE r.d < 2"))(lambda v: G.reach(_EDGES(v), _SEEDS(v), 2).select("node", "distance"))
query("gr_reachable", _REACH.format(req=_V["requirements"], seeds=_REMOVED, limit=""))(lambda v: G.reachable(_EDGES(v).withColumn("certain", F.expr("from_key % 2 = 0")), _SEEDS(v)).select("node", F.col("level").alias("distance")))
query("gr_blast_radius", f"WITH RECURSIVE r(node, d) AS (SELECT package_id, 0 FROM ({_REMOVED}) UNION SELECT q.child, r.d + 1 FROM r JOIN ({_V['requirements']}) q ON q.parent = r.node) SELECT node, min(d) AS distance FROM r GROUP BY 1")(lambda v: G.blast_radius(_EDGES(v), _SEEDS(v)).select("node", "distance"))
query("gr_path_to_entry", _REACH.format(req=_V["requirements"], seeds=_REMOVED, limit="").replace(") SELECT node, min(d) AS distance FROM r GROUP BY 1", f"""), t AS (SELECT node, min(d) AS d FROM r GROUP BY 1),
p AS (SELECT t.node, q.child AS parent, q.child % 2 <> 0 AS unsure FROM t JOIN (SELECT DISTINCT child, parent FROM ({_V["requirements"]})) q ON q.parent = t.node JOIN t s ON s.node = q.child AND s.d = t.d - 1 WHERE t.d > 0
    QUALIFY row_number() OVER (PARTITION BY t.node ORDER BY q.child % 2 <> 0, q.child) = 1),
c AS (SELECT node, CAST(node AS VARCHAR) AS chain, 0 AS uncertain FROM t WHERE d = 0 UNION ALL SELECT p.node, concat(c.chain, '>', CAST(p.node AS VARCHAR)), c.uncertain + CASE WHEN p.unsure THEN 1 ELSE 0 END FROM c JOIN p ON p.parent = c.node)
SELECT CAST(node AS VARCHAR) AS node, chain, uncertain FROM c"""))(lambda v: G.path_to_entry(G.reachable(_EDGES(v).withColumn("certain", F.expr("from_key % 2 = 0")), _SEEDS(v))).withColumn("chain", F.array_join("chain", ">")))
query("gr_shortest_chain", f"WITH RECURSIVE r(node, d, chain) AS (SELECT package_id, 0, [CAST(package_id AS VARCHAR)] FROM ({_REMOVED}) UNION SELECT q.parent, r.d + 1, list_append(r.chain, CAST(q.parent AS VARCHAR)) FROM r JOIN ({_V['requirements']}) q ON q.child = r.node) SELECT node, d AS distance, array_to_string(min(chain), '>') AS chain FROM (SELECT *, min(d) OVER (PARTITION BY node) AS m FROM r) WHERE d = m GROUP BY 1, 2")(lambda v: G.shortest_chain(_EDGES(v), _SEEDS(v)).select("node", "distance", F.array_join("chain", ">").alias("chain")))
query("gr_direct_parents", "SELECT DISTINCT child, parent FROM requirements WHERE child IN (SELECT package_id FROM packages WHERE is_deleted)")(lambda v: G.direct_parents(v.requirements, v.packages.where("is_deleted").select(F.col("package_id").alias("child"))))
query("gr_edge_contract", "SELECT edge_type, split_part(from_key, ':', 1) AS from_scheme, NOT (edge_type = 'owns') AS legal, count(*) AS n FROM edges GROUP BY 1, 2, 3")(lambda v: G.edge_contract(v.edges, v.spark.sql("SELECT * FROM VALUES ('deployed_as', 'image', 'cloud'), ('exposed_via', 'cloud', 'net'), ('contains', 'image', 'pkg') AS t(edge_type, from_scheme, to_scheme)")).groupBy("edge_type", "from_scheme", "legal").agg(F.count("*").alias("n")))
query("gr_unconnected", "SELECT k FROM (SELECT concat('image:', CAST(p_partkey AS VARCHAR(20))) AS k FROM part) WHERE k NOT IN (SELECT from_key FROM edges) AND k NOT IN (SELECT to_key FROM edges)")(lambda v: G.unconnected(v.part.selectExpr("concat('image:', p_partkey) AS k"), v.edges, "k"))
query("gr_distinct_targets", "SELECT from_key, count(DISTINCT to_key) AS targets FROM edges WHERE edge_type = 'contains' GROUP BY 1")(lambda v: G.distinct_targets(v.edges, "contains"))
query("gr_name_collisions", "SELECT name, count(DISTINCT ecosystem) AS clusters FROM packages GROUP BY 1 HAVING count(DISTINCT ecosystem) > 1")(lambda v: G.name_collisions(v.packages, "name", "ecosystem"))
query("gr_propagate_properties", "SELECT from_key, zone, support FROM (SELECT e.from_key, concat('z', CAST(n_regionkey AS VARCHAR(20))) AS zone, count(*) AS support, row_number() OVER (PARTITION BY e.from_key ORDER BY count(*) DESC, concat('z', CAST(n_regionkey AS VARCHAR(20)))) AS r FROM edges e JOIN nation ON e.to_key = concat('cloud:', CAST(n_nationkey AS VARCHAR(20))) WHERE edge_type = 'deployed_as' GROUP BY 1, 2) WHERE r = 1")(lambda v: G.propagate(v.edges, v.nation.selectExpr("concat('cloud:', n_nationkey) AS node", "concat('z', n_regionkey) AS zone"), "deployed_as", "zone"))
query("gr_governance_ladder", "SELECT asset_id, coalesce(team, environment) AS value, CASE WHEN team IS NOT NULL THEN 'declared' WHEN environment IS NOT NULL THEN 'environment' ELSE 'none' END AS rung FROM assets")(lambda v: G.governance_ladder(v.assets, [("declared", "team"), ("environment", "environment")]).select("asset_id", "value", "rung"))
query("gr_running_state", "SELECT CASE WHEN asset_id IN (SELECT asset_id FROM assets WHERE environment = 'prod') THEN 'running' WHEN asset_id IN (SELECT asset_id FROM assets WHERE team IS NOT NULL) THEN 'recorded_only' WHEN asset_id IN (SELECT asset_id FROM assets WHERE is_exposed) THEN 'exposed_only' ELSE 'not_observed' END AS state, count(*) AS n FROM findings GROUP BY 1")(lambda v: G.running_state(v.findings, "asset_id", v.assets.where("environment = 'prod'"), v.assets.where("team IS NOT NULL"), v.assets.where("is_exposed")))
query("gr_waves", f"WITH RECURSIVE w(job, d) AS (SELECT p_partkey, 1 FROM part WHERE p_partkey = 1 UNION SELECT q.child, w.d + 1 FROM w JOIN ({_V['requirements']}) q ON q.parent = w.job) SELECT job, max(d) AS wave FROM w GROUP BY 1")(lambda v: G.waves(v.requirements.selectExpr("child AS job", "parent AS reads")))
query("gr_layer_prefix", "SELECT i.s_suppkey AS image, max(CASE WHEN i.s_suppkey % 3 = o.s_suppkey % 3 THEN CASE WHEN i.s_suppkey % 6 = o.s_suppkey % 6 THEN CASE WHEN i.s_nationkey = o.s_nationkey THEN 3 ELSE 2 END ELSE 1 END END) AS shared FROM supplier i JOIN supplier o ON i.s_suppkey <> o.s_suppkey AND i.s_suppkey % 3 = o.s_suppkey % 3 GROUP BY 1")(lambda v: G.layer_prefix(v.supplier.selectExpr("s_suppkey AS image", "array(concat('a', s_suppkey % 3), concat('b', s_suppkey % 6), concat('c', s_nationkey)) AS layers")).select("image", "shared"))
query("gr_import_roots", "SELECT DISTINCT concat('pkg', CAST(p_size AS VARCHAR(20)), '.sub.m') AS module, CASE WHEN p_size % 2 = 0 THEN 'dist-sub' WHEN p_size % 3 = 0 THEN 'dist-top' ELSE concat('pkg', CAST(p_size AS VARCHAR(20))) END AS distribution FROM part")(lambda v: G.import_roots(v.part.selectExpr("concat('pkg', p_size, '.sub.m') AS module"), v.part.where("p_size % 2 = 0").selectExpr("concat('pkg', p_size, '.sub') AS prefix", "'dist-sub' AS distribution").distinct().union(v.part.where("p_size % 3 = 0").selectExpr("concat('pkg', p_size) AS prefix", "'dist-top' AS distribution").distinct())).select("module", "distribution"))

# ------------------------------------------------ quality

query("dq_expectations", "SELECT 'rows' AS rule, CAST(1 AS DOUBLE) AS threshold, 'ge' AS op, CAST(count(*) AS DOUBLE) AS measured, count(*) >= 1 AS passed FROM findings UNION ALL SELECT 'null_share', 0.05, 'le', 1.0 * (count(*) - count(cve_id)) / count(*), 1.0 * (count(*) - count(cve_id)) / count(*) <= 0.05 FROM findings")(lambda v: Q.expectations(v.findings, {"rows": (F.count("*"), 1, "ge"), "null_share": (F.count_if(F.col("cve_id").isNull()) / F.count("*"), 0.05, "le")}))
query("dq_freshness", "SELECT source, max(ts) AS newest, date_diff('day', CAST(max(ts) AS DATE), DATE '2030-01-01') AS age_days, CASE WHEN date_diff('day', CAST(max(ts) AS DATE), DATE '2030-01-01') <= 30 THEN 'fresh' ELSE 'stale' END AS state FROM runs GROUP BY 1")(lambda v: Q.freshness(v.runs, "source", "ts", "DATE '2030-01-01'", 30))
query("dq_sync_health", "SELECT source, CASE max_by(status, (ts, event_id)) WHEN 'success' THEN 'healthy' ELSE 'failing' END AS health, count(*) FILTER (WHERE status = 'failure') AS failures FROM runs GROUP BY 1")(lambda v: Q.sync_health(v.runs, "source", "ts", "event_id"))
query("dq_measure_coverage", "SELECT environment, CASE WHEN count(team) = 0 THEN 'blind' WHEN 1.0 * count(team) / count(*) < 0.5 THEN 'partial' ELSE 'measured' END AS state, round(avg(CASE WHEN team IS NOT NULL THEN asset_id END), 4) AS value, round(1.0 * count(team) / count(*), 4) AS coverage FROM assets GROUP BY 1")(lambda v: Q.measure_coverage(v.assets.withColumn("x", F.when(F.col("team").isNotNull(), F.col("asset_id"))), ["environment"], "x"))
query("dq_decompose", "SELECT severity, CASE WHEN severity = 'High' THEN n + 1 ELSE n END AS stored, n AS recomputed, CASE WHEN severity = 'High' THEN 'differs' ELSE 'match' END AS state FROM (SELECT severity, count(*) AS n FROM findings GROUP BY 1)")(lambda v: Q.decompose(v.findings, v.findings.groupBy("severity").agg(F.count("*").alias("n")).selectExpr("severity", "CASE WHEN severity = 'High' THEN n + 1 ELSE n END AS stored"), "severity", F.count("*")))
query("dq_threshold", "SELECT count(score) AS known, count(*) FILTER (WHERE score > 0.5) AS over, bool_or(score > 0.5) AS any_over, bool_and(score > 0.5) AS all_over, count(*) FILTER (WHERE score > 0.5) >= 10 AS enough_over FROM findings")(lambda v: Q.threshold(v.findings, "score", 0.5, 10))
query("dq_changed_fields", "SELECT fingerprint, 'path' AS field, b.path AS before, h.path AS after FROM scan_base b JOIN scan_head h USING (fingerprint) WHERE b.path IS DISTINCT FROM h.path UNION ALL SELECT fingerprint, 'rule', b.rule, h.rule FROM scan_base b JOIN scan_head h USING (fingerprint) WHERE b.rule IS DISTINCT FROM h.rule")(lambda v: Q.changed_fields(v.scan_base, v.scan_head, "fingerprint", ["path", "rule"]))
query("dq_claim_compare", "SELECT coalesce(b.fingerprint, h.fingerprint) AS fingerprint, CASE WHEN h.fingerprint IS NULL THEN 'gone' WHEN b.fingerprint IS NULL THEN 'new' WHEN b.path IS DISTINCT FROM h.path OR b.rule IS DISTINCT FROM h.rule THEN 'changed' ELSE 'unchanged' END AS state, CASE WHEN h.fingerprint IS NULL OR b.fingerprint IS NULL THEN '' ELSE concat_ws(',', CASE WHEN b.path IS DISTINCT FROM h.path THEN 'path' END, CASE WHEN b.rule IS DISTINCT FROM h.rule THEN 'rule' END) END AS moved FROM scan_base b FULL JOIN scan_head h ON b.fingerprint = h.fingerprint")(lambda v: Q.claim_compare(v.scan_base, v.scan_head, "fingerprint", ["path", "rule"]))
query("dq_three_way_merge", """
SELECT p_partkey AS k, CASE WHEN t = b AND o = b THEN 'unchanged' WHEN t = o THEN 'already' WHEN o = b THEN 'applied' WHEN t = b THEN 'edited' ELSE 'kept' END AS state, CASE WHEN NOT (t = b AND o = b) AND t <> o AND o = b THEN t ELSE o END AS value
FROM (SELECT p_partkey, p_size AS b, CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS t, CASE WHEN p_partkey % 3 = 0 THEN p_size + p_partkey % 4 ELSE p_size END AS o FROM part)""")(lambda v: Q.three_way_merge(v.part.selectExpr("p_partkey AS k", "p_size AS x"), v.part.selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 2 = 0 THEN p_size + 1 ELSE p_size END AS x"), v.part.selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 3 = 0 THEN p_size + p_partkey % 4 ELSE p_size END AS x"), ["k"], "x"))
query("dq_rollup_consistency", "SELECT severity, 0 AS difference FROM findings GROUP BY 1")(lambda v: Q.rollup_consistency(v.findings, v.findings.groupBy("severity").agg(F.count("cve_id").alias("a"), F.count_if(F.col("cve_id").isNull()).alias("b")).selectExpr("severity", "a + b AS total"), "severity", "total"))
query("dq_column_supply", "SELECT concat('c', CAST(p_partkey AS VARCHAR(20))) AS column_name, CASE WHEN p_size % 5 = 0 THEN 'never_collected' WHEN p_size % 3 = 0 THEN 'connect_a_tool' WHEN p_size % 2 = 0 THEN 'failing' WHEN p_partkey % 4 = 0 THEN 'not_reported' ELSE 'supplied' END AS supply FROM part")(lambda v: Q.column_supply(v.part.selectExpr("concat('c', p_partkey) AS column_name", "p_partkey % 4 AS filled"), v.part.where("p_size % 5 <> 0").selectExpr("concat('c', p_partkey) AS column_name", "p_size AS tool"), v.part.selectExpr("p_size AS tool", "p_size % 3 <> 0 AS connected", "p_size % 2 <> 0 AS healthy").distinct()))
query("dq_empty_reason", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'blocked' WHEN p_size % 3 = 0 THEN 'unknown' WHEN p_size % 2 = 0 THEN 'stale' WHEN p_partkey % 4 = 0 THEN 'empty' ELSE 'live' END AS reason FROM part")(lambda v: Q.empty_reason(v.part.selectExpr("p_partkey", "CASE WHEN p_size % 5 = 0 THEN 'failing' ELSE 'supplied' END AS supply", "CASE WHEN p_size % 3 <> 0 THEN p_size % 2 <> 0 END AS synced", "p_partkey % 4 AS n_rows")).select("p_partkey", "reason"))
query("dq_assumption_ledger", "SELECT k.severity, CAST(d.days AS VARCHAR) AS value, CASE WHEN d.days IS NULL THEN 'unknown' ELSE 'measured' END AS basis FROM (SELECT DISTINCT severity FROM findings) k LEFT JOIN deadlines d ON k.severity = d.severity")(lambda v: Q.assumption_ledger(v.findings.select("severity").distinct(), v.deadlines.selectExpr("severity", "CAST(days AS STRING) AS value", "'measured' AS basis"), "severity"))

# ------------------------------------------------ life cycle

query("lc_retire_by_scope", "SELECT fingerprint, path, CASE WHEN fingerprint IN (SELECT fingerprint FROM scan_head) THEN 'reported' WHEN path IN (SELECT path FROM scan_scope) THEN 'retired' ELSE 'held' END AS verdict FROM scan_base")(lambda v: L.retire_by_scope(v.scan_base, v.scan_head, v.scan_scope, True))
query("lc_apply_scan", """
SELECT fingerprint, path, change, CASE WHEN change IN ('inserted', 'reopened') THEN 'Open' WHEN change = 'retired' THEN 'Fixed' ELSE was END AS status, CASE WHEN n IS NOT NULL THEN 's2' END AS seen_in FROM (
 SELECT *, CASE WHEN was IS NULL THEN 'inserted' WHEN n IS NOT NULL AND was = 'Fixed' THEN 'reopened' WHEN n IS NOT NULL THEN 'seen' WHEN was <> 'Fixed' AND path IN (SELECT path FROM scan_scope) THEN 'retired' ELSE 'held' END AS change FROM (
  SELECT coalesce(b.fingerprint, h.fingerprint) AS fingerprint, coalesce(h.path, b.path) AS path, CASE WHEN b.fingerprint IS NULL THEN NULL WHEN b.rule = 'A' THEN 'Fixed' ELSE 'Open' END AS was, h.fingerprint AS n FROM scan_base b FULL JOIN scan_head h ON b.fingerprint = h.fingerprint))""")(lambda v: L.apply_scan(v.scan_base.withColumn("status", F.expr("CASE WHEN rule = 'A' THEN 'Fixed' ELSE 'Open' END")), v.scan_head, v.scan_scope, "s2"))
query("lc_rule_alerts", "SELECT DISTINCT package_id, md5(CAST(package_id AS VARCHAR(20))) AS alert_key FROM findings WHERE severity = 'Critical' AND package_id % 3 > 0")(lambda v: L.rule_alerts(v.findings.where("severity = 'Critical'"), ["package_id"], v.packages.where("package_id % 3 = 0").select(F.md5(F.col("package_id").cast("string")).alias("alert_key"))))
query("lc_group_entries", "SELECT package_id, scan_type, count(*) AS members, min(finding_id) AS first_member, count(*) FILTER (WHERE status = 'Fixed') AS closed FROM findings GROUP BY 1, 2")(lambda v: L.group_entries(v.findings, ["package_id", "scan_type"], "finding_id"))
query("lc_route_alerts", "SELECT finding_id AS alert_id, r.route FROM findings f JOIN (VALUES ('r1', 'Critical', NULL), ('r2', NULL, 'type1'), ('r3', 'High', 'type2')) AS r(route, s, t) ON (r.s IS NULL OR r.s = f.severity) AND (r.t IS NULL OR r.t = f.scan_type)")(lambda v: L.route_alerts(v.findings.select(F.col("finding_id").alias("alert_id"), "severity", "scan_type"), v.spark.sql("SELECT * FROM VALUES ('r1', 'Critical', NULL), ('r2', NULL, 'type1'), ('r3', 'High', 'type2') AS t(route, want_severity, want_scan_type)"), ["severity", "scan_type"]))
query("lc_box_of_item", "SELECT CASE WHEN is_deleted THEN 'closed:moved' WHEN status = 'Fixed' THEN 'closed:fixed' WHEN is_false_positive THEN 'closed:false_positive' WHEN is_risk_accepted THEN 'closed:accepted' ELSE 'attention' END AS box, count(*) AS n FROM findings GROUP BY 1")(lambda v: L.box_of_item(v.findings).groupBy("box").agg(F.count("*").alias("n")))
query("lc_lower_priority", "SELECT repository_id, max(CASE WHEN package_id % 3 = 0 THEN least(rnk, 1) ELSE rnk END) AS rank, count(*) AS members FROM findings f JOIN severity_rank r ON f.severity = r.severity GROUP BY 1")(lambda v: L.lower_priority(v.findings.join(v.severity_rank, "severity"), v.packages.where("package_id % 3 = 0").selectExpr("package_id", "1 AS rank"), "package_id", "repository_id", "rnk"))
query("lc_work_queue", "SELECT package_id, scan_type, count(*) AS alerts, min(finding_id) AS first_alert FROM findings WHERE NOT (package_id % 5 = 0 AND scan_type = 'type1') GROUP BY 1, 2")(lambda v: L.work_queue(v.findings, ["package_id", "scan_type"], "finding_id", v.findings.where("package_id % 5 = 0 AND scan_type = 'type1'").select("package_id", "scan_type").distinct()))
query("lc_falls_out", "SELECT child FROM requirements GROUP BY 1 HAVING bool_and(parent % 2 = 0)")(lambda v: L.falls_out(v.requirements, v.packages.where("package_id % 2 = 0").select(F.col("package_id").alias("package"))))
query("lc_gate_landed", "SELECT package_id, CASE WHEN package_id % 5 = 0 THEN 'gone' WHEN package_id % 3 > 0 THEN 'landed' ELSE 'short' END AS verdict FROM packages")(lambda v: L.gate_landed(v.packages, v.packages.where("package_id % 5 <> 0").selectExpr("package_id", "CASE WHEN package_id % 3 > 0 THEN '10.2' ELSE '9.8' END AS version"), v.packages.selectExpr("package_id", "'10.1' AS target"), ["package_id"], S.version_key))
query("lc_gate_blast", "SELECT package_id, version AS was, CASE WHEN package_id % 4 = 0 THEN NULL WHEN package_id % 4 = 1 THEN '0.0.1' ELSE '99.0.0' END AS now, CASE WHEN package_id % 4 = 0 THEN 'removed' WHEN package_id % 4 = 1 THEN 'downgraded' ELSE 'upgraded' END AS move FROM packages")(lambda v: L.gate_blast(v.packages, v.packages.where("package_id % 4 <> 0").selectExpr("package_id", "CASE WHEN package_id % 4 = 1 THEN '0.0.1' ELSE '99.0.0' END AS version"), "package_id", S.version_key))
query("lc_provenance_verdict", "SELECT CASE WHEN x IS NULL THEN 'not_shipped' WHEN is_false_positive IS NULL THEN 'unknown' WHEN is_false_positive THEN 'vulnerable_in_shipped' ELSE 'fixed_in_shipped' END AS provenance, count(*) AS n FROM (SELECT *, nullif(package_id % 4, 0) AS x FROM findings) GROUP BY 1")(lambda v: L.provenance_verdict(v.findings.withColumn("x", F.expr("nullif(package_id % 4, 0)")), "x", "is_false_positive").groupBy("provenance").agg(F.count("*").alias("n")))

# ------------------------------------------------ texts, policy

query("tx_chunk", "SELECT doc_id, count(*) AS chunks, CAST(sum(w) AS BIGINT) AS words FROM (SELECT doc_id, least(n - s, 512) AS w FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 100, 1), 412)) AS s FROM (SELECT doc_id, len(string_split_regex(trim(text, chr(32) || chr(10) || chr(9) || chr(13)), '[ \\t\\n\\r\\f\\v]+')) AS n FROM documents))) GROUP BY 1")(lambda v: T.chunk(v.documents.withColumn("text", F.expr("trim(BOTH ' \n\t\r' FROM text)")), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("words").alias("words")))
query("tx_vector_topk", "SELECT query_id, vec_id, pos FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) DESC, v.vec_id) AS pos FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 AND list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) >= 0.0) WHERE pos <= 5")(lambda v: T.vector_topk(v.embeddings, v.embeddings.where("vec_id % 100 = 0"), 5, 0.0).select("query_id", "vec_id", "pos"))
query("tx_dim_guard", "SELECT vec_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'wrong_length' END AS rejected FROM embeddings")(lambda v: T.dim_guard(v.embeddings, "embedding", 64).select("vec_id", "rejected"))
query("tx_token_overlap", """
WITH t AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark),
s AS (SELECT q.item_id AS question_id, c.item_id AS canon_id, 1.0 * len(list_intersect(q.w, c.w)) / (len(q.w) + len(c.w) - len(list_intersect(q.w, c.w))) AS score FROM t q JOIN t c ON len(list_intersect(q.w, c.w)) > 0 AND q.item_id <> c.item_id)
SELECT item_id AS question_id, canon_id, round(score, 6) AS score, CASE WHEN canon_id IS NULL THEN 'unresolved' WHEN score - coalesce(nxt, 0) < 0.05 THEN 'ambiguous' ELSE 'resolved' END AS state
FROM benchmark LEFT JOIN (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY question_id ORDER BY score DESC, canon_id)) b
  ON b.question_id = item_id AND b.n = 1""")(lambda v: T.token_overlap(v.benchmark.selectExpr("item_id AS question_id", "text AS question"), v.benchmark.selectExpr("item_id AS canon_id", "text AS canon"), others=True))
query("tx_catalog_search", "SELECT p_partkey, 1 AS hits FROM part WHERE list_contains(string_split_regex(lower(p_type), '[^a-z0-9]+'), 'promo')")(lambda v: T.catalog_search(v.part, "p_type", ["promo"]).select("p_partkey", "hits"))
query("tx_context_block", "SELECT conv_id, string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS block FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY 1")(lambda v: T.context_block(v.conversations, "conv_id", "turn", "text", "role"))
query("po_bind_policy", "SELECT severity, count(*) AS n FROM findings WHERE severity IN ('Critical', 'High', 'Medium') GROUP BY 1")(lambda v: at_or_above(v.findings, "severity", Policy(v.policy).floor("severity_floor"), v.severity_rank).groupBy("severity").agg(F.count("*").alias("n")))
query("po_empty_list", "SELECT count(*) AS n FROM findings WHERE status IN ('Open', 'In Progress')")(lambda v: v.findings.where(Policy(v.policy).member("status", "open_statuses") & Policy(v.policy.selectExpr("'none' AS key", "'set' AS kind", "'' AS value", "'own' AS origin").distinct()).member("severity", "none")).agg(F.count("*").alias("n")))
query("po_named_value_kept", "SELECT severity, count(*) AS n, 'severity_floor=Medium' AS policy FROM findings WHERE severity IN ('Critical', 'High') GROUP BY 1")(lambda v: bound(at_or_above(v.findings, "severity", "High", v.severity_rank).groupBy("severity").agg(F.count("*").alias("n")), v.policy, ["severity_floor"]))
query("po_param_job", "SELECT severity, count(*) AS n FROM findings WHERE score > 0.3 GROUP BY 1")(lambda v: param_job(v.spark, "SELECT severity, count(*) AS n FROM {f} WHERE score > :least GROUP BY 1", {"f": v.findings}, {"least": 0.3}))
query("po_table_fn", "SELECT CAST(p_partkey AS BIGINT) AS p_partkey, unnest(range(1, p_size % 5 + 1)) AS i FROM part")(lambda v: v.part.where("p_size % 5 > 0").select("p_partkey", F.explode(F.expr("sequence(1L, CAST(p_size % 5 AS BIGINT))")).alias("i")))

# ------------------------------------------------ readers and writers, over documents that Spark makes from the tables

_SARIF = "to_json(named_struct('version', '2.1.0', 'runs', array(named_struct('tool', named_struct('driver', named_struct('name', scan_type, 'rules', array(named_struct('id', severity, 'name', severity), named_struct('id', severity, 'name', 'later')))), 'results', array(named_struct('ruleId', severity, 'level', 'error', 'message', named_struct('text', status), 'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', path), 'region', named_struct('startLine', CAST(package_id % 90 AS INT))))))))))) AS content"



def _spread(v):
    """Findings; where the table's files make fewer tasks than there are cores, spread before documents are made and parsed."""
    cores = v.spark.sparkContext.defaultParallelism
    return v.findings if v.lineitem.rdd.getNumPartitions() >= cores else v.findings.repartition(cores)


_reports = lambda v: _spread(v).selectExpr("finding_id AS doc", _SARIF)
query("src_sarif_findings", "SELECT finding_id AS doc, scan_type AS tool, severity AS rule, 'error' AS level, status AS message, path, CAST(package_id % 90 AS INT) AS line FROM findings")(lambda v: D.sarif_findings(_reports(v)).select("doc", "tool", "rule", "level", "message", "path", "line"))
query("src_sarif_rules", "SELECT finding_id AS doc, 0 AS run, severity AS rule, severity AS name FROM findings")(lambda v: D.sarif_rules(_reports(v)))
_scans = lambda v: _spread(v).selectExpr("finding_id AS doc", "to_json(named_struct('Results', array(named_struct('Target', path, 'Class', CASE WHEN package_id % 2 = 0 THEN 'lang-pkgs' ELSE 'os-pkgs' END, 'Packages', array(named_struct('Name', concat('p', package_id), 'Version', '1.0', 'Relationship', CASE WHEN package_id % 3 = 0 THEN 'direct' END)), 'Vulnerabilities', array(named_struct('VulnerabilityID', coalesce(cve_id, 'GHSA-x'), 'PkgName', concat('p', package_id), 'InstalledVersion', '1.0', 'FixedVersion', CASE WHEN package_id % 3 = 0 THEN '1.1' ELSE '' END, 'Severity', upper(severity), 'CweIDs', array('CWE-79', 'CWE-80'))))))) AS content")
query("src_scanner_vulns", "SELECT finding_id AS doc, path AS target, CASE WHEN package_id % 2 = 0 THEN 'lang-pkgs' ELSE 'os-pkgs' END AS class, coalesce(cve_id, 'GHSA-x') AS vulnerability, cve_id, concat('p', CAST(package_id AS VARCHAR(20))) AS package, '1.0' AS installed, CASE WHEN package_id % 3 = 0 THEN '1.1' END AS fixed, severity, 'CWE-79' AS cwe FROM findings")(lambda v: D.scanner_vulns(_scans(v)))
query("src_scanner_packages", "SELECT finding_id AS doc, path AS target, concat('p', CAST(package_id AS VARCHAR(20))) AS package, '1.0' AS version, CASE WHEN package_id % 3 = 0 THEN 'direct' ELSE 'unknown' END AS relationship FROM findings")(lambda v: D.scanner_packages(_scans(v)))
query("src_scan_scope", "SELECT DISTINCT finding_id AS doc, path FROM findings WHERE package_id % 2 = 0")(lambda v: D.scan_scope(_scans(v)))
_advice = lambda v: v.part.selectExpr("p_partkey AS doc", "to_json(named_struct('id', concat('A-', p_partkey), 'aliases', array(concat('CVE-', p_partkey), concat('G-', p_size)), 'severity', array(named_struct('type', 'CVSS_V3', 'score', p_type)), 'affected', array(named_struct('package', named_struct('name', p_name, 'ecosystem', p_brand), 'ranges', array(named_struct('type', 'SEMVER', 'events', array(map('introduced', '0'), map('fixed', concat(p_size, '.0')))))))) ) AS content")
query("src_advisories", "SELECT concat('A-', CAST(p_partkey AS VARCHAR(20))) AS id, p_name AS name, p_brand AS ecosystem, e, CASE WHEN e = 0 THEN '0' END AS introduced, CASE WHEN e = 1 THEN concat(CAST(p_size AS VARCHAR(20)), '.0') END AS fixed FROM part, (VALUES (0), (1)) AS t(e)")(lambda v: D.advisories(_advice(v))["ranges"].select("id", "name", "ecosystem", "e", "introduced", "fixed"))
_signals = lambda v: v.part.selectExpr("p_partkey AS doc", '''replace(to_json(named_struct('results', array(named_struct('check_id', p_type, 'path', p_name, 'start', named_struct('line', p_size), 'extra', named_struct('metadata', named_struct('confidence', 'HIGH', 'impact', p_brand, 'subcategory', array('vuln'))))), 'errors', array(named_struct('type', CASE WHEN p_size % 2 = 0 THEN 'Timeout' ELSE 'SyntaxError' END, 'path', p_name), named_struct('type', CASE WHEN p_size % 3 = 0 THEN '@' ELSE 'Other' END, 'path', p_name)), 'paths', named_struct('scanned', array(p_name, p_type)))), '"type":"@"', '"type":["PartialParsing",[{"path":"x"}]]') AS content''')
query("src_rule_signals", "SELECT p_partkey AS doc, p_type AS rule, p_name AS path, p_size AS line, 'HIGH' AS confidence, p_brand AS impact, CAST(NULL AS VARCHAR) AS likelihood, 'vuln' AS subcategory FROM part")(lambda v: D.rule_signals(_signals(v)))
query("src_scan_coverage", "SELECT p_partkey AS doc, CASE WHEN p_name = p_type THEN 1 ELSE 2 END AS scanned, CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END AS unparsed, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS partial, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS timeouts FROM part")(lambda v: D.scan_coverage(_signals(v)))
_lock = lambda v: v.part.selectExpr("p_partkey AS doc", "concat('--index-url https://x', '\n', 'a', p_size, '==1.', p_size, '\n    # via\n    #   root\n    #   b', p_size, '\nb', p_size, '==2.0\n    # via a', p_size, '\n') AS content")
query("src_lock_edges", "SELECT p_partkey AS doc, concat('a', s) AS package, 'root' AS parent, 4 AS line FROM (SELECT p_partkey, CAST(p_size AS VARCHAR(20)) AS s FROM part) UNION ALL SELECT p_partkey, concat('a', CAST(p_size AS VARCHAR(20))), concat('b', CAST(p_size AS VARCHAR(20))), 5 FROM part UNION ALL SELECT p_partkey, concat('b', CAST(p_size AS VARCHAR(20))), concat('a', CAST(p_size AS VARCHAR(20))), 7 FROM part")(lambda v: D.lock_edges(_lock(v)))
_SIZE = "CAST(p_size AS VARCHAR(20))"
_SOURCE = f"concat('import m', {_SIZE}, chr(10), 'from pkg import (', chr(10), '  a', {_SIZE}, ',', chr(10), '  b', chr(10), ')', chr(10), 'x as y as z', chr(10), 'import m', {_SIZE}, chr(10), 'ximport no', chr(10), ' from q import (c)', CASE WHEN p_size % 2 = 0 THEN concat(chr(10), 'import late') ELSE '' END)"
_LONG = f"concat('from pkg import (', chr(10), '  a', {_SIZE}, ',', chr(10), '  b', chr(10), ')')"
query("src_import_spans", f"""SELECT p_partkey AS doc, t.template, CAST(t.line AS INT) AS line, substr(t.span, 1, 24) AS span, length(t.span) > 24 AS cut FROM part, LATERAL (SELECT unnest(['import', 'from', 'from', 'alias', 'alias', 'import']) AS template, unnest([1, 2, 9, 6, 6, 10]) AS line,
    unnest([concat('import m', {_SIZE}), {_LONG}, 'from q import (c)', 'x as y', 'y as z', CASE WHEN p_size % 2 = 0 THEN 'import late' END]) AS span) t WHERE t.span IS NOT NULL""")(
    lambda v: D.import_spans(v.part.selectExpr("p_partkey AS doc", f"{_SOURCE} AS content"), {"import": r"(?m:^)import \w+", "from": r"\bfrom \w+ import \([^)]*\)", "alias": r"\b\w+ as \w+"}, 24)
)
query("src_changed_lines", "SELECT p_partkey AS doc, concat('f', CAST(p_size AS VARCHAR(20)), '.py') AS path, CAST(unnest(range(10, 10 + p_size % 4)) AS INT) AS line FROM part")(lambda v: D.changed_lines(v.part.selectExpr("p_partkey AS doc", "concat('--- a/x\n+++ b/f', p_size, '.py\n@@ -3,2 +10,', p_size % 4, ' @@\n+x\n') AS content")))
_COVERED = """CASE p_partkey % 3 WHEN 0 THEN concat('{"files": {"a.py": {"executed_lines": [', p_size, ',', p_size + 2, ']}}}')
 WHEN 1 THEN concat('{"k.js": {"path": "b.js", "statementMap": {"0": {"start": {"line": ', p_size, '}, "end": {"line": ', p_size + 1, '}}, "1": {"start": {"line": 900}, "end": {"line": 900}}}, "s": {"0": 3, "1": 0}}}')
 ELSE concat('mode: set\nm/c.go:', p_size, '.2,', p_size + 2, '.9 4 1\nm/c.go:950.1,960.2 1 0\n') END"""
query("src_covered_lines", "SELECT p_partkey AS doc, CASE p_partkey % 3 WHEN 0 THEN 'a.py' WHEN 1 THEN 'b.js' ELSE 'm/c.go' END AS path, CAST(unnest(CASE p_partkey % 3 WHEN 0 THEN [p_size, p_size + 2] WHEN 1 THEN [p_size, p_size + 1] ELSE [p_size, p_size + 1, p_size + 2] END) AS INT) AS line FROM part")(lambda v: D.covered_lines(v.part.selectExpr("p_partkey AS doc", f"{_COVERED} AS content")))
query("src_edge_documents", "SELECT s_suppkey AS doc, 'inv' AS source, concat('image:', CAST(s_suppkey AS VARCHAR(20))) AS from_key, concat('cloud:', CAST(s_nationkey AS VARCHAR(20))) AS to_key, 'deployed_as' AS edge_type, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS evidence, CASE WHEN s_suppkey % 3 = 0 THEN 'high' ELSE 'low' END AS confidence FROM supplier")(lambda v: D.edge_documents(v.supplier.selectExpr("s_suppkey AS doc", "to_json(named_struct('source', 'inv', 'edges', array(named_struct('from', concat('image:', s_suppkey), 'to', concat('cloud:', s_nationkey), 'type', 'deployed_as', 'evidence', CASE WHEN s_suppkey % 2 = 0 THEN s_name END, 'confidence', CASE WHEN s_suppkey % 3 = 0 THEN 'high' END)))) AS content")))
query("src_asset_documents", "SELECT s_suppkey AS doc, s_name AS asset_ref, 'identity' AS part, 'name' AS field, s_name AS value, CAST(NULL AS VARCHAR) AS source FROM supplier UNION ALL SELECT s_suppkey, s_name, 'governance', 'team', concat('t', CAST(s_nationkey AS VARCHAR(20))), 'form' FROM supplier UNION ALL SELECT s_suppkey, s_name, 'provenance', 'zone', NULL, concat('n', CAST(s_nationkey AS VARCHAR(20))) FROM supplier")(lambda v: D.asset_documents(v.supplier.selectExpr("s_suppkey AS doc", "to_json(named_struct('asset_ref', s_name, 'identity', map('name', s_name), 'governance', map('team', concat('t', s_nationkey)), 'field_provenance', map('team', 'form', 'zone', concat('n', s_nationkey)))) AS content")))
query("src_job_log_steps", "SELECT p_partkey AS doc, CAST(step AS BIGINT) AS step, CASE step WHEN 1 THEN p_type WHEN 2 THEN 'end' END AS name, CASE step WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 1 END AS lines, CASE step WHEN 1 THEN 1 ELSE 0 END AS errors, step = 1 AND p_size % 2 = 0 AS closed FROM part, (VALUES (0), (1), (2)) AS t(step)")(lambda v: D.job_log_steps(v.part.selectExpr("p_partkey AS doc", "concat('start\n##[group]', p_type, '\nx\n##[error]y\n', CASE WHEN p_size % 2 = 0 THEN '##[endgroup]' ELSE 'z' END, '\n##[group]end') AS content")))


@query("snk_report_document", "SELECT scan_type, severity AS rule, path, count(*) AS n FROM findings GROUP BY 1, 2, 3")
def _(v):
    made = K.report_document(v.findings.withColumn("scan", F.lit(1)), "scan", "scan_type", "severity", ["finding_id"], ["path"], 500)
    back = D.each(made, F.from_json("content", "struct<runs: array<struct<results: array<struct<ruleId: string, path: string>>>>>")["runs"], "r", "scan_type")
    return D.each(back, "r.results", "x", "scan_type").groupBy("scan_type", F.col("x.ruleId").alias("rule"), F.col("x.path").alias("path")).agg(F.count("*").alias("n"))


query("snk_keyed_upsert", "SELECT coalesce(h.fingerprint, b.fingerprint) AS fingerprint, coalesce(h.path, b.path) AS path, CASE WHEN h.fingerprint IS NULL THEN b.rule = 'A' ELSE false END AS is_deleted FROM scan_base b FULL JOIN scan_head h ON b.fingerprint = h.fingerprint")(lambda v: K.keyed_upsert(v.scan_base.selectExpr("fingerprint", "path", "rule = 'A' AS is_deleted"), v.scan_head.selectExpr("fingerprint", "path", "false AS is_deleted"), ["fingerprint"], "path"))


@query("snk_materialize", "SELECT severity, count(*) AS n FROM findings GROUP BY 1")
def _(v):
    import uuid

    path = f"{G.shared_dir(v.spark)}/job-{uuid.uuid4().hex}"
    K.materialize(v.findings.groupBy("severity").agg(F.count("*").alias("n")), path)
    return v.spark.read.parquet(path)


@query("snk_two_grain_export", "SELECT severity, status, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY severity) AS BIGINT) AS total FROM findings GROUP BY 1, 2")
def _(v):
    import uuid

    path = f"{G.shared_dir(v.spark)}/export-{uuid.uuid4().hex}"
    fine = v.findings.groupBy("severity", "status").agg(F.count("*").alias("n"))
    K.two_grain_export(fine, fine.groupBy("severity").agg(F.sum("n").alias("total")), path)
    return v.spark.read.parquet(f"{path}/fine").join(v.spark.read.parquet(f"{path}/coarse"), "severity").select("severity", "status", "n", "total")


query("snk_quarantine", "SELECT finding_id, concat_ws(',', CASE WHEN cve_id IS NULL THEN 'no_cve' END, CASE WHEN NOT score > 0.2 THEN 'low_score' END) AS reasons FROM findings WHERE cve_id IS NULL OR NOT score > 0.2")(lambda v: K.quarantine(v.findings, {"no_cve": F.col("cve_id").isNotNull(), "low_score": F.col("score") > 0.2})[1].select("finding_id", "reasons"))

# ------------------------------------------------ streams, run over all rows that are there

_events = lambda v: X.stream_table(v.spark, f"{v.sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
query("st_tumbling_counts", "SELECT date_trunc('day', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")(lambda v: X.run_to_end(X.tumbling_counts(_events(v), "ts", "event_type"), "complete"))
query("st_sliding_failures", "SELECT start, user_id, count(*) AS failures FROM (SELECT user_id, to_timestamp(epoch(time_bucket(INTERVAL '3 hours', CAST(ts AS TIMESTAMP))) - o * 10800)::TIMESTAMP AS start FROM events, (VALUES (0), (1)) AS t(o) WHERE event_type = 'error') GROUP BY 1, 2")(lambda v: X.run_to_end(X.sliding_failures(_events(v).where("event_type = 'error'"), "ts", "user_id"), "complete"))
query("st_session_folding", "SELECT min(ts) AS start, max(ts) + INTERVAL '30' MINUTE AS \"end\", user_id, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS c FROM audit)) GROUP BY user_id, g")(lambda v: X.session_folding(v.audit, "ts", "user_id"))
query("st_stream_static_enrich", "SELECT e.event_id, c.c_mktsegment AS segment FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey")(lambda v: X.run_to_end(X.static_enrich(_events(v).select("event_id", "user_id"), v.customer.selectExpr("c_custkey AS user_id", "c_mktsegment AS segment"), "user_id")).select("event_id", "segment"))

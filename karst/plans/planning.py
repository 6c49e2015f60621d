"""Queries of fix planning and usage verdicts, over relations that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VIEWS
from ..functions import scalars as S
from ..operators import graphs as G
from ..operators import planning as N
from .registry import query

_ABC = "CAST(split_part(version, '.', 1) AS INT) AS a, CAST(split_part(version, '.', 2) AS INT) AS b"
_SPEC = "CASE package_id % 7 WHEN 0 THEN '>=10.0,<30' WHEN 1 THEN '^7.2' WHEN 2 THEN 'git+https://x/y' WHEN 3 THEN '~=20.1' WHEN 4 THEN '*' WHEN 5 THEN '12.* || >40' ELSE '!=9.1' END"
_ADMITS = "CASE package_id % 7 WHEN 0 THEN a >= 10 AND a < 30 WHEN 1 THEN a = 7 AND b >= 2 WHEN 2 THEN NULL WHEN 3 THEN a = 20 AND b >= 1 WHEN 4 THEN true WHEN 5 THEN a = 12 OR version_above ELSE NOT plain9 END"
_ADMITTED = f"SELECT package_id, {_ADMITS} AS admitted FROM (SELECT *, a > 40 OR (a = 40 AND (b > 0 OR CAST(split_part(version, '.', 3) AS INT) > 0)) AS version_above, version = '9.1.0' AS plain9 FROM (SELECT *, {_ABC} FROM packages))"
query("fn_admits", _ADMITTED)(lambda v: v.packages.select("package_id", N.admits(F.col("version"), F.expr(_SPEC)).alias("admitted")))
query("join_advisory_range", f"SELECT package_id, concat('A', CAST(package_id AS VARCHAR(20))) AS advisory, CASE WHEN package_id % 3 = 0 THEN a < 20 WHEN package_id % 3 = 1 THEN a >= 5 AND a < 30 ELSE a >= 10 END AS affected FROM (SELECT *, {_ABC} FROM packages)")(
    lambda v: N.advisory_range(v.packages.withColumn("name", F.concat("name", "package_id")), v.packages.selectExpr("ecosystem", "concat(name, package_id) AS name", "concat('A', package_id) AS advisory", "CASE package_id % 3 WHEN 0 THEN '0' WHEN 1 THEN '5.0.0' ELSE '10.0.0' END AS introduced", "CASE package_id % 3 WHEN 0 THEN '20.0.0' WHEN 1 THEN '30.0.0' END AS fixed", "CAST(NULL AS STRING) AS last_affected"), S.semver_key)
)
query("join_nearest_scope", "SELECT p_partkey AS dependent, 'lib' AS name, CASE WHEN p_size % 2 = 0 THEN 'deep' ELSE 'root' END AS version, CASE WHEN p_size % 2 = 0 THEN 2 ELSE 1 END AS depth FROM part")(
    lambda v: N.nearest_scope(v.part.selectExpr("p_partkey AS dependent", "concat('app/', p_size, '/x') AS path", "'lib' AS name"), v.part.where("p_size % 2 = 0").selectExpr("concat('app/', p_size) AS scope", "'lib' AS name", "'deep' AS version").distinct().union(v.part.selectExpr("'app' AS scope", "'lib' AS name", "'root' AS version").distinct()))
)
query("fn_cvss_source_pick", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'nvd' ELSE 'vendor' END AS source, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 5 END AS score FROM part")(
    lambda v: v.part.select("p_partkey", N.cvss_source_pick(F.expr("array(named_struct('source', 'vendor', 'score', 5, 'vector', 'v'), named_struct('source', 'nvd', 'score', CASE WHEN p_size % 2 = 0 THEN p_size END, 'vector', 'n'))"), ["nvd", "ghsa"]).alias("x")).select("p_partkey", "x.source", "x.score")
)
query("fn_exploit_maturity", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'known_exploited' WHEN p_size % 2 = 0 THEN 'proof_of_concept' ELSE 'none' END AS maturity FROM part")(
    lambda v: v.part.select("p_partkey", N.exploit_maturity(F.expr("CASE WHEN p_size % 3 = 0 THEN true WHEN p_size % 5 = 0 THEN NULL ELSE false END"), F.expr("array('https://a', CASE WHEN p_size % 2 = 0 THEN 'https://www.exploit-db.com/1' END)")).alias("maturity"))
)
query("fn_rule_id_normalise", "SELECT p_partkey, concat('rule.', p_type) AS rule FROM part")(lambda v: v.part.select("p_partkey", N.rule_id_normalise(F.expr("CASE WHEN p_size % 2 = 0 THEN concat('tmp.rules.rule.', p_type) ELSE concat('rule.', p_type) END"), F.lit("tmp.rules")).alias("rule")))

_USED = "CASE WHEN p_size % 5 = 0 THEN 'reachable' WHEN p_size % 5 = 1 THEN 'build_only' WHEN p_partkey % 4 = 0 THEN 'imported_transitively' WHEN p_partkey % 4 = 1 THEN 'inconclusive' ELSE 'not_imported' END"
query("gr_import_verdict", f"SELECT p_partkey AS package, {_USED} AS verdict FROM part")(
    lambda v: N.import_verdict(v.part.selectExpr("p_partkey AS package"), v.part.where("p_size % 5 < 2").selectExpr("p_partkey AS package", "p_size % 5 = 0 AS runtime").union(v.part.limit(1).selectExpr("-1L AS package", "true AS runtime")), v.part.where("p_partkey % 4 = 0").selectExpr("p_partkey AS package", "-1L AS parent"), v.part.where("p_partkey % 4 = 1").selectExpr("p_partkey AS package"))
)
query("gr_code_verdict", "SELECT path, CASE WHEN c = 0 THEN 'inconclusive' WHEN l IS NOT NULL THEN 'reachable' ELSE 'no_path' END AS verdict, l AS level FROM (SELECT concat('f', CAST(p_size AS VARCHAR(20))) AS path, count(*) FILTER (WHERE p_partkey % 3 > 0) AS c, min(CASE WHEN p_partkey % 30 = 1 THEN CAST(p_partkey % 4 AS INT) END) AS l FROM part GROUP BY 1)")(
    lambda v: N.code_verdict(v.part.selectExpr("concat('f', p_size) AS path"), v.part.where("p_partkey % 3 > 0").selectExpr("concat('f', p_size) AS path", "p_partkey AS node"), v.part.where("p_partkey % 30 = 1").selectExpr("p_partkey AS node", "CAST(p_partkey % 4 AS INT) AS level", "true AS certain"), True)
)
query("gr_certainty", "SELECT package_id, concat_ws(',', CASE WHEN package_id % 2 > 0 THEN 'graph' END, CASE WHEN package_id % 3 > 0 THEN 'entries' END) AS unmet, CASE WHEN package_id % 6 = 0 THEN 'known' ELSE 'unknown' END AS certainty FROM packages")(lambda v: N.certainty(v.packages.select("package_id"), {"graph": F.expr("package_id % 2 = 0"), "entries": F.expr("package_id % 3 = 0")}))
query("gr_library_kind", "SELECT p_partkey AS module, CASE WHEN p_partkey % 2 = 0 THEN 'own_file' WHEN p_partkey % 3 = 0 THEN 'built_in' WHEN p_partkey % 5 = 0 THEN 'ours' ELSE 'third_party' END AS kind FROM part")(lambda v: N.library_kind(v.part.selectExpr("p_partkey AS module"), *(v.part.where(f"p_partkey % {k} = 0").selectExpr("p_partkey AS module") for k in (2, 3, 5))))
query("gr_reached_through", "SELECT DISTINCT child AS package, parent AS through FROM requirements WHERE parent % 3 = 0")(lambda v: N.reached_through(v.requirements.selectExpr("child AS package", "parent"), v.part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS package")))
_TREE = ("WITH RECURSIVE r(node, d) AS (SELECT package_id, 0 FROM ({seeds}) UNION SELECT q.parent, r.d + 1 FROM r JOIN (SELECT p_partkey AS child, CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM part WHERE p_partkey > 1) q ON q.child = r.node WHERE r.d < 3)").format(seeds=f"SELECT package_id FROM ({VIEWS['packages']}) WHERE is_deleted")
_walk = lambda v: G.reach(v.part.where("p_partkey > 1").selectExpr("p_partkey AS from_key", "CAST(floor(p_partkey / 2) AS BIGINT) AS to_key"), v.packages.where("is_deleted").select(F.col("package_id").alias("node")), 3)
_INSTALLS = "SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst, 'lock' AS kind FROM {part} WHERE p_partkey > 1 UNION ALL SELECT p_partkey, p_partkey + 1, 'wheel' FROM {part} WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, CAST(floor(p_partkey / 2) AS BIGINT), 'wheel' FROM {part} WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, p_partkey + 1000000, 'lock' FROM {part} WHERE p_partkey % 4 = 0"
query("gr_install_walk", f"""WITH RECURSIVE x AS (SELECT DISTINCT src, dst FROM ({_INSTALLS.format(part='part')})), t AS (SELECT p_partkey AS tree FROM part WHERE p_partkey % 10 <> 7),
o AS (SELECT src, list(dst ORDER BY dst) FILTER (WHERE dst IN (SELECT tree FROM t)) AS inside, list(dst ORDER BY dst) FILTER (WHERE dst NOT IN (SELECT tree FROM t)) AS outside FROM x GROUP BY 1),
w AS (SELECT package_id AS prim, [package_id] AS ord, [0] AS deps, 0 AS i, CAST([] AS BIGINT[]) AS lost, CAST([] AS BIGINT[]) AS gone FROM ({VIEWS['packages']}) WHERE is_deleted
    UNION ALL SELECT prim, list_concat(ord, fresh[1:9 - len(ord)]), list_concat(deps, [deps[i + 1] + 1 FOR y IN fresh[1:9 - len(ord)]]), i + 1, fresh[10 - len(ord):], outs FROM (
        SELECT w.prim, w.ord, w.deps, w.i, [y FOR y IN coalesce(o.inside, []) IF NOT list_contains(w.ord, y)] AS fresh, [y FOR y IN coalesce(o.outside, []) IF NOT list_contains(w.ord, y)] AS outs FROM w LEFT JOIN o ON o.src = w.ord[w.i + 1] WHERE w.i < len(w.ord))),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY prim ORDER BY i DESC) = 1)
SELECT prim AS primary, unnest(ord) AS tree, CAST(unnest(range(len(ord))) AS INT) AS pos, CAST(unnest(deps) AS INT) AS depth, CAST(NULL AS BIGINT) AS via, CAST(NULL AS VARCHAR) AS why FROM e
UNION ALL SELECT prim, unnest(lost), NULL, deps[i] + 1, ord[i], 'cap' FROM w WHERE len(lost) > 0 UNION ALL SELECT prim, unnest(gone), NULL, deps[i] + 1, ord[i], 'not loaded' FROM w WHERE len(gone) > 0
""".replace("prim AS primary", 'prim AS "primary"'))(lambda v: G.install_walk(v.spark.sql(_INSTALLS, part=v.part), v.part.where("p_partkey % 10 <> 7").selectExpr("p_partkey AS tree"), v.packages.where("is_deleted").selectExpr("package_id AS tree"), 9))
query("gr_pins_on_path", f"{_TREE} SELECT p_partkey AS tree, CASE WHEN p_size % 2 = 0 THEN '==1.0' ELSE '>=1' END AS spec, CASE WHEN d IS NULL THEN 'ignored:not_reached' WHEN d = 0 THEN 'source' WHEN p_size % 2 = 0 THEN 'ships' ELSE 'request' END AS role FROM part LEFT JOIN (SELECT node, min(d) AS d FROM r GROUP BY 1) w ON p_partkey = w.node")(lambda v: N.pins_on_path(_walk(v), v.part.selectExpr("p_partkey AS tree", "CASE WHEN p_size % 2 = 0 THEN '==1.0' ELSE '>=1' END AS spec")))
query("gr_must_move", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'member' WHEN 1 THEN 'fine' WHEN 2 THEN 'undecidable' ELSE 'fine' END AS move FROM part")(lambda v: N.must_move(v.part.selectExpr("p_partkey", "CASE p_size % 4 WHEN 0 THEN '==1.0' WHEN 1 THEN '>=1,<3' WHEN 2 THEN 'workspace:*' ELSE '^2.0' END AS spec"), F.lit("2.5")).select("p_partkey", "move"))

query("dq_reach_lens", "SELECT count(*) AS \"all\", count(*) FILTER (WHERE p_size % 2 = 0) AS platform, count(*) FILTER (WHERE p_size % 6 = 0) AS tenant, count(*) FILTER (WHERE p_size % 6 = 0 AND p_partkey % 3 > 0) AS lit, count(*) FILTER (WHERE p_size % 6 = 0 AND p_partkey % 3 = 0) AS dark FROM part")(lambda v: N.reach_lens(v.part.selectExpr("p_size % 2 = 0 AS platform", "p_size % 3 = 0 AS tenant", "p_partkey % 3 AS filled")))
query("dq_answerable", "SELECT p_size AS question, CASE WHEN bool_or(p_partkey % 4 = 0 AND p_partkey % 3 = 0) THEN 'blocked' WHEN bool_or(p_partkey % 7 = 0 AND p_partkey % 4 > 0) THEN 'unknown' WHEN bool_or(p_partkey % 4 = 0) THEN 'partial' ELSE 'yes' END AS state FROM part GROUP BY 1")(lambda v: N.answerable(v.part.selectExpr("p_size AS question", "p_partkey AS column_name", "CASE WHEN p_partkey % 3 = 0 THEN 'filter' ELSE 'show' END AS use"), v.part.where("p_partkey % 7 > 0 OR p_partkey % 4 = 0").selectExpr("p_partkey AS column_name", "CASE WHEN p_partkey % 4 = 0 THEN 'failing' ELSE 'supplied' END AS supply")))
query("dq_lock_provenance", "SELECT p_size AS lock, CASE WHEN bool_or(p_partkey % 5 = 0) THEN 'used' WHEN bool_and(p_partkey % 5 > 1) THEN 'not_used' ELSE 'unknown' END AS provenance FROM part GROUP BY 1")(lambda v: N.lock_provenance(v.part.selectExpr("p_size AS lock", "CASE p_partkey % 5 WHEN 0 THEN 'RUN npm ci' WHEN 1 THEN 'RUN make' ELSE 'RUN npm install' END AS text")))
query("dq_diff_coverage", "SELECT path, CASE WHEN s % 4 = 0 THEN 'no_suite' WHEN u > 0 THEN 'uncovered' ELSE 'covered' END AS state, c AS covered, u AS uncovered FROM (SELECT concat('f', CAST(p_size AS VARCHAR(20))) AS path, min(p_size) AS s, count(*) FILTER (WHERE p_partkey % 2 = 0) AS c, count(*) FILTER (WHERE p_partkey % 2 > 0) AS u FROM part GROUP BY 1)")(lambda v: N.diff_coverage(v.part.selectExpr("concat('f', p_size) AS path", "p_partkey AS line"), v.part.where("p_partkey % 2 = 0").selectExpr("concat('f', p_size) AS path", "p_partkey AS line"), v.part.where("p_size % 4 > 0").selectExpr("concat('f', p_size) AS path")))

query("lc_fix_status", "SELECT CASE WHEN package_id % 5 = 0 THEN 'dismissed' WHEN fixed_at IS NULL THEN 'unavailable' WHEN first_detected + INTERVAL '20' DAY <= fixed_at THEN 'waiting' WHEN asset_id % 2 = 0 THEN 'still_reported' ELSE 'cleared' END AS fix_status, count(*) AS n FROM findings GROUP BY 1")(lambda v: N.fix_status(v.findings.selectExpr("fixed_at AS merged", "first_detected + INTERVAL '20' DAY AS scanned", "asset_id % 2 = 0 AS reported", "package_id % 5 = 0 AS dismissed")).groupBy("fix_status").agg(F.count("*").alias("n")))
query("lc_runtime_stale", "SELECT finding_id, asset_id NOT IN (SELECT asset_id FROM assets WHERE environment = 'prod') AS stale FROM findings")(lambda v: N.runtime_stale(v.findings, v.assets.where("environment = 'prod'"), "asset_id").select("finding_id", "stale"))
query("lc_classify_fix", "SELECT p_partkey AS package_id, CASE WHEN p_partkey % 5 = 0 THEN 'declined:no_target' WHEN p_size % 4 = 0 THEN 'not_declared' WHEN p_size % 4 = 1 THEN 'declined:unreadable' WHEN p_size % 4 = 2 THEN 'lock_only' ELSE 'edit_declaration' END AS verdict FROM part")(lambda v: N.classify_fix(v.part.selectExpr("p_partkey AS package_id", "CASE WHEN p_partkey % 5 > 0 THEN '2.5' END AS target"), v.part.where("p_size % 4 > 0").selectExpr("p_partkey AS package_id", "CASE p_size % 4 WHEN 1 THEN 'file:../x' WHEN 2 THEN '>=2' ELSE '<2' END AS spec")))
query("lc_parents_admit", "SELECT p_partkey AS package_id, CASE WHEN p_size % 3 = 0 THEN false WHEN p_size % 3 = 1 THEN NULL ELSE true END AS admitted, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS refusing FROM part")(lambda v: N.parents_admit(v.part.selectExpr("p_partkey AS package_id", "'2.5' AS target"), v.part.selectExpr("p_partkey AS package_id", "explode(array('>=1', CASE p_size % 3 WHEN 0 THEN '<2' WHEN 1 THEN 'link:x' ELSE '^2' END)) AS spec")))
query("lc_runtime_floor", "SELECT p_partkey, p_size % 3 = 0 AS refused FROM part")(lambda v: N.runtime_floor(v.part.selectExpr("p_partkey", "CASE p_size % 3 WHEN 0 THEN '>=3.9' WHEN 1 THEN 'any of them' ELSE '>=3.7,<4' END AS req"), F.lit("3.8"), "req").select("p_partkey", "refused"))
query("lc_explain_move", "SELECT p_partkey AS package_id, CASE WHEN p_partkey % 3 = 0 THEN 'pinned' WHEN p_partkey % 2 = 0 THEN 'newly_capped' ELSE 'needed' END AS why FROM part")(lambda v: N.explain_move(v.part.selectExpr("p_partkey AS package_id"), v.part.where("p_partkey % 3 = 0").selectExpr("p_partkey AS package_id"), v.part.where("p_partkey % 2 = 0").selectExpr("p_partkey AS package_id")))
query("lc_scope_check", "SELECT c_custkey AS repository_id, 'p' AS path, CASE WHEN c_custkey % 3 = 0 THEN 'stale' WHEN c_custkey % 2 = 0 THEN 'in_plan' ELSE 'out_of_scope' END AS state FROM customer")(lambda v: N.scope_check(*(v.customer.where(w).selectExpr("c_custkey AS repository_id", "'p' AS path") for w in ("true", "c_custkey % 2 = 0", "c_custkey % 3 > 0"))))
# twelve ways in which a declaration changed, by symbol; some symbols are new and some are gone
_P = "named_struct('name', '{}', 'kind', '{}', 'default', CAST({} AS STRING), 'type', '{}')"
_FIRST, _NONE = _P.format("a", "pos", "NULL", "int"), "CAST(NULL AS array<struct<name:string,kind:string,default:string,type:string>>)"
_case = lambda ways, default: "CASE p_size % 12 " + " ".join(f"WHEN {i} THEN {x}" for i, x in ways.items()) + f" ELSE {default} END"
_list = lambda *p: f"array({_FIRST}, {_P.format(*p)})"
_DECLARED = {
    "old": {
        "params": _case({5: _list("b", "pos", "'1'", "Optional[int]"), **dict.fromkeys((6, 7, 8, 9, 10), _NONE)}, _list("b", "pos", "'1'", "int")),
        "bases": _case({6: "array('Base', 'typing.Generic[T]')", 7: "array('List[int]')", 8: "array('Base')"}, "CAST(NULL AS array<string>)"),
        "value": _case({9: "'Dict[str, int]'"}, "CAST(NULL AS STRING)"),
        "kind": _case({6: "'class'", 7: "'class'", 8: "'class'", 9: "'attribute'", 11: "CAST(NULL AS STRING)"}, "'function'"),
    },
    "new": {
        "params": _case({0: _list("c", "pos", "'1'", "int"), 1: _list("b", "kw", "'1'", "int"), 2: _list("b", "pos", "'2'", "int"), 3: _list("b", "pos", "'1'", "str"), 5: _list("b", "pos", "'1'", "int | None"), **dict.fromkeys((6, 7, 8, 9, 11), _NONE)}, _list("b", "pos", "'1'", "int")),
        "bases": _case({6: "array('Base')", 7: "array('list[int]')", 11: "array('Base')"}, "CAST(NULL AS array<string>)"),
        "value": _case({8: "'Base'", 9: "'dict[str, str]'"}, "CAST(NULL AS STRING)"),
        "kind": _case({6: "'class'", 7: "'class'", 8: "'attribute'", 9: "'attribute'", 11: "CAST(NULL AS STRING)"}, "'function'"),
    },
}
_declared = lambda v, side, absent: v.part.where(f"p_partkey % 11 <> {absent}").selectExpr("p_partkey AS symbol", *(f"{e} AS {c}" for c, e in _DECLARED[side].items()))
query("lc_signature_change", """SELECT p_partkey AS symbol, CASE WHEN p_partkey % 11 = 1 THEN 'added' WHEN p_partkey % 11 = 2 THEN 'removed' ELSE CASE p_size % 12 WHEN 0 THEN 'params_changed' WHEN 1 THEN 'kind_changed' WHEN 2 THEN 'default_changed' WHEN 3 THEN 'annotation_only'
    WHEN 4 THEN 'identical' WHEN 5 THEN 'annotation_only' WHEN 6 THEN 'bases_changed' WHEN 7 THEN 'identical' WHEN 8 THEN 'became_other' WHEN 9 THEN 'value_changed' ELSE 'opaque' END END AS change,
    CASE WHEN p_size % 12 = 0 AND p_partkey % 11 NOT IN (1, 2) THEN 1 ELSE 0 END AS removed_params FROM part""")(lambda v: N.signature_change(_declared(v, "old", 1), _declared(v, "new", 2)).select("symbol", "change", "removed_params"))

# of a(first, second=1, third=2): eight ways in which it changed, by symbol; one symbol in ten has no facts
_A, _B, _C, _D = _P.format("first", "pos", "NULL", "int"), _P.format("second", "pos", "'1'", "int"), _P.format("third", "pos", "'2'", "int"), _P.format("extra", "pos", "'0'", "int")
_AFTER = [
    f"array({_A}, {_B}, {_C})",
    f"array({_A}, {_D}, {_B}, {_C})",
    f"array({_A}, {_C})",
    f"array({_A}, {_B}, {_P.format('third', 'kw', chr(39) + '2' + chr(39), 'int')})",
    f"array({_A}, {_P.format('second', 'pos', chr(39) + '7' + chr(39), 'int')}, {_C})",
    f"array({_A}, {_B}, {_P.format('third', 'pos', chr(39) + '2' + chr(39), 'str')}, {_D})",
    f"array({_A}, {_P.format('second', 'pos', 'NULL', 'int')}, {_C})",
    f"array({_A}, {_B}, {_C}, {_P.format('extra', 'pos', 'NULL', 'int')})",
]
_CALLS = "SELECT p_size, p_size % 8 AS way, p_partkey % 4 AS n, CASE WHEN p_partkey % 5 = 1 THEN 'second' WHEN p_partkey % 5 = 2 THEN 'third' ELSE 'other' END AS k, p_partkey % 7 = 0 AS spread, p_partkey % 6 = 5 AS kwspread FROM part WHERE {}"
# calls of a symbol are judged together, so calls are kept apart by what they pass
_CALL_ID = "p_size * 1000 + p_partkey % 420"
query("lc_call_safety", f"""SELECT symbol, CASE max(CASE WHEN p_size % 10 = 0 THEN 1 WHEN way IN (0, 5) THEN 0 WHEN spread THEN 1 WHEN way = 7 THEN 2 WHEN way = 4 THEN 1 WHEN way = 6 THEN CASE WHEN k = 'second' OR n > 1 THEN 0 WHEN kwspread THEN 1 ELSE 2 END WHEN way = 2 AND kwspread AND k <> 'second' THEN 1
    WHEN (way = 1 AND n > 1) OR (way = 2 AND (n > 1 OR k = 'second')) OR (way = 3 AND n > 2) THEN 2 ELSE 0 END) WHEN 2 THEN 'breaks' WHEN 1 THEN 'unknown' ELSE 'safe' END AS safety, count(*) AS calls
    FROM (SELECT *, {_CALL_ID} AS symbol FROM part JOIN ({_CALLS.format('true').replace('SELECT p_size,', 'SELECT p_partkey,')}) USING (p_partkey)) GROUP BY 1""")(
    lambda v: N.call_safety(
        v.part.selectExpr(f"{_CALL_ID} AS symbol", "CAST(p_partkey % 4 AS INT) AS positional", "array(CASE WHEN p_partkey % 5 = 1 THEN 'second' WHEN p_partkey % 5 = 2 THEN 'third' ELSE 'other' END) AS keywords", "p_partkey % 7 = 0 AS spread", "p_partkey % 6 = 5 AS kwspread"),
        N.signature_change(*(v.part.where("p_size % 10 > 0").selectExpr(f"{_CALL_ID} AS symbol", "p_size").dropDuplicates(["symbol"]).selectExpr("symbol", f"{e} AS params") for e in (_AFTER[0], "CASE p_size % 8 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_AFTER)) + " END"))),
    )
)
query("lc_api_touch", "SELECT p_partkey AS package_id, CASE WHEN p_size % 2 = 0 AND p_size % 3 > 0 THEN '4' ELSE '3' END AS verdict, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS sites FROM part")(lambda v: N.api_touch(v.part.selectExpr("p_partkey AS package_id", "'pkg.f' AS symbol", "CASE WHEN p_size % 3 = 0 THEN 'annotation_only' ELSE 'removed' END AS kind"), v.part.where("p_size % 2 = 0").selectExpr("p_partkey AS package_id", "CASE WHEN p_partkey % 2 = 0 THEN 'alias.f' ELSE 'pkg.f' END AS symbol"), v.spark.sql("SELECT 'alias.f' AS symbol, 'pkg.f' AS canonical"), True))
query("lc_weak_answer", "SELECT package_id, path, greatest(n - 10, 0) AS more FROM (SELECT l_partkey AS package_id, concat('p', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_shipdate AS VARCHAR)) AS path, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY concat('p', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_shipdate AS VARCHAR))) AS r FROM lineitem WHERE l_linenumber % 2 = 0 AND l_partkey % 3 = 0) WHERE r <= 10")(lambda v: N.weak_answer(v.part.selectExpr("p_partkey AS package_id", "CASE WHEN p_partkey % 3 = 0 THEN 'not_imported' ELSE 'imported' END AS answer"), v.lineitem.selectExpr("l_partkey AS package_id", "concat('p', l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', CAST(l_shipdate AS STRING)) AS path", "CASE WHEN l_linenumber % 2 = 0 THEN 'm = importlib(x)' ELSE 'import x' END AS text")))
query("tx_cited_check", "SELECT p_partkey AS sentence_id, p_partkey % 3 = 1 AND (p_partkey + 3) IN (SELECT p_partkey FROM part) AS holds FROM part")(lambda v: N.cited_check(v.part.selectExpr("p_partkey AS sentence_id", "array(p_partkey, p_partkey + 3) AS cites"), v.part.selectExpr("p_partkey AS claim", "CASE WHEN p_partkey % 3 = 1 THEN 'unchanged' ELSE 'changed' END AS state")))

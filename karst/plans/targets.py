"""Queries of version targets, version keys and type spellings, over fixtures that reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.types import canonical_type
from ..operators.targets import Targets
from .registry import query


def _number(c: str) -> str:
    """A version of three numbers, with or without -rcN, as one number; NULL for others."""
    part = lambda i: f"CAST(split_part(split_part({c}, '-', 1), '.', {i}) AS BIGINT)"
    return f"CASE WHEN regexp_matches({c}, '^[0-9]+[.][0-9]+[.][0-9]+(-rc[0-9])?$') THEN {part(1)} * 10000000 + {part(2)} * 10000 + {part(3)} * 10 + CASE WHEN contains({c}, '-') THEN 0 ELSE 1 END END"


_TARGETS = f"""
spans AS (SELECT name, advisory, CASE WHEN bad THEN 0 ELSE lo END AS lo, CASE WHEN bad THEN 9e15 ELSE hi END AS hi, fixed, fix FROM (SELECT *, lo IS NULL OR hi IS NULL AS bad FROM (
    SELECT name, advisory, fixed, {_number("fixed")} AS fix, CASE WHEN introduced = '0' THEN 0 ELSE {_number("introduced")} END AS lo,
           CASE WHEN fixed IS NOT NULL THEN {_number("fixed")} WHEN last_affected IS NOT NULL THEN {_number("last_affected")} + 1 ELSE 9e15 END AS hi FROM target_spans))),
packs AS (SELECT *, {_number("installed")} AS have, {_number("scanner_target")} AS aim, split_part(installed, '.', 1) AS line FROM target_packages),
relevant AS (SELECT DISTINCT p.package_id, p.name, p.have, p.line, s.advisory FROM packs p JOIN spans s ON s.name = p.name AND s.lo <= p.have AND p.have < s.hi WHERE scanner_target IS NOT NULL),
held AS (SELECT r.package_id, s.lo, s.hi FROM relevant r JOIN spans s ON s.name = r.name AND s.advisory = r.advisory),
pool AS (SELECT r.package_id, r.have, r.line, s.fixed AS version, s.fix AS no FROM relevant r JOIN spans s ON s.name = r.name AND s.advisory = r.advisory
    UNION SELECT r.package_id, r.have, r.line, p.scanner_target, p.aim FROM relevant r JOIN packs p USING (package_id)),
clean AS (SELECT * FROM pool p WHERE no > have AND NOT contains(version, '-') AND NOT EXISTS (SELECT 1 FROM held h WHERE h.package_id = p.package_id AND h.lo <= p.no AND p.no < h.hi)),
pick AS (SELECT *, split_part(version, '.', 1) AS to_line, split_part(version, '.', 1) <> line AS off FROM clean
    QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY split_part(version, '.', 1) <> line, no) = 1)
"""

query("lc_target_line", f"""WITH {_TARGETS},
ids AS (SELECT package_id, string_agg(advisory, ',' ORDER BY advisory) AS advisories FROM relevant GROUP BY 1)
SELECT p.package_id, coalesce(k.version, p.scanner_target) AS target, CASE WHEN k.no IS NULL THEN 'unknown' ELSE 'measured' END AS basis, coalesce(k.to_line, split_part(p.scanner_target, '.', 1)) AS target_line,
       coalesce(k.off, split_part(p.scanner_target, '.', 1) <> p.line, false) AS major_jump, CASE WHEN k.no IS NULL THEN '' ELSE i.advisories END AS advisories
FROM packs p LEFT JOIN pick k USING (package_id) LEFT JOIN ids i USING (package_id)
""")(lambda v: Targets(v.target_packages, v.target_spans, S.semver_key).target_line().withColumn("advisories", F.array_join("advisories", ",")))

query("lc_clean_target", f"""WITH RECURSIVE {_TARGETS},
ways AS (SELECT k.package_id, p.name, k.no AS first, k.to_line, k.have FROM pick k JOIN packs p USING (package_id)),
places AS (SELECT DISTINCT w.package_id, w.name, s.fix AS no, s.fixed AS version FROM ways w JOIN spans s ON s.name = w.name WHERE s.fix IS NOT NULL UNION SELECT package_id, name, first, version FROM ways JOIN pick USING (package_id)
    UNION SELECT w.package_id, w.name, p.aim, p.scanner_target FROM ways w JOIN packs p USING (package_id)),
fit AS (SELECT p.* FROM places p JOIN ways w USING (package_id) WHERE p.no > w.have AND NOT contains(version, '-') AND split_part(version, '.', 1) = w.to_line
    AND NOT EXISTS (SELECT 1 FROM held h WHERE h.package_id = p.package_id AND h.lo <= p.no AND p.no < h.hi)),
open_ AS (SELECT DISTINCT f.package_id, f.name, f.no, s.advisory FROM fit f JOIN spans s ON s.name = f.name AND s.lo <= f.no AND f.no < s.hi),
brings AS (SELECT o.package_id, o.no, list(DISTINCT x.no) FILTER (WHERE x.no > o.no) AS more FROM open_ o JOIN spans s ON s.name = o.name AND s.advisory = o.advisory LEFT JOIN fit x ON x.package_id = o.package_id AND x.no = s.fix GROUP BY 1, 2),
told AS (SELECT package_id, no, string_agg(advisory, ',' ORDER BY advisory) AS advisories FROM open_ GROUP BY 1, 2),
base AS (SELECT w.package_id, list(DISTINCT c.no) AS cands FROM ways w JOIN clean c USING (package_id) WHERE split_part(c.version, '.', 1) = w.to_line GROUP BY 1),
walk AS (
    SELECT w.package_id, w.first AS no, b.cands, 1 AS step FROM ways w JOIN base b USING (package_id)
    UNION ALL
    SELECT package_id, list_min([x FOR x IN cands IF x > no]) AS no, cands, step + 1 FROM (
        SELECT w.package_id, w.no, list_distinct(list_concat(w.cands, coalesce(g.more, []))) AS cands, w.step FROM walk w JOIN brings g ON g.package_id = w.package_id AND g.no = w.no WHERE w.step < 10)
    WHERE list_min([x FOR x IN cands IF x > no]) IS NOT NULL),
ends AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY step DESC) = 1)
SELECT e.package_id, v.version AS target, e.step AS steps, t.advisories IS NULL AS settled, CASE WHEN t.advisories IS NULL THEN '' ELSE f.advisories END AS open_advisories
FROM ends e JOIN ways w USING (package_id) LEFT JOIN told t ON t.package_id = e.package_id AND t.no = e.no LEFT JOIN told f ON f.package_id = e.package_id AND f.no = w.first
JOIN fit v ON v.package_id = e.package_id AND v.no = CASE WHEN t.advisories IS NULL THEN e.no ELSE w.first END
""")(lambda v: Targets(v.target_packages, v.target_spans, S.semver_key).clean_target().select("package_id", "target", "steps", "settled", F.array_join("open_advisories", ",").alias("open_advisories")))

# ------------------------------------------------ strict versions

_ODD = "CASE p_size % 9 WHEN 0 THEN '' WHEN 1 THEN 'rc1' WHEN 2 THEN '.4' WHEN 3 THEN 'garbage' WHEN 4 THEN concat('-rc.', CAST(p_partkey % 12 AS VARCHAR(20))) WHEN 5 THEN '-alpha' WHEN 6 THEN '+build.5' WHEN 7 THEN '-1a' ELSE '' END"
_ODD_VERSION = f"SELECT p_partkey AS id, p_size % 9 AS o, p_partkey % 12 AS rc, p_partkey % 3 AS a, p_partkey % 11 AS b, CASE WHEN p_size % 9 = 8 THEN concat(CAST(p_partkey % 3 AS VARCHAR(20)), '.', CAST(p_partkey % 11 AS VARCHAR(20))) ELSE concat(CAST(p_partkey % 3 AS VARCHAR(20)), '.', CAST(p_partkey % 11 AS VARCHAR(20)), '.0', {_ODD}) END AS version FROM part"
query("fn_semver_key", f"SELECT id, version, CASE WHEN o IN (1, 2, 3, 8) THEN NULL ELSE dense_rank() OVER (PARTITION BY o NOT IN (1, 2, 3, 8) ORDER BY a, b, CASE o WHEN 7 THEN 1 WHEN 5 THEN 2 WHEN 4 THEN 3 ELSE 4 END, CASE WHEN o = 4 THEN rc ELSE 0 END) END AS place FROM ({_ODD_VERSION})")(
    lambda v: v.spark.sql(_ODD_VERSION.replace("FROM part", "FROM {part}"), part=v.part).withColumn("k", S.semver_key(F.col("version"))).selectExpr("id", "version", "CASE WHEN k IS NOT NULL THEN dense_rank() OVER (PARTITION BY k IS NOT NULL ORDER BY k) END AS place")
)

# ------------------------------------------------ type spellings

# The members of each alternative, built up as the spelling is: what SQL has no way to parse it can compose.
_X = "CASE a WHEN 0 THEN ['int'] WHEN 1 THEN ['list[str]'] WHEN 2 THEN ['Literal[\"a|b, c\"]'] WHEN 3 THEN ['mymod.Dict'] ELSE ['tuple'] END"
_Y = "CASE b WHEN 0 THEN ['str'] WHEN 1 THEN ['Callable[[int, A | B], None]'] WHEN 2 THEN ['None'] ELSE ['dict[str, int]'] END"
_SHOWN = "CASE WHEN u THEN concat('Union[', array_to_string(list_sort(list_distinct(m)), ', '), ']') ELSE m[1] END"
query("fn_canonical_type", f"""WITH members AS (SELECT p.id, p.d, s.t, c > 0 AS u, CASE c WHEN 0 THEN x WHEN 1 THEN list_concat(x, ['None']) WHEN 2 THEN list_concat(y, x) WHEN 3 THEN list_concat(x, y) WHEN 4 THEN list_concat(list_concat(x, y), ['None'])
    ELSE list_concat(list_concat(x, y), ['None', 'int']) END AS m FROM (SELECT id, a, b, c, d, {_X} AS x, {_Y} AS y FROM type_parts) p JOIN (SELECT id, t FROM type_pairs) s USING (id)),
shown AS (SELECT *, {_SHOWN} AS one FROM members)
SELECT id, CASE d WHEN 0 THEN one WHEN 1 THEN concat('dict[str, ', one, ']') WHEN 2 THEN concat('Union[', array_to_string(list_sort(list_distinct(list_concat(m, ['None']))), ', '), ']') WHEN 3 THEN concat('set[list[', one, ']]')
    WHEN 4 THEN concat('other.Union[', one, ', int]') WHEN 5 THEN concat('Foo[', t) ELSE concat('Union[', array_to_string(list_sort(list_distinct(list_concat(m, ['None']))), ', '), ']') END AS type FROM shown
""")(lambda v: v.type_spellings.select("id", canonical_type(F.col("spelling")).alias("type")))

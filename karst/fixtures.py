"""Domain views over the star-schema test tables: findings, assets, packages, repositories, edges and their kin.

Each view is one SELECT whose text both Spark and DuckDB run, so queries and their SQL twins read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Bytes of input to a part of a shuffle, at most; of shuffled parts that are put together; and of a file that one task scans.
PART_BYTES, TOGETHER_BYTES, SCAN_BYTES = 4 << 20, 4 << 20, 8 << 20

AS_OF = "TIMESTAMP '1999-01-01 00:00:00'"

VIEWS = {
    "findings": """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR(20)), CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)),
                 CAST(l_linenumber AS VARCHAR(20)), CAST(CAST(l_shipdate AS DATE) AS VARCHAR(20))) AS finding_id,
       l_suppkey AS asset_id, l_partkey AS package_id, o_custkey AS repository_id,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('CVE-', CAST(l_partkey % 500 AS VARCHAR(20))) END AS cve_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
            WHEN '5-LOW' THEN 'Low' ELSE 'Unknown' END AS severity,
       CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Fixed' END AS status,
       CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END AS is_false_positive,
       CASE WHEN l_tax > 0.07 THEN true WHEN l_tax = 0 THEN NULL ELSE false END AS is_risk_accepted,
       CASE WHEN l_linenumber = 7 THEN true WHEN l_linenumber = 6 THEN NULL ELSE false END AS is_deleted,
       concat('type', CAST(l_linenumber % 4 AS VARCHAR(20))) AS scan_type,
       concat('src/f', CAST(l_partkey % 40 AS VARCHAR(20)), '/m', CAST(l_linenumber AS VARCHAR(20)), '.py') AS path,
       CAST(o_orderdate AS TIMESTAMP) AS first_detected,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' DAY * CAST(l_quantity AS INT) END AS fixed_at,
       10 * l_discount AS score
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "assets": """
SELECT s_suppkey AS asset_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE concat('team', CAST(s_suppkey % 6 AS VARCHAR(20))) END AS team,
       CASE s_suppkey % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'test' END AS environment,
       CASE s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN false END AS is_exposed, s_suppkey % 13 = 0 AS is_deleted
FROM supplier WHERE s_suppkey % 7 <> 0""",
    "packages": """
SELECT p_partkey AS package_id, p_name AS name, p_type AS ecosystem,
       concat(CAST(p_size AS VARCHAR(20)), '.', CAST(CAST(floor(p_retailprice) AS INT) % 30 AS VARCHAR(20)), '.', CAST(p_partkey % 10 AS VARCHAR(20))) AS version,
       p_partkey % 17 = 0 AS is_deleted
FROM part""",
    "repositories": """
SELECT c_custkey AS repository_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('owner', CAST(c_custkey % 9 AS VARCHAR(20))) END AS owner,
       c_mktsegment AS criticality
FROM customer""",
    "edges": """
SELECT concat('image:', CAST(s_suppkey AS VARCHAR(20))) AS from_key, concat('cloud:', CAST(s_nationkey AS VARCHAR(20))) AS to_key,
       'deployed_as' AS edge_type, 'high' AS confidence, s_suppkey % 19 = 0 AS is_deleted FROM supplier
UNION ALL
SELECT concat('cloud:', CAST(n_nationkey AS VARCHAR(20))), concat('net:', CAST(n_regionkey AS VARCHAR(20))), 'exposed_via', 'medium', false FROM nation
UNION ALL
SELECT DISTINCT concat('image:', CAST(l_suppkey AS VARCHAR(20))), concat('pkg:', CAST(l_partkey AS VARCHAR(20))), 'contains', 'low', false FROM lineitem
UNION ALL
SELECT concat('repo:', CAST(c_custkey AS VARCHAR(20))), concat('image:', CAST(c_custkey % 100 + 1 AS VARCHAR(20))), 'owns', 'high', false FROM customer""",
    "requirements": """
SELECT p_partkey AS child, CAST(floor(p_partkey / 2) AS BIGINT) AS parent FROM part WHERE p_partkey > 1
UNION
SELECT p_partkey, CAST(floor(p_partkey / 3) AS BIGINT) FROM part WHERE p_partkey > 2""",
    "runs": """
SELECT user_id % 20 AS source, event_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'error' THEN 'failure' ELSE 'success' END AS status
FROM events""",
    "audit": """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type AS action, event_type <> 'error' AS ok FROM events""",
    "severity_rank": "SELECT * FROM (VALUES ('Critical', 4), ('High', 3), ('Medium', 2), ('Low', 1), ('Unknown', 0)) AS t(severity, rnk)",
    "policy": """
SELECT * FROM (VALUES ('open_statuses', 'set', 'Open,In Progress', 'default'), ('severity_floor', 'floor', 'Medium', 'own'),
  ('include_risk_accepted', 'switch', 'false', 'default'), ('due_soon_days', 'days', '14', 'own')) AS t(key, kind, value, origin)""",
    "deadlines": "SELECT * FROM (VALUES ('Critical', 7), ('High', 30), ('Medium', 90), ('Low', 180)) AS t(severity, days)",
    "scan_base": """
SELECT CONCAT('f', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS fingerprint,
       min(concat('src/f', CAST(CAST(floor(l_partkey / 5) AS BIGINT) AS VARCHAR(20)), CASE WHEN l_linenumber = 7 THEN '.pyi' ELSE '.py' END)) AS path, min(l_returnflag) AS rule
FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01 00:00:00' GROUP BY 1""",
    "scan_head": """
SELECT CONCAT('f', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS fingerprint,
       min(concat('src/f', CAST(CAST(floor(l_partkey / 5) AS BIGINT) AS VARCHAR(20)), CASE WHEN l_linenumber = 6 THEN '.pyi' ELSE '.py' END)) AS path, min(l_linestatus) AS rule
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01 00:00:00' GROUP BY 1""",
    "target_cases": """
SELECT p_partkey AS package_id, p_size, CAST(floor(p_partkey / 7) AS INT) AS n, CAST(floor(p_partkey / 7) AS INT) % 14 AS k, CAST(floor(p_partkey / 7) AS INT) % 5 AS s FROM part""",
    "target_packages": """
SELECT package_id, 'npm' AS ecosystem, concat('lib', CAST(n AS VARCHAR(20))) AS name,
       CASE WHEN k <> 5 THEN concat('1.', CAST(s + p_size % 2 AS VARCHAR(20)), '.0') END AS installed,
       CASE WHEN k = 3 THEN '2.1.0' WHEN k = 10 THEN '2.4.0' WHEN k = 7 THEN '2.0.0' WHEN k = 9 THEN concat('1.', CAST(s + 1 AS VARCHAR(20)), '.0')
            WHEN k <> 4 OR p_size % 3 > 0 THEN concat('1.', CAST(s + 2 AS VARCHAR(20)), '.0') END AS scanner_target
FROM target_cases""",
    "target_templates": """
SELECT * FROM (VALUES (0, 'A', '0', '+2', NULL), (1, 'A', '0', '+2', NULL), (1, 'B', '+2', '+4', NULL), (2, 'A', '0', '2.0.0', NULL), (3, 'A', '0', '1.7.0-rc1', NULL), (5, 'A', '0', '+2', NULL),
  (6, 'A', '0', '+2', NULL), (6, 'B', '0', '+5', NULL), (7, 'A', '0', '+2', NULL), (7, 'B', '+2', '+3', NULL), (7, 'C', '+3', '+6', NULL), (8, 'A', '0', '+2', NULL), (8, 'B', '+2', NULL, NULL), (9, 'A', '0', NULL, NULL),
  (10, 'A', '0', '+3', NULL), (10, 'A', '2.0.0', '2.4.0', NULL), (11, 'A', '0', NULL, '+1'), (12, 'A', '0', '+2', NULL), (12, 'B', 'oops', '+9', NULL), (13, 'A', '0', '+2', NULL), (13, 'B', '+2', '2.0.0', NULL))
  AS t(k, advisory, lo, hi, last)""",
    "target_spans": """
SELECT DISTINCT 'npm' AS ecosystem, concat('lib', CAST(n AS VARCHAR(20))) AS name, advisory,
       CASE WHEN lo LIKE '+%' THEN concat('1.', CAST(s + CAST(substr(lo, 2) AS INT) AS VARCHAR(20)), '.0') ELSE lo END AS introduced,
       CASE WHEN hi LIKE '+%' THEN concat('1.', CAST(s + CAST(substr(hi, 2) AS INT) AS VARCHAR(20)), '.0') ELSE hi END AS fixed,
       CASE WHEN last LIKE '+%' THEN concat('1.', CAST(s + CAST(substr(last, 2) AS INT) AS VARCHAR(20)), '.0') ELSE last END AS last_affected
FROM target_cases JOIN target_templates USING (k)""",
    "type_parts": """
SELECT p_partkey AS id, p_partkey % 5 AS a, p_size % 4 AS b, p_partkey % 6 AS c, p_size % 7 AS d,
       CASE p_partkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN 'typing.List[str]' WHEN 2 THEN 'Literal["a|b, c"]' WHEN 3 THEN 'mymod.Dict' ELSE 'Tuple' END AS x,
       CASE p_size % 4 WHEN 0 THEN 'str' WHEN 1 THEN 'Callable[[int, A | B], None]' WHEN 2 THEN 'None' ELSE 'dict[str, int]' END AS y
FROM part""",
    "type_pairs": """
SELECT id, a, b, c, d, CASE c WHEN 0 THEN x WHEN 1 THEN concat('Optional[', x, ']') WHEN 2 THEN concat('Union[', y, ', ', x, ']') WHEN 3 THEN concat(x, ' | ', y, ' |', x)
            WHEN 4 THEN concat('Optional[Union[', x, ',', y, ']]') ELSE concat('Union[', x, ', Optional[', y, '], ', y, '|int]') END AS t
FROM type_parts""",
    "type_spellings": """
SELECT id, CASE d WHEN 0 THEN t WHEN 1 THEN concat('Dict[str, ', t, ']') WHEN 2 THEN concat(' typing.Optional[ ', t, ' ]') WHEN 3 THEN concat('t.Set[List[', t, ']]')
            WHEN 4 THEN concat('other.Union[', t, ', int]') WHEN 5 THEN concat('Foo[', t) ELSE concat(t, ' | None') END AS spelling
FROM type_pairs""",
    "scan_scope": "SELECT DISTINCT concat('src/f', CAST(CAST(floor(p_partkey / 5) AS BIGINT) AS VARCHAR(20)), '.py') AS path FROM part WHERE p_size < 40",
}


def grow_parts(spark: SparkSession, size: int) -> None:
    """From now on this session's shuffles have as many parts as an input of this size needs, so that one task's sort or hash table
    does not grow with the input. Adaptive execution puts small parts together; settings that already do more stay."""
    if size <= 4 * SCAN_BYTES:
        return
    name, parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", -(-size // PART_BYTES)
    if parts > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, str(parts))
    to_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", TOGETHER_BYTES), ("spark.sql.files.maxPartitionBytes", SCAN_BYTES)):
        if to_bytes(spark.conf.get(name)) > most:
            spark.conf.set(name, str(most))


class Views:
    """Lazily made views of one folder: `views.findings`, `views.lineitem`, ..."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.made, self.size = spark, sf_dir, {}, 0

    def table(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in VIEWS:
                import re

                read = {t: self.table(t) for t in set(re.findall(r"\b(?:FROM|JOIN) (\w+)", VIEWS[name])) & {*TABLES, *VIEWS}}
                # named arguments keep the base tables out of the session's catalogue
                text = re.sub(r"\b(FROM|JOIN) (" + "|".join(read or ["none"]) + r")\b", r"\1 {\2}", VIEWS[name])
                self.made[name] = self.spark.sql(text, **read)
            else:
                path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.sf_dir}/{name}.parquet")
                self.size += path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
                grow_parts(self.spark, self.size)
                self.made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in TABLES:
            return self.table(name)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """The SQL preceded by the views it names, and those that these name, for DuckDB."""
    import re

    names: set[str] = set()
    new = {v for v in VIEWS if re.search(rf"\b{v}\b", sql)}
    while new:
        names |= new
        new = {v for v in VIEWS if v not in names and any(re.search(rf"\b{v}\b", VIEWS[n]) for n in names)}
    # in the order in which they are defined, which is that in which they build on each other
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in names)
    sql = sql.strip()
    if not ctes:
        return sql
    own = re.match(r"WITH( RECURSIVE)?\b", sql)
    return f"{own[0]} {ctes}, {sql[own.end() :]}" if own else f"WITH {ctes} {sql}"

"""Readers: documents to tables. Each takes a DataFrame of documents (doc, content), as `spark.read.text(wholetext=True)`
or a table column gives it, with a declared schema, so nothing is inferred and only named fields are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SARIF = """struct<version: string, runs: array<struct<
 tool: struct<driver: struct<name: string, rules: array<struct<id: string, name: string>>>>,
 versionControlProvenance: array<struct<repositoryUri: string, revisionId: string>>,
 results: array<struct<ruleId: string, level: string, message: struct<text: string>,
  locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, snippet: struct<text: string>>>>>,
  properties: map<string, string>, partialFingerprints: map<string, string>>>>>>"""

SCANNER = """struct<ArtifactName: string, Results: array<struct<Target: string, Class: string, Type: string,
 Packages: array<struct<ID: string, Name: string, Version: string, Relationship: string>>,
 Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, PkgID: string, InstalledVersion: string, FixedVersion: string, Severity: string, CweIDs: array<string>>>>>>"""

ADVISORY = """struct<id: string, aliases: array<string>, severity: array<struct<type: string, score: string>>,
 affected: array<struct<package: struct<name: string, ecosystem: string>, ranges: array<struct<type: string, events: array<map<string, string>>>>, versions: array<string>>>>"""

SIGNALS = """struct<results: array<struct<check_id: string, path: string, start: struct<line: int>, extra: struct<metadata: struct<confidence: string, impact: string, likelihood: string, subcategory: array<string>>>>>,
 errors: array<struct<type: string, path: string>>, paths: struct<scanned: array<string>>>"""


def parsed(docs: DataFrame, schema: str) -> DataFrame:
    return docs.select("doc", F.from_json("content", schema).alias("d"))


def each(rows: DataFrame, items: str | Column, name: str, *keep: str | Column, place: str = "karst place") -> DataFrame:
    """A row for each item of an array, with the kept columns and the item's place from 0.

    A plain explode has Spark ask for the array's size first, below joins and shuffles too, and so parse each document several times."""
    return rows.select(*keep, F.posexplode_outer(items).alias(place, name)).where(F.col(f"`{place}`").isNotNull())


def sarif_findings(docs: DataFrame) -> DataFrame:
    """One row per result of every run, at its first location."""
    runs = each(parsed(docs, SARIF), "d.runs", "r", "doc", place="run")
    # of a run only what its results need goes on
    runs = runs.select("doc", "run", F.col("r.tool.driver.name").alias("tool"), F.try_element_at("r.versionControlProvenance", F.lit(1)).alias("vc"), F.col("r.results").alias("results"))
    rows = each(runs, "results", "x", "doc", "run", "tool", "vc", place="result")
    place = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    return rows.select("doc", "run", "result", "tool", F.col("x.ruleId").alias("rule"), F.coalesce("x.level", F.lit("warning")).alias("level"), F.col("x.message.text").alias("message"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"), place["region"]["snippet"]["text"].alias("snippet"), F.try_element_at("x.partialFingerprints", F.lit("primary")).alias("fingerprint"), F.col("vc.repositoryUri").alias("repository"), F.col("vc.revisionId").alias("revision"), F.col("x.properties").alias("properties"))


def sarif_rules(docs: DataFrame) -> DataFrame:
    """The rules of each run; of an id's definitions the first. Rules lie in one document row, so no shuffle is needed to find it."""
    runs = each(parsed(docs, SARIF), "d.runs", "r", "doc", place="run")
    rows = runs.select("doc", "run", F.col("r.tool.driver.rules").alias("rules"))
    first = F.filter("rules", lambda x, i: F.array_position(F.transform("rules", lambda y: y["id"]), x["id"]) == i + 1)
    return each(rows, first, "x", "doc", "run").select("doc", "run", F.col("x.id").alias("rule"), F.col("x.name").alias("name"))


def scanner_vulns(docs: DataFrame) -> DataFrame:
    """Findings of a scanner's document: a CVE only if the id is one, the first weakness, a fixed version or none."""
    rows = each(each(parsed(docs, SCANNER), "d.Results", "r", "doc"), "r.Vulnerabilities", "x", "doc", "r.Target", "r.Class")
    identity = F.col("x.VulnerabilityID")
    return rows.select("doc", F.col("Target").alias("target"), F.col("Class").alias("class"), identity.alias("vulnerability"), F.when(identity.startswith("CVE-"), identity).alias("cve_id"), F.col("x.PkgName").alias("package"), F.col("x.InstalledVersion").alias("installed"), F.nullif(F.col("x.FixedVersion"), F.lit("")).alias("fixed"), F.initcap("x.Severity").alias("severity"), F.try_element_at("x.CweIDs", F.lit(1)).alias("cwe"))


def scanner_packages(docs: DataFrame) -> DataFrame:
    rows = each(each(parsed(docs, SCANNER), "d.Results", "r", "doc"), "r.Packages", "x", "doc", "r.Target")
    return rows.select("doc", F.col("Target").alias("target"), F.col("x.Name").alias("package"), F.col("x.Version").alias("version"), F.coalesce("x.Relationship", F.lit("unknown")).alias("relationship"))


def advisories(docs: DataFrame) -> dict[str, DataFrame]:
    """An advisory document's tables: aliases, vectors and affected ranges (introduced, fixed, last affected)."""
    d = parsed(docs, ADVISORY).select("d.*")
    affected = each(d, "affected", "a", "id")
    events = each(each(affected, "a.ranges", "r", "id", "a.package.name", "a.package.ecosystem", place="n"), "r.events", "m", "id", "name", "ecosystem", "n", place="e")
    rows = events.select("id", "name", "ecosystem", "n", "e", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("introduced", "fixed", "last_affected")))
    return {
        "aliases": each(d, "aliases", "alias", "id").select("id", "alias"),
        "vectors": each(d, "severity", "s", "id").select("id", F.col("s.type").alias("type"), F.col("s.score").alias("vector")),
        "ranges": rows,
    }


def rule_signals(docs: DataFrame) -> DataFrame:
    rows = each(parsed(docs, SIGNALS), "d.results", "x", "doc")
    m = "x.extra.metadata."
    return rows.select("doc", F.col("x.check_id").alias("rule"), F.col("x.path").alias("path"), F.col("x.start.line").alias("line"), F.col(f"{m}confidence").alias("confidence"), F.col(f"{m}impact").alias("impact"), F.col(f"{m}likelihood").alias("likelihood"), F.try_element_at(f"{m}subcategory", F.lit(1)).alias("subcategory"))


def scan_coverage(docs: DataFrame) -> DataFrame:
    """Files scanned, unparsed and partly parsed, and rules that timed out, of each document; row-local."""
    d = parsed(docs, SIGNALS)
    # an error's type is a word, or a list whose first item is the word
    of = lambda e: F.when(e["type"].startswith("["), F.get(F.from_json(e["type"], "array<string>"), 0)).otherwise(e["type"])
    kinds = lambda *names: F.size(F.array_distinct(F.transform(F.filter("d.errors", lambda e: of(e).isin(*names)), lambda e: e["path"])))
    none = lambda c: F.coalesce(c, F.lit(0))
    return d.select("doc", none(F.size(F.array_distinct("d.paths.scanned"))).alias("scanned"), none(kinds("SyntaxError", "ParseError")).alias("unparsed"), none(kinds("PartialParsing")).alias("partial"), none(F.size(F.filter("d.errors", lambda e: of(e) == "Timeout"))).alias("timeouts"))


def scan_scope(docs: DataFrame) -> DataFrame:
    """The files that a dependency scan opened."""
    rows = each(parsed(docs, SCANNER), "d.Results", "r", "doc")
    return rows.where(F.col("r.Class") == "lang-pkgs").select("doc", F.col("r.Target").alias("path")).distinct()


def lines(docs: DataFrame) -> DataFrame:
    """(doc, line, text) of text documents, lines from 1."""
    return each(docs, F.split("content", "\r?\n"), "text", "doc", place="line").withColumn("line", F.col("line") + 1).select("doc", "line", "text")


def _carried(docs: DataFrame, what) -> DataFrame:
    """Lines with the last value of an expression at or before them, as `carried`."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines(docs).withColumn("carried", F.last(what, ignorenulls=True).over(w))


PIN = r"^([A-Za-z0-9][A-Za-z0-9._-]*)==([^\s;\\]+)"


def lock_edges(docs: DataFrame) -> DataFrame:
    """Requirement edges of a pinned list: a pin opens a block, and comment lines under it name its parents."""
    pin = F.nullif(F.regexp_extract("text", PIN, 1), F.lit(""))
    rows = _carried(docs, pin)
    parent = F.regexp_extract("text", r"^\s+#\s+(?:via\s+)?([A-Za-z0-9][A-Za-z0-9._-]*)\s*$", 1)
    return rows.select("doc", "line", F.col("carried").alias("package"), parent.alias("parent")).where("parent NOT IN ('', 'via') AND package IS NOT NULL")


#: Set before each match to find its place; where a text holds it itself, it is read as a replacement character.
_MARK = "\ue000"


def import_spans(files: DataFrame, templates: dict[str, str], width: int = 400) -> DataFrame:
    """Distinct matches of each template in each whole file with the line of the first; long ones are cut and marked.

    Matches may overlap and go over lines: each place is tried by looking ahead. A mark before each match and the line ends
    between the marks give the lines. Matches that begin with a line end are left out; (doc, content) rows of one doc are one file each."""
    rows = None
    text = F.regexp_replace("content", _MARK, "\ufffd")
    for name, pattern in templates.items():
        ahead = f"(?=({pattern}))"
        found = files.select("doc", text.alias("content")).where(F.col("content").rlike(pattern)).withColumn("file", F.xxhash64("content"))
        parts = F.split(F.regexp_replace("content", ahead, _MARK), _MARK, -1)
        ends = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
        # the span of the n-th match stands behind the n-th mark
        both = F.arrays_zip(F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))).alias("ends"), F.regexp_extract_all("content", F.lit(ahead), 1).alias("span"))
        found = each(found, both, "m", "doc", "file", place="n").select("doc", "file", "n", "m.ends", "m.span")
        so_far = Window.partitionBy("doc", "file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
        found = found.distinct().withColumn("line", (F.sum("ends").over(so_far) + 1).cast("int")).select("doc", "line", F.lit(name).alias("template"), "span")
        rows = found if rows is None else rows.union(found)
    out = rows.where(~F.col("span").startswith("\n") & (F.col("span") != "")).groupBy("doc", "template", "span").agg(F.min("line").alias("line"))
    return out.select("doc", "template", "line", F.substring("span", 1, width).alias("span"), (F.length("span") > width).alias("cut"))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(doc, path, line) of the new side of a zero-context diff; deletions have none."""
    rows = _carried(diffs, F.nullif(F.regexp_extract("text", r"^\+\+\+ (?:b/)?(\S+)", 1), F.lit("")))
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = F.regexp_extract("text", hunk, 1), F.regexp_extract("text", hunk, 2)
    rows = rows.where(start != "").select("doc", F.col("carried").alias("path"), start.cast("int").alias("a"), F.when(count == "", 1).otherwise(F.expr("try_cast(nullif(regexp_extract(text, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,([0-9]+))? @@', 2), '') AS INT)")).alias("n"))
    return rows.where("n > 0").select("doc", "path", F.explode(F.expr("sequence(a, a + n - 1)")).alias("line"))


COVERAGE = """struct<files: map<string, struct<executed_lines: array<int>>>>"""
STATEMENTS = """map<string, struct<path: string, statementMap: map<string, struct<start: struct<line: int>, `end`: struct<line: int>>>, s: map<string, int>>>"""


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc, path, line) that ran, of coverage in any of three forms: lists of executed lines, statement maps with hit
    counts, and profiles whose lines are `path:from.column,to.column statements count`. Each line counts once."""
    kind = docs.withColumn("_profile", F.col("content").startswith("mode:"))
    lists = kind.where("NOT _profile").select("doc", F.from_json("content", COVERAGE).alias("d"), "content")
    executed = lists.select("doc", F.explode("d.files").alias("path", "f")).select("doc", "path", F.explode("f.executed_lines").alias("line"))
    maps = lists.where("d.files IS NULL").select("doc", F.explode(F.from_json("content", STATEMENTS)).alias("path", "f"))
    statements = maps.select("doc", F.coalesce("f.path", "path").alias("path"), F.col("f.s").alias("hits"), F.explode("f.statementMap").alias("n", "at"))
    statements = statements.where(F.try_element_at("hits", "n") > 0).select("doc", "path", F.explode(F.sequence("at.start.line", F.greatest("at.start.line", "at.end.line"))).alias("line"))
    part = lambda i: F.regexp_extract("text", r"^(.+):(\d+)\.\d+,(\d+)\.\d+ \d+ (\d+)$", i)
    spans = lines(kind.where("_profile")).select("doc", part(1).alias("path"), part(2).alias("a"), part(3).alias("z"), part(4).alias("n")).where("path <> ''")
    spans = spans.where("CAST(n AS BIGINT) > 0").select("doc", "path", F.explode(F.expr("sequence(CAST(a AS INT), greatest(CAST(a AS INT), CAST(z AS INT)))")).alias("line"))
    return executed.union(statements).union(spans).distinct()


def edge_documents(docs: DataFrame) -> DataFrame:
    """The edges of inventory documents with their source and evidence; an edge without a stated confidence is low."""
    d = docs.select("doc", F.from_json("content", "struct<source: string, edges: array<struct<from: string, to: string, type: string, evidence: string, confidence: string>>>").alias("d"))
    return each(d, "d.edges", "e", "doc", "d.source").select("doc", "source", F.col("e.from").alias("from_key"), F.col("e.to").alias("to_key"), F.col("e.type").alias("edge_type"), F.col("e.evidence").alias("evidence"), F.coalesce("e.confidence", F.lit("low")).alias("confidence"))


def asset_documents(docs: DataFrame) -> DataFrame:
    """(asset_ref, part, field, value, source): identity and governance fields of an inventory, with where each came from.
    A field whose source is stated but that has no value stays, as part `provenance`."""
    d = docs.select("doc", F.from_json("content", "struct<asset_ref: string, identity: map<string, string>, governance: map<string, string>, field_provenance: map<string, string>>").alias("d"))
    entries = lambda c, part: F.transform(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lit(part).alias("part"), e["key"].alias("field"), e["value"].alias("value")))
    have = F.concat(entries("d.identity", "identity"), entries("d.governance", "governance"))
    named = F.transform(have, lambda e: e["field"])
    rest = F.transform(F.filter(F.map_keys(F.coalesce(F.col("d.field_provenance"), F.create_map().cast("map<string,string>"))), lambda k: ~F.array_contains(named, k)), lambda k: F.struct(F.lit("provenance").alias("part"), k.alias("field"), F.lit(None).cast("string").alias("value")))
    rows = each(d, F.concat(have, rest), "e", "doc", "d.asset_ref", F.col("d.field_provenance").alias("p"))
    return rows.select("doc", "asset_ref", "e.part", "e.field", "e.value", F.try_element_at("p", F.col("e.field")).alias("source"))


def job_log_steps(logs: DataFrame) -> DataFrame:
    """(doc, step, name, lines, errors, closed) of a job log: a group marker opens a step, what follows belongs to it; closed
    says whether an end marker follows before the next step."""
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    head = F.regexp_extract("text", r"##\[group\](.*)$", 1)
    rows = lines(logs).withColumn("step", F.sum((head != "").cast("int")).over(w))
    return rows.groupBy("doc", "step").agg(F.max(F.nullif(head, F.lit(""))).alias("name"), F.count("*").alias("lines"), F.count_if(F.col("text").contains("##[error]")).alias("errors"), F.bool_or(F.col("text").contains("##[endgroup]")).alias("closed"))

"""What lock files resolve: package, version, line, format, the chain a copy is nested under, and where the lock says it came from.

JSON locks are read as VARIANT, so a tree of any depth is walked level by level, all documents at once. An origin is `public`
only where the lock records the ecosystem's public registry, `other` where it records anything else, and `unknown` where
it records nothing; credentials, queries and fragments never reach a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graphs import cut
from .documents import PIN, lines

# The public registries and the prefixes of version-control addresses.
PUBLIC_REGISTRIES = {
    "pypi": ("https://pypi.org/simple", "https://pypi.python.org/simple", "https://pypi.org/pypi"),
    "npm": ("https://registry.npmjs.org", "https://registry.yarnpkg.com"),
}
GIT_PREFIXES = ("git+", "git:", "git@", "github:", "gitlab:", "bitbucket:")

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?([^/?#@:]+)(:[0-9]+)?([^?#]*)"
COLUMNS = ("doc", "line", "package", "version", "format", "nested_under", "dev", "origin", "source", "url")


def clean_url(url: Column) -> Column:
    """Without credentials, query, fragment and closing slashes, scheme and host in lower case; what has no host only trimmed."""
    u = F.trim(url)
    part = lambda i: F.regexp_extract(u, _URL, i)
    whole = F.concat(F.lower(F.concat(part(1), F.lit("://"), part(2))), part(3), F.regexp_replace(part(4), "/+$", ""))
    return F.when(u.rlike(_URL), whole).otherwise(F.regexp_replace(u, "/+$", ""))


def _doubtful(url: Column) -> Column:
    """Whether readers disagree about whose host it is: a backslash, an @ or a space before the path."""
    return F.regexp_extract(url, r"://([^/]*)", 1).rlike(r"[\\@\s]")


def with_origin(df: DataFrame, ecosystem: str) -> DataFrame:
    """Add origin, and url cleaned, to rows with source (registry, git, path, url or unrecorded), url and raw, the address as it stands."""
    df = df.withColumn("url", clean_url(F.col("url")))
    public = (F.col("source") == "registry") & F.col("url").isin(*PUBLIC_REGISTRIES[ecosystem]) & ~_doubtful(F.col("raw"))
    df = df.withColumn("origin", F.when(F.col("source") == "unrecorded", "unknown").when(public, "public").otherwise("other"))
    return df.withColumn("url", F.when(F.col("source") != "unrecorded", F.col("url")))


def with_npm_origin(df: DataFrame, resolved: Column, package: Column) -> DataFrame:
    """Add origin, source and url of a `resolved` value: a registry's archive lies under its package's name; other addresses are direct.

    Step by step, each its own column: one expression would repeat the address's patterns many times over."""
    df = df.withColumn("raw", F.coalesce(F.trim(resolved), F.lit(""))).withColumn("marker", F.concat(F.lit("/"), package, F.lit("/-/")))
    r = F.col("raw")
    git = r.rlike("^(?:" + "|".join(p.replace("+", "[+]") for p in GIT_PREFIXES) + ")") | (r.contains("://github.com/") & r.endswith(".git"))
    df = df.withColumn("url", clean_url(r)).withColumn("at", F.position("marker", "url"))
    source = F.when(r == "", "unrecorded").when(git, "git").when(r.rlike(r"^(file:|link:|[./])"), "path").when(F.col("at") > 0, "registry").otherwise("url")
    df = df.withColumn("source", source).withColumn("url", F.when(F.col("source") == "registry", F.substr("url", F.lit(1), F.col("at") - 1)).otherwise(r))
    return with_origin(df, "npm")


def _row(df: DataFrame, form: str, resolved: Column, named: Column) -> DataFrame:
    return with_npm_origin(df.withColumn("format", F.lit(form)), resolved, named).select(*COLUMNS)


def _children(df: DataFrame, node: str, keep: str) -> DataFrame:
    """One row a member of the object in a VARIANT column, with key and value."""
    return df.sparkSession.sql(f"SELECT {keep}, e.key, e.value FROM {{d}} d, LATERAL variant_explode(d.{node}) e", d=df)


def _field(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(value, '$.{name}', '{kind}')")


def package_map(docs: DataFrame) -> DataFrame:
    """Locks with one flat map of install paths; a nested copy is a resolution too. Lines are those of the versions."""
    tree = docs.select("doc", F.expr("try_variant_get(try_parse_json(content), '$.packages', 'variant')").alias("tree")).where("tree is not null")
    rows = _children(tree, "tree", "d.doc").where("key LIKE '%node_modules/%'").withColumn("version", _field("version")).where("version <> ''")
    parts = F.slice(F.split("key", "node_modules/"), 2, F.size(F.split("key", "node_modules/")))
    rows = rows.withColumn("parts", F.transform(parts, lambda p: F.regexp_replace(p, "/+$", ""))).withColumn("package", F.element_at("parts", -1)).where("package <> ''")
    # the first version line after the line that opens an install path belongs to it
    key = F.nullif(F.regexp_extract("text", r'^\s*"((?:[^"]*/)?node_modules/(?:@[^"/]+/)?[^"/]+)"\s*:\s*\{', 1), F.lit(""))
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    told = lines(docs).withColumn("key", F.last(key, ignorenulls=True).over(w)).where(F.col("text").rlike(r'^\s*"version"\s*:\s*"') & F.col("key").isNotNull())
    rows = rows.join(told.groupBy("doc", "key").agg(F.min("line").alias("line")), ["doc", "key"], "left").withColumn("line", F.coalesce("line", F.lit(1)))
    rows = rows.withColumn("nested_under", F.slice("parts", 1, F.size("parts") - 1)).withColumn("dev", F.coalesce(_field("dev", "boolean"), F.lit(False)))
    return _row(rows, "npm", _field("resolved"), F.coalesce(_field("name"), F.col("package")))


def dependency_tree(docs: DataFrame) -> DataFrame:
    """Locks whose dependencies hold dependencies of their own, to any depth; the loop ends with the deepest. No line is recorded."""
    top = docs.select("doc", F.expr("try_parse_json(content)").alias("j")).where("try_variant_get(j, '$.packages', 'variant') is null")
    frontier = cut(top.select("doc", F.expr("to_json(try_variant_get(j, '$.dependencies', 'variant'))").alias("tree"), F.array().cast("array<string>").alias("under")).where("tree is not null"))
    out = None
    while not frontier.isEmpty():
        level = _children(frontier.withColumn("node", F.expr("try_parse_json(tree)")), "node", "d.doc, d.under").withColumnRenamed("key", "package")
        rows = level.withColumn("version", _field("version")).where("version <> ''").withColumn("nested_under", F.col("under")).withColumn("line", F.lit(None).cast("int")).withColumn("dev", F.coalesce(_field("dev", "boolean"), F.lit(False)))
        rows = cut(_row(rows, "npm-tree", _field("resolved"), F.col("package")))
        out = rows if out is None else out.unionByName(rows)
        frontier = cut(level.select("doc", F.expr("to_json(try_variant_get(value, '$.dependencies', 'variant'))").alias("tree"), F.concat("under", F.array("package")).alias("under")).where("tree is not null"))
    if out is None:
        none = docs.limit(0).select("doc", F.lit(0).alias("line"), *(F.lit("").alias(c) for c in ("package", "version")), F.array().cast("array<string>").alias("nested_under"), F.lit(False).alias("dev"))
        out = _row(none, "npm-tree", F.lit(""), F.lit(""))
    return out


def entry_list(docs: DataFrame) -> DataFrame:
    """Locks of unindented heads, each with an indented version and perhaps a resolved line."""
    rows = lines(docs)
    opens = F.col("text").rlike(r"^[^ #\s]")
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("entry", F.sum(opens.cast("int")).over(w)).where("entry > 0")
    head = F.regexp_extract("text", r'^"?((?:@[^@"\s,]+/)?[^@"\s,]+)@(?:[^:]*:|.*,)\s*$', 1)
    version = F.nullif(F.regexp_extract("text", r'^\s+version\s+"?([^"\s]+)"?\s*$', 1), F.lit(""))
    resolved = F.nullif(F.regexp_extract("text", r'^\s+resolved\s+"?([^"\s]+)"?\s*$', 1), F.lit(""))
    out = rows.groupBy("doc", "entry").agg(
        F.max(F.when(opens, F.nullif(head, F.lit("")))).alias("package"),
        F.min(F.when(version.isNotNull(), F.struct("line", version.alias("version")))).alias("v"),
        F.max(F.when(resolved.isNotNull(), F.struct("line", resolved.alias("resolved")))).alias("r"),
    )
    out = out.where("package is not null and v is not null")
    out = out.select("doc", F.col("v.line").alias("line"), "package", F.col("v.version").alias("version"), F.array().cast("array<string>").alias("nested_under"), F.lit(False).alias("dev"), F.when(F.col("r.line") > F.col("v.line"), F.col("r.resolved")).alias("resolved"))
    return _row(out, "yarn", F.col("resolved"), F.col("package"))


def key_list(docs: DataFrame) -> DataFrame:
    """Locks whose `packages:` section has name and version in its keys; such a lock does not record where they came from."""
    rows = lines(docs)
    w = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = F.when(F.col("text").rlike(r"^packages:"), True).when(F.col("text").rlike(r"^[^ ]"), False)
    key = r"""^ {2}['"]?/?((?:@[^/@'"]+/)?[^/@'":]+)(?:@|/)(\d[^'":(]*)(?:\([^:]*\))*['"]?:\s*$"""
    rows = rows.withColumn("inside", F.last(section, ignorenulls=True).over(w)).where("inside")
    out = rows.select("doc", "line", F.regexp_extract("text", key, 1).alias("package"), F.regexp_extract("text", key, 2).alias("version"), F.array().cast("array<string>").alias("nested_under"), F.lit(False).alias("dev")).where("package <> ''")
    return _row(out, "pnpm", F.lit(""), F.col("package"))


def pinned_list(docs: DataFrame) -> DataFrame:
    """Pins of a list: its own single index is their origin; several, or none, leave it unknown."""
    rows = lines(docs)
    index = F.nullif(F.regexp_extract("text", r"^\s*(?:--index-url|-i|--extra-index-url)[\s=]+(\S+)", 1), F.lit(""))
    indexes = rows.where(index.isNotNull()).groupBy("doc").agg(F.count_distinct(index).alias("several"), F.min(index).alias("index"))
    pins = rows.select("doc", "line", F.regexp_extract("text", PIN, 1).alias("package"), F.regexp_extract("text", PIN, 2).alias("version")).where("package <> ''")
    out = pins.join(indexes, "doc", "left")
    source = F.when(F.col("several") == 1, "registry").otherwise("unrecorded")
    out = with_origin(out.withColumn("source", source).withColumn("raw", F.col("index")).withColumn("url", F.col("index")), "pypi")
    fixed = {"format": F.lit("pinned"), "nested_under": F.array().cast("array<string>"), "dev": F.lit(False)}
    return out.select(*(fixed[c].alias(c) if c in fixed else F.col(c) for c in COLUMNS))


FORMATS = {"package-lock.json": (package_map, dependency_tree), "yarn.lock": (entry_list,), "pnpm-lock.yaml": (key_list,), "requirements.txt": (pinned_list,)}


def lock_resolutions(docs: DataFrame) -> DataFrame:
    """All resolutions of lock documents (doc, name, content), read by the last part of their names; others and the unreadable give none."""
    docs = cut(docs.where(F.substring_index("name", "/", -1).isin(*FORMATS)).select("doc", "name", "content"))  # read once, though each reader scans its own
    out = None
    for name, readers in FORMATS.items():
        own = docs.where(F.substring_index("name", "/", -1) == name).select("doc", "content")
        for reader in readers:
            rows = reader(own)
            out = rows if out is None else out.unionByName(rows)
    return out

"""What manifests declare: requirement lists with continuation lines, tables with arrays over several lines, and JSON.

Lines are folded with a carried state (the open section, the open array, a line that goes on), one document at a time, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .documents import each, lines

COLUMNS = ("doc", "line", "section", "name", "spec", "syntax")
_ENTRY = "struct<line:int,section:string,key:string,text:string,form:string>"
_STATE = f"struct<n:int,section:string,key:string,open:string,start:int,out:array<{_ENTRY}>>"
#: A requirement: name, extras, then a version specification up to a marker or comment.
_REQUIREMENT = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*\(?((?:(?:===?|~=|!=|<=|>=|<|>)[^;#,)]+,?\s*)*)\)?\s*(?:@\s*[^;#]+)?\s*(?:[;#].*)?$"
_QUOTED = r"""("[^"]*"|'[^']*')"""
_JSON_SECTIONS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")


def _state(s: Column | None = None, **fields) -> Column:
    empty = {"n": F.lit(0), "section": F.lit(None), "key": F.lit(None), "open": F.lit(None), "start": F.lit(0), "out": F.array()}
    return F.struct(*((fields[k] if k in fields else v if s is None else s[k]).alias(k) for k, v in empty.items())).cast(_STATE)


def _entries(texts: Column, line: Column, section: Column, key: Column, form: str) -> Column:
    return F.transform(texts, lambda t: F.struct(line.alias("line"), section.alias("section"), key.alias("key"), t.alias("text"), F.lit(form).alias("form")).cast(_ENTRY))


def _unquoted(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\"']|[\"']$", "")


def _fold(docs: DataFrame, step) -> DataFrame:
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n", "\n")
    return docs.select("doc", F.col("content").isNull().alias("missing"), F.aggregate(F.split(text, "\n", -1), _state(), step).alias("s"))


def _list_step(s: Column, line: Column) -> Column:
    """A requirement list: a line that ends in a backslash goes on in the next; comments and options are no requirements."""
    n = s["n"] + 1
    whole = F.concat(F.coalesce(s["open"], F.lit("")), F.regexp_replace(line, r"\\\s*$", ""))
    start = F.when(s["open"].isNull(), n).otherwise(s["start"])
    goes_on = line.rlike(r"\\\s*$") & ~line.rlike(r"^\s*#")
    said = F.regexp_extract(whole, _REQUIREMENT, 1) != ""
    done = F.when(said, F.concat(s["out"], _entries(F.array(whole), start, F.lit("main"), F.lit(None).cast("string"), "requirement"))).otherwise(s["out"])
    return F.when(goes_on, _state(s, n=n, open=whole, start=start)).otherwise(_state(s, n=n, open=F.lit(None), out=done))


def _table_step(s: Column, line: Column) -> Column:
    """Sections, values, inline tables and arrays, which may be open over lines."""
    n = s["n"] + 1
    # what stands outside of quotes tells brackets and comments from text
    bare = F.regexp_replace(line, _QUOTED, "_")
    code = F.regexp_replace(bare, "#.*$", "")
    header = F.regexp_extract(line, r"^\s*\[+\s*([^\[\]]+?)\s*\]+\s*(?:#.*)?$", 1)
    key = _unquoted(F.regexp_extract(line, r"""^\s*("[^"]+"|'[^']+'|[A-Za-z0-9._-]+)\s*=""", 1))
    value = F.regexp_extract(line, r"=\s*(.*)$", 1)
    comment_free = F.when(F.length(code) < F.length(bare), F.regexp_replace(line, r"""^((?:"[^"]*"|'[^']*'|[^"'#])*)#.*$""", "$1")).otherwise(line)
    strings = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_QUOTED), 1), _unquoted)
    inside = s["open"].isNotNull()
    closes = code.contains("]")
    array = value.startswith("[")
    after = F.regexp_replace(comment_free, r"""^\s*(?:"[^"]+"|'[^']+'|[A-Za-z0-9._-]+)\s*=\s*""", "")
    version = _unquoted(F.regexp_extract(value, r"""^\{.*?\bversion\s*=\s*("[^"]*"|'[^']*')""", 1))
    add = lambda texts, k, form: F.concat(s["out"], _entries(texts, n, s["section"], k, form))
    return (
        F.when(inside, _state(s, n=n, open=F.when(closes, F.lit(None)).otherwise(s["open"]), out=add(strings(comment_free), s["key"], "array")))
        .when(header != "", _state(s, n=n, section=header))
        .when((key != "") & array, _state(s, n=n, key=key, open=F.when(F.regexp_replace(code, r"^[^=]*=", "").contains("]"), F.lit(None)).otherwise(F.lit("[")), start=n, out=add(strings(after), key, "array")))
        .when((key != "") & value.rlike("""^["']"""), _state(s, n=n, out=add(F.slice(strings(after), 1, 1), key, "value")))
        .when((key != "") & value.startswith("{"), _state(s, n=n, out=add(F.array(F.nullif(version, F.lit(""))), key, "table")))
        .otherwise(_state(s, n=n))
    )


def _requirement(text: str) -> tuple[Column, Column]:
    """The name that a requirement states, if it is one, and its version specification."""
    return F.regexp_extract(text, _REQUIREMENT, 1), F.regexp_replace(F.regexp_extract(text, _REQUIREMENT, 2), r"\s+|,\s*$", "")


def requirement_list(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = _fold(docs, _list_step)
    rows = each(got, "s.out", "e", "doc").select("doc", "e.line", "e.section", "e.text")
    name, spec = _requirement("text")
    return rows.withColumns({"name": name, "spec": spec, "syntax": F.lit("requirements")}).where("name <> ''").select(*COLUMNS), got.select("doc", F.lit("requirements").alias("syntax"), (~F.col("missing") & F.col("s.open").isNull()).alias("readable"))


def project_table(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    got = _fold(docs, _table_step)
    rows = each(got, "s.out", "e", "doc").select("doc", "e.*")
    # lists of requirements and single pairs are told apart row by row, so that no document is folded twice for its rows
    own = F.expr("form = 'array' AND ((section = 'project' AND key = 'dependencies') OR section IN ('project.optional-dependencies', 'dependency-groups'))")
    pair = F.expr("form <> 'array' AND text IS NOT NULL AND (section = 'tool.poetry.dependencies' OR section RLIKE '^tool[.]poetry[.]group[.].+[.]dependencies$') AND key <> 'python'")
    group = F.regexp_extract("section", r"^tool\.poetry\.group\.(.+)\.dependencies$", 1)
    name, spec = _requirement("text")
    rows = rows.where(own | pair).withColumn("own", F.expr("form = 'array'")).select(
        "doc",
        "line",
        F.when(F.col("own"), F.when(F.col("section") == "project", "main").otherwise(F.col("key"))).otherwise(F.when(group == "", "main").otherwise(group)).alias("section"),
        F.when(F.col("own"), name).otherwise(F.col("key")).alias("name"),
        F.when(F.col("own"), spec).otherwise(F.col("text")).alias("spec"),
        F.when(F.col("own"), "pep508").otherwise("poetry").alias("syntax"),
    )
    return rows.where("name <> ''"), got.select("doc", F.lit("pyproject").alias("syntax"), (~F.col("missing") & F.col("s.open").isNull()).alias("readable"))


def json_manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    tree = docs.select("doc", F.expr("try_parse_json(content)").alias("tree"))
    pick = ", ".join(f"'{s}', try_variant_get(tree, '$.{s}', 'map<string,string>')" for s in _JSON_SECTIONS)
    rows = tree.where("tree IS NOT NULL").select("doc", F.explode(F.expr(f"map({pick})")).alias("section", "pairs")).select("doc", "section", F.explode("pairs").alias("name", "spec"))
    # the line that sets a name within its section
    opened = F.nullif(F.regexp_extract("text", rf'^\s*"({"|".join(_JSON_SECTIONS)})"\s*:\s*\{{', 1), F.lit(""))
    so_far = Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    told = lines(docs).withColumn("section", F.last(opened, ignorenulls=True).over(so_far)).withColumn("name", F.regexp_extract("text", r'^\s*"([^"]+)"\s*:\s*"', 1)).where("section IS NOT NULL AND name <> ''")
    told = told.groupBy("doc", "section", "name").agg(F.min("line").alias("line"))
    rows = rows.join(told, ["doc", "section", "name"], "left").withColumn("line", F.coalesce("line", F.lit(1))).withColumn("syntax", F.lit("npm"))
    return rows.select(*COLUMNS), tree.select("doc", F.lit("package").alias("syntax"), (F.coalesce(F.expr("schema_of_variant(tree)"), F.lit("")).startswith("OBJECT")).alias("readable"))


FORMATS = {"requirements.txt": requirement_list, "pyproject.toml": project_table, "package.json": json_manifest}


def manifests(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, name, content) -> declarations (doc, line, section, name, spec, syntax) and files (doc, syntax, readable).

    Files of other names are left out. A file is readable if all of it was understood as its format: JSON that parses to an
    object, no array and no continued line left open at the end. Where every file is readable, what is not declared is not there."""
    declared = files = None
    for name, reader in FORMATS.items():
        rows, read = reader(docs.where(F.substring_index("name", "/", -1) == name).select("doc", "content"))
        declared = rows if declared is None else declared.unionByName(rows)
        files = read if files is None else files.unionByName(read)
    return declared, files

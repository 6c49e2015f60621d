"""Queries of lock files and manifests: their formats, kinds of origin, nested copies and unreadable files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import locks, manifests
from .registry import query

_I, _S = "CAST(p_partkey AS VARCHAR(20))", "CAST(p_size AS VARCHAR(20))"
_FROM = f"""CASE p_partkey % 6 WHEN 0 THEN concat('https://registry.npmjs.org/a', {_I}, '/-/a', {_I}, '-1.tgz') WHEN 1 THEN concat('https://user:tok@Registry.NPMJS.org/a', {_I}, '/-/a', {_I}, '-1.tgz?x=1')
    WHEN 2 THEN concat('https://npm.corp.example/a', {_I}, '/-/a', {_I}, '.tgz#abc') WHEN 3 THEN 'git+ssh://git@git.example/x/y.git?token=1' WHEN 4 THEN '' ELSE 'https://codeload.example/x.tgz' END"""


def _text(*rows: str) -> str:
    """A concat of lines in which <i>, <s> and <url> stand for values of the row."""
    out = "'" + "', chr(10), '".join(row.replace("'", "<q>").replace("\\", "<b>") for row in rows) + "'"
    for mark, sql in (("<q>", "chr(39)"), ("<b>", "chr(92)"), ("<i>", _I), ("<s>", _S), ("<url>", _FROM)):
        out = out.replace(mark, f"', {sql}, '")
    return f"concat({out})"


_PACKAGES = _text(
    "{", '  "packages": {', '    "": {"name": "root", "version": "9.9.9"},', '    "node_modules/a<i>": {', '      "resolved": "<url>",', '      "version": "1.<s>.0"', "    },",
    '    "node_modules/a<i>/node_modules/@s/b": {', '      "version": "2.0.0",', '      "dev": true', "    },",
    '    "node_modules/a<i>/node_modules/@s/b/node_modules/c": {', '      "version": "3.0.<s>",', '      "name": "real",', '      "resolved": "https://registry.npmjs.org/real/-/real-3.tgz"', "    },",
    '    "node_modules/link": {"link": true}', "  }", "}",
)
_TREE = _text('{"dependencies": {"a<i>": {"version": "1.<s>.0", "resolved": "<url>", "dependencies": {"b": {"version": "2.0.0", "dev": true, "dependencies": {"c": {"version": "3.0.<s>", "resolved": "file:../c"}}}}}, "d": {"requires": true}}}')
_YARN = _text("# yarn lockfile v1", "", "a<i>@^1.0.0:", '  version "1.<s>.0"', '  resolved "<url>"', "", '"@s/b@~2", "@s/b@2.x":', '  version "2.0.0"')
_PNPM = _text("lockfileVersion: '6.0'", "packages:", "  /a<i>@1.<s>.0:", "    resolution: {integrity: x}", "  /@s/b@2.0.0(peer@1):", "    dev: true", "settings:", "  /no@1.0.0:")
_PINS = "concat(CASE p_partkey % 3 WHEN 0 THEN '--index-url https://pypi.org/simple/' WHEN 1 THEN '--index-url https://u:p@pypi.corp.example/simple' ELSE '# none' END, chr(10), " + _text("a<i>==1.<s>", "    # via root", "b==2.0")[7:]
_DOCS = (
    "p_partkey AS doc",
    f"concat('app', {_S}, '/', CASE WHEN p_size % 5 < 2 THEN 'package-lock.json' WHEN p_size % 5 = 2 THEN 'yarn.lock' WHEN p_size % 5 = 3 THEN 'pnpm-lock.yaml' ELSE 'requirements.txt' END) AS name",
    f"CASE WHEN p_size % 5 < 2 AND p_partkey % 50 = 49 THEN '{{' WHEN p_size % 5 = 0 THEN {_PACKAGES} WHEN p_size % 5 = 1 THEN {_TREE} WHEN p_size % 5 = 2 THEN {_YARN} WHEN p_size % 5 = 3 THEN {_PNPM} ELSE {_PINS} END AS content",
)

_GIVEN = """CASE u WHEN 0 THEN 'public' WHEN 4 THEN 'unknown' ELSE 'other' END AS origin, CASE WHEN u < 3 THEN 'registry' WHEN u = 3 THEN 'git' WHEN u = 4 THEN 'unrecorded' ELSE 'url' END AS source,
    CASE WHEN u < 2 THEN 'https://registry.npmjs.org' WHEN u = 2 THEN 'https://npm.corp.example' WHEN u = 3 THEN 'git+ssh://git.example/x/y.git' WHEN u = 5 THEN 'https://codeload.example/x.tgz' END AS url"""
_NONE = "'unknown' AS origin, 'unrecorded' AS source, CAST(NULL AS VARCHAR) AS url"


def _rows(form: int, name: str, line, package: str, version: str, under: str, dev: str, given: str) -> str:
    good = " AND NOT bad" if form < 2 else ""
    return f"SELECT doc, CAST({line} AS INT) AS line, {package} AS package, {version} AS version, '{name}' AS format, {under} AS nested_under, {dev} AS dev, {given} FROM p WHERE f = {form}{good}"


_INDEX = "CASE u % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'other' ELSE 'unknown' END AS origin, CASE WHEN u % 3 < 2 THEN 'registry' ELSE 'unrecorded' END AS source, CASE u % 3 WHEN 0 THEN 'https://pypi.org/simple' WHEN 1 THEN 'https://pypi.corp.example/simple' END AS url"
query("src_lock_resolutions", f"""WITH p AS (SELECT p_partkey AS doc, p_partkey % 6 AS u, p_size % 5 AS f, p_partkey % 50 = 49 AS bad, concat('a', {_I}) AS a, {_S} AS s FROM part)
""" + " UNION ALL ".join([
    _rows(0, "npm", 6, "a", "concat('1.', s, '.0')", "''", "false", _GIVEN),
    _rows(0, "npm", 9, "'@s/b'", "'2.0.0'", "a", "true", _NONE),
    _rows(0, "npm", 13, "'c'", "concat('3.0.', s)", "concat(a, '>@s/b')", "false", "'public' AS origin, 'registry' AS source, 'https://registry.npmjs.org' AS url"),
    _rows(1, "npm-tree", "NULL", "a", "concat('1.', s, '.0')", "''", "false", _GIVEN),
    _rows(1, "npm-tree", "NULL", "'b'", "'2.0.0'", "a", "true", _NONE),
    _rows(1, "npm-tree", "NULL", "'c'", "concat('3.0.', s)", "concat(a, '>b')", "false", "'other' AS origin, 'path' AS source, 'file:../c' AS url"),
    _rows(2, "yarn", 4, "a", "concat('1.', s, '.0')", "''", "false", _GIVEN),
    _rows(2, "yarn", 8, "'@s/b'", "'2.0.0'", "''", "false", _NONE),
    _rows(3, "pnpm", 3, "a", "concat('1.', s, '.0')", "''", "false", _NONE),
    _rows(3, "pnpm", 5, "'@s/b'", "'2.0.0'", "''", "false", _NONE),
    _rows(4, "pinned", 2, "a", "concat('1.', s)", "''", "false", _INDEX),
    _rows(4, "pinned", 4, "'b'", "'2.0'", "''", "false", _INDEX),
]))(lambda v: locks.lock_resolutions(v.part.selectExpr(*_DOCS)).withColumn("nested_under", F.array_join("nested_under", ">")))

# ------------------------------------------------ manifests

_LIST = _text("# all", "lib<s>[extra] >=1.0, \\", "    <2 ; python_version > '3'  # why", "--index-url https://x", "other==2.<i>", "bare", "-e ./local", "url @ https://x/y.whl")
_TOML = _text(
    "[project]", 'name = "p"', "dependencies = [  # those", '    "lib<s>>=1.0,<2",', "    'odd[x]~=3.0 ; os > \"a]\"', # more", "]", "[project.optional-dependencies]", 'dev = ["tool==<i>", "lint"]', "", "[tool.poetry.dependencies]",
    'python = "^3.9"', 'poet = "^1.<s>"', "inline = { extras = ['a'], version = '>=4' }", 'path = { path = "../x" }', "[tool.poetry.group.test.dependencies]", "check = '*'", "[tool.other]", 'nothing = "1"',
)
_OPEN = _text("[project]", "dependencies = [", '  "lib<s>"')
_JSON = _text("{", '  "name": "app",', '  "dependencies": {', '    "lib<s>": "^1.<i>",', '    "@s/b": "*"', "  },", '  "devDependencies": {', '    "lib<s>": "~2"', "  }", "}")
_FILES = (
    "p_partkey AS doc",
    "CASE WHEN p_size % 5 = 0 THEN 'a/requirements.txt' WHEN p_size % 5 < 3 THEN 'pyproject.toml' WHEN p_size % 5 = 3 THEN 'b/package.json' ELSE 'setup.py' END AS name",
    f"CASE p_size % 5 WHEN 0 THEN {_LIST} WHEN 1 THEN {_TOML} WHEN 2 THEN {_OPEN} WHEN 3 THEN CASE WHEN p_partkey % 10 = 9 THEN '{{' ELSE {_JSON} END ELSE 'lib==1' END AS content",
)


def _declares(f: int, *rows: tuple) -> str:
    return " UNION ALL ".join(f"SELECT doc, CAST({line} AS INT) AS line, '{section}' AS section, {name} AS name, {spec} AS spec, '{syntax}' AS syntax FROM p WHERE f = {f} AND NOT bad" for line, section, name, spec, syntax in rows)


query("src_manifest_declarations", f"""WITH p AS (SELECT p_partkey AS doc, p_size % 5 AS f, p_size % 5 = 3 AND p_partkey % 10 = 9 AS bad, {_I} AS i, {_S} AS s, concat('lib', {_S}) AS lib FROM part)
""" + " UNION ALL ".join([
    _declares(0, (2, "main", "lib", "'>=1.0,<2'", "requirements"), (5, "main", "'other'", "concat('==2.', i)", "requirements"), (6, "main", "'bare'", "''", "requirements"), (8, "main", "'url'", "''", "requirements")),
    _declares(1, (4, "main", "lib", "'>=1.0,<2'", "pep508"), (5, "main", "'odd'", "'~=3.0'", "pep508"), (8, "dev", "'tool'", "concat('==', i)", "pep508"), (8, "dev", "'lint'", "''", "pep508"),
              (12, "main", "'poet'", "concat('^1.', s)", "poetry"), (13, "main", "'inline'", "'>=4'", "poetry"), (16, "test", "'check'", "'*'", "poetry")),
    _declares(2, (3, "main", "lib", "''", "pep508")),
    _declares(3, (4, "dependencies", "lib", "concat('^1.', i)", "npm"), (5, "dependencies", "'@s/b'", "'*'", "npm"), (8, "devDependencies", "lib", "'~2'", "npm")),
    "SELECT doc, NULL, NULL, NULL, CASE WHEN f = 2 OR bad THEN 'unreadable' ELSE 'readable' END, CASE WHEN f = 0 THEN 'requirements' WHEN f < 3 THEN 'pyproject' ELSE 'package' END FROM p WHERE f < 4",
]))(lambda v: _both(*manifests.manifests(v.part.selectExpr(*_FILES))))


def _both(declared, files):
    """Declarations, and the files themselves as rows without a name."""
    return declared.unionByName(files.select("doc", "syntax", F.when(F.col("readable"), "readable").otherwise("unreadable").alias("spec")), allowMissingColumns=True)

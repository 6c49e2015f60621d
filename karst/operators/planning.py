"""Fix planning and usage verdicts: ranges, targets, pins, imports, signatures. Undecidable stays null, never false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pep440_key
from ..functions.types import canonical_type

_COMPARATOR = r"^(>=|<=|===?|!=|~=|>|<|\^|~|=)?\s*v?([0-9]+(?:\.[0-9]+)*[0-9A-Za-z.+-]*?)(\.[*x])?$"


def _upper(version: Column, at: Column) -> Column:
    """The version with its at-th number raised and the rest cut off."""
    numbers = F.split(F.regexp_extract(version, r"^(\d+(?:\.\d+)*)", 1), r"\.")
    return F.array_join(F.concat(F.slice(numbers, 1, at - 1), F.array((F.element_at(numbers, at).cast("long") + 1).cast("string"))), ".")


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _comparator(v: Column, text: Column, key) -> Column:
    """Whether one comparator admits a version of this key; null if it cannot be read."""
    read = lambda t: F.struct(t.alias("text"), *(F.regexp_extract(t, _COMPARATOR, i).alias(n) for i, n in ((1, "op"), (2, "bound"), (3, "star"))))
    return _let(F.trim(text), lambda t: _let(read(t), lambda c: _let(key(c["bound"]), lambda b: _holds(v, c, b, key))))


def _holds(v: Column, c: Column, b: Column, key) -> Column:
    text, op, bound, star = (c[n] for n in ("text", "op", "bound", "star"))
    numbers = F.split(F.regexp_extract(bound, r"^(\d+(?:\.\d+)*)", 1), r"\.")
    size = F.size(numbers)
    caret = F.when(numbers[0] != "0", 1).when((size > 1) & (F.try_element_at(numbers, F.lit(2)) != "0"), 2).otherwise(size)
    within = lambda at: (v >= b) & (v < key(_upper(bound, at)))
    out = F.when(text.isin("*", "", "latest", "x") & (text != "latest"), v.isNotNull())
    out = out.when(~text.rlike(_COMPARATOR), F.lit(None).cast("boolean"))
    out = out.when((star != "") & op.isin("", "=", "=="), within(size)).when((star != "") & (op == "!="), ~within(size)).when(star != "", F.lit(None).cast("boolean"))
    out = out.when(op == ">=", v >= b).when(op == "<=", v <= b).when(op == ">", v > b).when(op == "<", v < b).when(op == "!=", v != b)
    out = out.when(op == "^", within(caret)).when(op == "~", within(F.least(size, F.lit(2)))).when((op == "~=") & (size > 1), within(size - 1)).when(op == "~=", F.lit(None).cast("boolean"))
    return out.otherwise(v == b)


def admits(version: Column, spec: Column, key=pep440_key) -> Column:
    """Whether a range admits a version: true, false, or null where that cannot be decided.

    Comparators joined by commas or spaces must all hold; alternatives are joined by ||. Addresses, tags and workspace
    references are undecidable."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(spec), r"(>=|<=|==|!=|~=|>|<|\^|~|=)\s+", "$1"), r"\s*,\s*|\s+(?!\|)(?<!\|\s)", ",")
    kleene_and = lambda v, c: F.aggregate(F.split(c, ","), F.lit(True), lambda a, x: a & _comparator(v, x, key))
    return F.when(spec.isNotNull(), _let(key(version), lambda v: F.aggregate(F.split(clean, r",?\s*\|\|\s*,?"), F.lit(False), lambda a, x: a | kleene_and(v, x))))


def _any(column: Column) -> Column:
    """Kleene's or over a group."""
    worst = F.max(F.when(column, 2).when(column.isNull(), 1).otherwise(0))
    return F.when(worst == 2, F.lit(True)).when(worst == 0, F.lit(False))


def _every(column: Column) -> Column:
    least = F.min(F.when(column, 2).when(column.isNull(), 1).otherwise(0))
    return F.when(least == 2, F.lit(True)).when(least == 0, F.lit(False))


def advisory_range(packages: DataFrame, ranges: DataFrame, key) -> DataFrame:
    """(package_id, advisory, affected): whether a version lies in any introduced-to-fixed span of an advisory for its name."""
    at = lambda c: key(F.col(c))
    begun = (F.col("introduced") == "0") | (at("version") >= at("introduced"))
    ended = F.when(F.col("fixed").isNotNull(), at("version") < at("fixed")).when(F.col("last_affected").isNotNull(), at("version") <= at("last_affected")).otherwise(F.lit(True))
    return packages.join(ranges, ["ecosystem", "name"]).groupBy("package_id", "advisory").agg(_any(begun & ended).alias("affected"))


def nearest_scope(dependents: DataFrame, installs: DataFrame) -> DataFrame:
    """(dependent, path, name) -> the version installed at the nearest enclosing path."""
    up = dependents.withColumn("depth", F.explode(F.expr("sequence(0, size(split(path, '/')))"))).withColumn("scope", F.expr("array_join(slice(split(path, '/'), 1, depth), '/')"))
    hit = up.join(installs, ["scope", "name"]).groupBy("dependent", "name").agg(F.max_by("version", "depth").alias("version"), F.max("depth").alias("depth"))
    return dependents.select("dependent", "name").distinct().join(hit, ["dependent", "name"], "left")


def cvss_source_pick(scores: Column, order: list[str]) -> Column:
    """Of (source, score, vector) entries that have a score, the one of the first source in order; others by name."""
    rank = lambda s: reduce(lambda a, x: a.when(s == x[1], x[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order))
    keyed = F.transform(F.filter(scores, lambda x: x["score"].isNotNull()), lambda x: F.struct(rank(x["source"]).alias("r"), x["source"].alias("source"), x["score"].alias("score"), x["vector"].alias("vector")))
    return F.array_min(keyed)


def exploit_maturity(known: Column, references: Column) -> Column:
    """known_exploited by its flag, proof_of_concept by a reference that names an exploit, else none."""
    return F.when(F.coalesce(known, F.lit(False)), "known_exploited").when(F.coalesce(F.exists(references, lambda r: F.lower(r).rlike(r"exploit-db|/poc\b|metasploit")), F.lit(False)), "proof_of_concept").otherwise("none")


def rule_id_normalise(rule: Column, prefix: Column) -> Column:
    """A rule id without the dotted path it was loaded from."""
    return F.when(rule.startswith(F.concat(prefix, F.lit("."))), F.substring(rule, F.length(prefix) + 2, F.length(rule))).otherwise(rule)


# ------------------------------------------------ usage


def import_verdict(packages: DataFrame, spans: DataFrame, requires: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Per package: reachable, build_only, imported_transitively, inconclusive or not_imported.

    spans: (package, runtime); requires: (package, parent); dynamic: packages that a non-literal import could name."""
    own = spans.groupBy("package").agg(F.bool_or("runtime").alias("runtime"))
    via = requires.join(own.select(F.col("package").alias("parent")), "parent", "left_semi").select("package").distinct().withColumn("_via", F.lit(True))
    out = packages.select("package").join(own, "package", "left").join(via, "package", "left").join(dynamic.select("package").distinct().withColumn("_dyn", F.lit(True)), "package", "left")
    verdict = F.when(F.col("runtime"), "reachable").when(F.col("runtime").isNotNull(), "build_only").when(F.col("_via"), "imported_transitively").when(F.col("_dyn"), "inconclusive").otherwise("not_imported")
    return out.select("package", verdict.alias("verdict"))


def code_verdict(files: DataFrame, defs: DataFrame, reach: DataFrame, has_entries: bool) -> DataFrame:
    """Per file: reachable (with its most certain, then shortest reach), no_path, or inconclusive without functions or entries."""
    hit = defs.join(reach, "node", "left").groupBy("path").agg(F.count("*").alias("functions"), F.min(F.when(F.col("level").isNotNull(), F.struct((~F.col("certain")).alias("u"), "level"))).alias("b"))
    out = files.select("path").distinct().join(hit, "path", "left")
    verdict = F.when(F.col("functions").isNull() | F.lit(not has_entries), "inconclusive").when(F.col("b").isNotNull(), "reachable").otherwise("no_path")
    return out.select("path", verdict.alias("verdict"), F.col("b.level").alias("level"))


def certainty(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """known if all conditions hold, else the codes of those that do not."""
    unmet = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items())))
    return df.withColumn("unmet", F.array_join(unmet, ",")).withColumn("certainty", F.when(F.col("unmet") == "", "known").otherwise("unknown"))


def library_kind(imports: DataFrame, own: DataFrame, builtin: DataFrame, ours: DataFrame) -> DataFrame:
    """own_file, built_in, ours or third_party: the first that matches."""
    for name, df in (("_o", own), ("_b", builtin), ("_u", ours)):
        imports = imports.join(df.select("module").distinct().withColumn(name, F.lit(True)), "module", "left")
    return imports.withColumn("kind", F.when(F.col("_o"), "own_file").when(F.col("_b"), "built_in").when(F.col("_u"), "ours").otherwise("third_party")).drop("_o", "_b", "_u")


def reached_through(requires: DataFrame, imported: DataFrame) -> DataFrame:
    """(package, through): packages that declare it and are imported here. Leads only."""
    return requires.join(imported.select(F.col("package").alias("parent")), "parent", "left_semi").select("package", F.col("parent").alias("through")).distinct()


def pins_on_path(walk: DataFrame, pins: DataFrame) -> DataFrame:
    """Pins in trees that the walk reaches, with their role; others are ignored with the reason."""
    out = pins.join(walk.select(F.col("node").alias("tree"), "distance"), "tree", "left")
    role = F.when(F.col("distance").isNull(), "ignored:not_reached").when(F.col("distance") == 0, "source").when(F.col("spec").startswith("=="), "ships").otherwise("request")
    return out.select("tree", "spec", role.alias("role"))


def must_move(pins: DataFrame, target: Column, key=pep440_key) -> DataFrame:
    """Whether each pin must move for a target: fine, member or undecidable."""
    ok = admits(target, F.col("spec"), key)
    return pins.withColumn("move", F.when(ok.isNull(), "undecidable").when(ok, "fine").otherwise("member"))


# ------------------------------------------------ quality of answers


def reach_lens(columns: DataFrame) -> DataFrame:
    """Columns that the platform and the tenant can fill, and of these lit and dark ones."""
    return columns.agg(F.count("*").alias("all"), F.count_if("platform").alias("platform"), F.count_if(F.col("platform") & F.col("tenant")).alias("tenant"), F.count_if(F.col("platform") & F.col("tenant") & (F.col("filled") > 0)).alias("lit"), F.count_if(F.col("platform") & F.col("tenant") & (F.col("filled") == 0)).alias("dark"))


def answerable(usage: DataFrame, supply: DataFrame) -> DataFrame:
    """Per question: blocked if an unsupplied column selects, partial if one is only shown, unknown if one is not recorded, else yes."""
    out = usage.join(supply, "column_name", "left")
    bad = F.col("supply") != "supplied"
    state = F.when(F.bool_or(bad & (F.col("use") == "filter")), "blocked").when(F.bool_or(F.col("supply").isNull()), "unknown").when(F.bool_or(bad), "partial").otherwise("yes")
    return out.groupBy("question").agg(state.alias("state"))


def lock_provenance(builds: DataFrame, text: str = "text") -> DataFrame:
    """Per lock: used if any of its build files installs from it, not_used if all install otherwise, else unknown."""
    used, other = F.col(text).rlike(r"(npm ci|--frozen-lockfile|pip install -r|poetry install)"), F.col(text).rlike(r"(npm install|pip install)(?! -r)")
    return builds.groupBy("lock").agg(F.when(F.bool_or(used), "used").when(F.every(other), "not_used").otherwise("unknown").alias("provenance"))


def diff_coverage(changed: DataFrame, covered: DataFrame, measured: DataFrame) -> DataFrame:
    """Per path: changed lines covered and uncovered; a path that no report measures has no suite."""
    hit = changed.join(covered.select("path", "line").distinct().withColumn("_c", F.lit(True)), ["path", "line"], "left")
    out = hit.groupBy("path").agg(F.count("_c").alias("covered"), F.count_if(F.col("_c").isNull()).alias("uncovered"))
    out = out.join(measured.select("path").distinct().withColumn("_m", F.lit(True)), "path", "left")
    return out.select("path", F.when(F.col("_m").isNull(), "no_suite").when(F.col("uncovered") > 0, "uncovered").otherwise("covered").alias("state"), "covered", "uncovered")


# ------------------------------------------------ plans


def fix_status(df: DataFrame) -> DataFrame:
    """(merged, scanned, reported, dismissed) -> dismissed, unavailable, waiting, still_reported or cleared."""
    s = F.when(F.col("dismissed"), "dismissed").when(F.col("merged").isNull(), "unavailable").when(F.col("scanned").isNull() | (F.col("scanned") <= F.col("merged")), "waiting").when(F.col("reported"), "still_reported").otherwise("cleared")
    return df.withColumn("fix_status", s)


def runtime_stale(verdicts: DataFrame, running: DataFrame, key: str) -> DataFrame:
    """Verdicts as they are, with whether their place still runs."""
    return verdicts.join(running.select(key).distinct().withColumn("_r", F.lit(True)), key, "left").withColumn("stale", F.col("_r").isNull()).drop("_r")


def classify_fix(rows: DataFrame, declared: DataFrame, key=pep440_key) -> DataFrame:
    """lock_only, edit_declaration, not_declared, declined:no_target or declined:unreadable, for (package_id, target)."""
    out = rows.join(declared.select("package_id", "spec"), "package_id", "left")
    ok = admits(F.col("target"), F.col("spec"), key)
    verdict = F.when(F.col("target").isNull(), "declined:no_target").when(F.col("spec").isNull(), "not_declared").when(ok.isNull(), "declined:unreadable").when(ok, "lock_only").otherwise("edit_declaration")
    return out.select("package_id", verdict.alias("verdict"))


def parents_admit(rows: DataFrame, parents: DataFrame, key=pep440_key) -> DataFrame:
    """Whether every parent's range admits the target; null if that hangs on one that cannot be read."""
    out = rows.join(parents, "package_id").withColumn("_ok", admits(F.col("target"), F.col("spec"), key))
    return out.groupBy("package_id").agg(_every(F.col("_ok")).alias("admitted"), F.count_if(~F.col("_ok")).alias("refusing"))


def runtime_floor(rows: DataFrame, floor: Column, requires: str, key=pep440_key) -> DataFrame:
    """Whether a project's lowest runtime meets the target's range; what is unknown never refuses."""
    return rows.withColumn("refused", F.coalesce(~admits(floor, F.col(requires), key), F.lit(False)))


def explain_move(moves: DataFrame, pinned: DataFrame, capped: DataFrame) -> DataFrame:
    """Why a package moved: pinned on purpose, newly capped, or needed."""
    out = moves.join(pinned.select("package_id").distinct().withColumn("_p", F.lit(True)), "package_id", "left").join(capped.select("package_id").distinct().withColumn("_c", F.lit(True)), "package_id", "left")
    return out.select("package_id", F.when(F.col("_p"), "pinned").when(F.col("_c"), "newly_capped").otherwise("needed").alias("why"))


def scope_check(places: DataFrame, planned: DataFrame, current: DataFrame) -> DataFrame:
    """Places that must move: in_plan, stale (no longer there) or out_of_scope."""
    keys = ["repository_id", "path"]
    out = places.join(planned.select(*keys).distinct().withColumn("_p", F.lit(True)), keys, "left").join(current.select(*keys).distinct().withColumn("_c", F.lit(True)), keys, "left")
    return out.select(*keys, F.when(F.col("_c").isNull(), "stale").when(F.col("_p"), "in_plan").otherwise("out_of_scope").alias("state"))


_PARAM = "struct<name:string,kind:string,default:string,type:string>"
_FACT = "struct<rule:string,name:string,at:int>"


def signature_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """Declarations before and after -> what changed, and what of it can break a call.

    A declaration is (symbol, params: array of name, kind, default, type), and where it has them kind, returns, bases (array of
    strings, for a class) and value (for an attribute). Parameters' kinds are posonly, pos, kw, args and kwargs. `breaks` lists
    (rule, name, at): what changed for callers, at which place of the positional sequence. Types, and defaults that are types,
    are alike in any spelling. A change that no caller can notice (an optional parameter behind all others, a type)
    is annotation_only; a side without any declaration, or declarations of two sorts, are opaque: nothing is known."""
    has = lambda df, c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t)
    fields = (("params", f"array<{_PARAM}>"), ("kind", "string"), ("returns", "string"), ("bases", "array<string>"), ("value", "string"))
    side = lambda df, new: df.select("symbol", F.struct(*(has(df, c, t).alias(c) for c, t in fields)).alias("d"), F.lit(new).alias("new"))
    rows = side(old, False).unionByName(side(new, True))
    # every type of a declaration in one list: defaults, types, bases, value; null for what it does not have
    each = lambda field: F.coalesce(F.transform("d.params", lambda p: p[field]), F.array().cast("array<string>"))
    texts = F.concat(each("default"), each("type"), F.coalesce("d.bases", F.array().cast("array<string>")), F.array("d.value"))
    rows = rows.withColumn("types", F.transform(texts, lambda t: canonical_type(t)))
    n, m = F.coalesce(F.size("d.params"), F.lit(0)), F.coalesce(F.size("d.bases"), F.lit(0))
    n, m = F.greatest(n, F.lit(0)), F.greatest(m, F.lit(0))
    plain = F.transform("d.params", lambda p, i: F.struct(p["name"].alias("name"), p["kind"].alias("kind"), F.get("types", i).alias("default"), F.get("types", i + n).alias("type")))
    rows = rows.select("symbol", "new", F.struct("d", plain.alias("params"), F.when(F.col("d.bases").isNotNull(), F.slice("types", 2 * n + 1, m)).alias("bases"), F.element_at("types", -1).alias("value")).alias("x"))
    # a symbol declared several times is taken as its greatest declaration
    both = rows.groupBy("symbol").agg(F.max(F.when(~F.col("new"), F.col("x"))).alias("xo"), F.max(F.when(F.col("new"), F.col("x"))).alias("xn"))
    both = both.select("symbol", "xo", "xn", F.col("xo.d").alias("o"), F.col("xn.d").alias("n"), F.col("xo.params").alias("a"), F.col("xn.params").alias("b"))
    two = F.col("a").isNotNull() & F.col("b").isNotNull()
    both = both.withColumn("breaks", F.when(two, _facts(F.col("a"), F.col("b"))).otherwise(F.array().cast(f"array<{_FACT}>")))
    names = lambda c: F.transform(c, lambda p: p["name"])
    kinds = F.exists(F.zip_with("a", "b", lambda x, y: ~x["kind"].eqNullSafe(y["kind"])), lambda d: d)
    hard = F.size(F.filter("breaks", lambda f: f["rule"] != "default_changed")) > 0
    same = names("a") == names("b")
    function = F.when(~same & hard, "params_changed").when(same & kinds, "kind_changed").when(hard, "params_changed").when(F.size("breaks") > 0, "default_changed").otherwise("annotation_only")
    bare = lambda s: F.col(f"{s}.params").isNull() & F.col(f"{s}.bases").isNull() & F.col(f"{s}.value").isNull()
    classes = F.when(F.col("xo.bases") == F.col("xn.bases"), "identical").otherwise("bases_changed")
    values = F.when(F.col("xo.value").eqNullSafe(F.col("xn.value")), "identical").otherwise("value_changed")
    change = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(bare("o") | bare("n"), "opaque").when(F.col("o.kind") != F.col("n.kind"), "became_other")
        .when(F.col("o").eqNullSafe(F.col("n")), "identical").when(two, function).when(F.col("a").isNotNull() | F.col("b").isNotNull(), "opaque")
        .when(F.col("o.bases").isNotNull() & F.col("n.bases").isNotNull(), classes).when(F.col("o.value").isNotNull() & F.col("n.value").isNotNull(), values).otherwise("opaque")
    )
    gone = F.size(F.array_except(names("a"), names("b")))
    need = F.size(F.filter("b", lambda p: p["default"].isNull() & p["kind"].isin("posonly", "pos", "kw") & ~F.array_contains(names("a"), p["name"])))
    return both.select("symbol", change.alias("change"), F.greatest(F.coalesce(gone, F.lit(0)), F.lit(0)).alias("removed_params"), F.greatest(F.coalesce(need, F.lit(0)), F.lit(0)).alias("new_required"), "breaks")


def _facts(a: Column, b: Column) -> Column:
    """What callers can notice between two parameter lists, as (rule, name, at).

    Both lists are aligned by name: a slot is a name with its parameter and its place before and after. Each rule is a
    condition on one slot; the rule names are fixed values."""
    placed = lambda c: F.transform(F.filter(c, lambda p: p["kind"].isin("posonly", "pos")), lambda p: p["name"])
    called = lambda c, n: F.try_element_at(F.filter(c, lambda p: p["name"] == n), F.lit(1))
    place = lambda c, n: F.nullif(F.array_position(placed(c), n), F.lit(0)) - 1
    slot = lambda n: F.struct(n.alias("name"), called(a, n).alias("p"), called(b, n).alias("q"), place(a, n).alias("was"), place(b, n).alias("now"))
    slots = F.transform(F.array_union(F.transform(a, lambda p: p["name"]), F.transform(b, lambda p: p["name"])), slot)
    fact = lambda rule, name, at: F.struct(rule.alias("rule"), name.alias("name"), at.cast("int").alias("at")).cast(_FACT)

    def rules(s):
        p, q, was, now = s["p"], s["q"], s["was"], s["now"]
        heir = F.get(placed(b), was.cast("int"))
        # values by place: who now stands where this parameter stood
        by_place = F.when(was.isNull(), None).when(heir.isNotNull() & (heir != s["name"]) & (p["kind"] != "posonly"), "position_renamed").when(heir.isNull(), F.when(q.isNull(), "positional_removed").when(now.isNotNull(), "moved").otherwise("now_keyword_only"))
        # values by name: whether the name is still taken, and what stands for it when it is left out
        by_name = F.when(~p["kind"].isin("pos", "kw") | p.isNull(), None).when(q.isNull(), "keyword_removed").when(~q["kind"].isin("pos", "kw"), "no_longer_keyword").when(p["default"].isNotNull() & q["default"].isNull(), "lost_default").when(p["default"].isNotNull() & ~p["default"].eqNullSafe(q["default"]), "default_changed")
        # what is new: behind the old sequence, or by keyword
        later = F.exists(F.slice(placed(b), now.cast("int") + 2, F.size(placed(b))), lambda n: F.exists(a, lambda r: r["name"] == n))
        new = F.when(p.isNotNull(), None).when(now >= F.size(placed(a)), F.when(q["default"].isNull(), "required_added").when(later, "optional_inserted")).when((q["kind"] == "kw") & q["default"].isNull(), "required_kwonly_added")
        gone = F.when(p["kind"].isin("args", "kwargs") & ~F.exists(b, lambda r: r["kind"] == p["kind"]), "variadic_removed")
        return F.array(fact(by_place, s["name"], was), fact(by_name, s["name"], now), fact(new, s["name"], now), fact(gone, s["name"], F.lit(None)))

    nameless = lambda c: F.size(F.filter(c, lambda p: p["kind"] == "posonly"))
    count = F.array(fact(F.when(nameless(a) != nameless(b), "positional_only_count"), F.lit(None), F.lit(None)))
    return F.filter(F.concat(F.flatten(F.transform(slots, rules)), count), lambda f: f["rule"].isNotNull())


def call_safety(calls: DataFrame, facts: DataFrame) -> DataFrame:
    """(symbol, positional: how many values by place, self included; keywords; spread: whether it unpacks values by place; kwspread, if
    there is such a column: whether it unpacks values by name) calls against (symbol, change, breaks) of `signature_change`:
    the worst of safe, unknown and breaks per symbol.

    A call is safe only where nothing that changed can reach it. Unpacked values may hold what is missing, so they are
    never proof of a break: a lost default breaks a call that leaves the value out, unless it unpacks values. A changed default
    is unknown; a new required parameter breaks every call. Symbols without facts are unknown."""
    kwspread = F.coalesce(F.col("kwspread"), F.lit(False)) if "kwspread" in calls.columns else F.lit(False)
    out = calls.withColumn("kwspread", kwspread).join(facts.select("symbol", "change", "breaks"), "symbol", "left")
    by_name = lambda f: F.coalesce(F.array_contains("keywords", f["name"]), F.lit(False))
    named = ("keyword_removed", "no_longer_keyword", "positional_removed")
    placed = ("position_renamed", "moved", "now_keyword_only", "optional_inserted", "positional_removed")
    certain = F.exists("breaks", lambda f: f["rule"].isin("required_added", "required_kwonly_added"))
    lost = lambda f: (f["rule"] == "lost_default") & ~by_name(f) & ~F.coalesce(F.col("positional") > f["at"], F.lit(False))
    open_ = F.exists("breaks", lambda f: ~f["rule"].isin(*named, *placed, "lost_default") | (lost(f) & F.col("kwspread")) | (f["rule"].isin(*named) & F.col("kwspread") & ~by_name(f)) | (f["rule"].isin(*placed) & f["at"].isNull()))
    hit = F.exists("breaks", lambda f: lost(f) | (f["rule"].isin(*placed) & (F.col("positional") > f["at"])) | (f["rule"].isin(*named) & by_name(f)))
    worst = (
        F.when(F.col("change").isin("identical", "annotation_only"), 0).when(F.col("change") == "removed", 2).when(F.coalesce(F.size("breaks"), F.lit(0)) <= 0, 1)
        .when(F.coalesce(F.col("spread"), F.lit(True)), 1).when(certain, 2).when(open_, 1).when(hit, 2).otherwise(0)
    )
    most = F.max(worst)
    return out.groupBy("symbol").agg(F.when(most == 2, "breaks").when(most == 1, "unknown").otherwise("safe").alias("safety"), F.count("*").alias("calls"))


def api_touch(changes: DataFrame, usage: DataFrame, aliases: DataFrame, complete: bool) -> DataFrame:
    """Changed symbols that are used, under any alias: verdict 4 if one is touched, 3 if none; unavailable if usage is incomplete."""
    real = usage.join(aliases, "symbol", "left").select(F.coalesce("canonical", "symbol").alias("symbol"), "package_id")
    hit = real.join(changes, ["package_id", "symbol"]).groupBy("package_id").agg(F.count_if(F.col("kind") != "annotation_only").alias("touched"), F.count("*").alias("sites"))
    out = changes.select("package_id").distinct().join(hit, "package_id", "left")
    verdict = F.when(F.coalesce("touched", F.lit(0)) > 0, "4").when(F.lit(not complete), "unavailable").otherwise("3")
    return out.select("package_id", verdict.alias("verdict"), F.coalesce("sites", F.lit(0)).alias("sites"))


def weak_answer(answers: DataFrame, files: DataFrame, limit: int = 10) -> DataFrame:
    """Clean answers whose package a file names in a dynamic use: at most `limit` files each, and how many more there are."""
    hit = files.where(F.col("text").contains("import") & F.col("text").rlike(r"(importlib|__import__|require)\s*\("))
    hit = answers.where("answer = 'not_imported'").join(hit, "package_id")
    w = Window.partitionBy("package_id").orderBy("path")
    counts = hit.groupBy("package_id").agg(F.count("*").alias("_n"))
    few = hit.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return few.join(counts, "package_id").select("package_id", "path", F.greatest(F.col("_n") - limit, F.lit(0)).alias("more"))


def cited_check(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """Sentences all of whose cited claims are still the same; a claim that is gone is not."""
    cited = sentences.select("sentence_id", F.explode("cites").alias("claim")).join(claims, "claim", "left")
    return cited.groupBy("sentence_id").agg(F.every(F.coalesce(F.col("state") == "unchanged", F.lit(False))).alias("holds"))

"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public CVSS v3.1 specification.
CVSS3 = {
    "AV": {"N": "0.85", "A": "0.62", "L": "0.55", "P": "0.2"},
    "AC": {"L": "0.77", "H": "0.44"},
    "PR_U": {"N": "0.85", "L": "0.62", "H": "0.27"},
    "PR_C": {"N": "0.85", "L": "0.68", "H": "0.5"},
    "UI": {"N": "0.85", "R": "0.62"},
    "CIA": {"H": "0.56", "L": "0.22", "N": "0"},
}


def _pick(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(c == k, F.lit(float(v))).otherwise(out)
    return out


def _let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cvss3_base(vector: Column) -> Column:
    """Base score of a version 3 vector; null if a metric is missing or unknown.

    Rounded up as the specification's integer rule says: on the score times 100,000."""
    metrics = F.str_to_map(vector, F.lit("/"), F.lit(":"))
    get = lambda m, k: F.try_element_at(m, F.lit(k))

    def parts(m):
        changed = get(m, "S") == "C"
        pr = F.when(changed, _pick(get(m, "PR"), CVSS3["PR_C"])).otherwise(_pick(get(m, "PR"), CVSS3["PR_U"]))
        c, i, a = (1 - _pick(get(m, k), CVSS3["CIA"]) for k in "CIA")
        exploit = 8.22 * _pick(get(m, "AV"), CVSS3["AV"]) * _pick(get(m, "AC"), CVSS3["AC"]) * pr * _pick(get(m, "UI"), CVSS3["UI"])
        return F.struct(changed.alias("changed"), get(m, "S").isin("U", "C").alias("known"), (1 - c * i * a).alias("iss"), exploit.alias("exploit"))

    def impact(x):
        own = F.when(x["changed"], 7.52 * (x["iss"] - 0.029) - 3.25 * F.pow(x["iss"] - 0.02, F.lit(15.0))).otherwise(6.42 * x["iss"])
        return F.struct(x["changed"].alias("changed"), x["known"].alias("known"), own.alias("impact"), (own + x["exploit"]).alias("sum"))

    def rounded(x):
        raw = F.when(x["changed"], 1.08 * x["sum"]).otherwise(x["sum"])
        return F.struct(x["known"].alias("known"), x["impact"].alias("impact"), F.round(F.when(raw > 10, F.lit(10.0)).otherwise(raw) * 100000).cast("long").alias("scaled"))

    def score(x):
        up = F.when(x["scaled"] % 10000 == 0, x["scaled"] / 100000.0).otherwise((F.floor(x["scaled"] / 10000) + 1) / 10.0)
        return F.when(x["known"] & x["scaled"].isNotNull(), F.when(x["impact"] <= 0, F.lit(0.0)).otherwise(up))

    out = _let(metrics, lambda m: _let(parts(m), lambda p: _let(impact(p), lambda i: _let(rounded(i), score))))
    return F.when(vector.startswith("CVSS:3"), out)


def severity_band(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").otherwise("Unknown")


def severity_precedence(score: Column, word: Column, rank) -> Column:
    """The stronger of the score's band and the advisory's word."""
    band = severity_band(score)
    return F.when(rank(band) >= rank(word), band).otherwise(F.coalesce(word, F.lit("Unknown")))


def level_from_rating(rating: Column) -> Column:
    r = F.lower(rating)
    return F.when(r.isin("critical", "high"), "error").when(r == "medium", "warning").otherwise("note")


def norm_snippet(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fingerprint(*parts: Column) -> Column:
    """A drift-safe identity: the first 32 hexadecimal digits of SHA-256 over the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def file_blob_id(content: Column) -> Column:
    """A file's content id as git computes it."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "utf-8"), F.unhex(F.lit("00")), raw))


def edge_id(tenant: Column, a: Column, b: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws("|", tenant, a, kind, b), 256)


def repo_key(remote: Column) -> Column:
    """Any form of a remote as host/organisation/repository in lower case."""
    c = F.lower(F.trim(remote))
    c = F.regexp_replace(c, r"^[a-z+]+://", "")
    c = F.regexp_replace(c, r"^[^@/]*@", "")
    c = F.regexp_replace(c, r"^([^/:]+):(?!\d+/)", "$1/")
    return F.regexp_replace(c, r"(\.git)?/*$", "")


def norm_uri(uri: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(uri, r"^file://", ""), r"^(\./)+", "")


def image_digest(references: Column) -> Column:
    """The first reference pinned by a digest; a tag is never an identity."""
    return F.try_element_at(F.filter(references, lambda r: r.contains("@sha256:")), F.lit(1))


def key_scheme(key: Column) -> Column:
    return F.split_part(key, F.lit(":"), F.lit(1))


def key_rest(key: Column) -> Column:
    return F.regexp_extract(key, r"^[^:]*:(.*)$", 1)


def package_normalise(name: Column, ecosystem: Column) -> Column:
    """Case and separators fold in one ecosystem only."""
    return F.when(F.lower(ecosystem) == "pypi", F.lower(F.regexp_replace(name, r"[-_.]+", "-"))).otherwise(name)


def version_key(version: Column) -> Column:
    """A comparable key: numbers as numbers, words as words; words sort before numbers, the unreadable last."""
    tokens = F.regexp_extract_all(F.lower(version), F.lit(r"([0-9]+|[a-z]+)"), 1)
    key = F.transform(tokens, lambda t: F.struct(F.when(t.rlike("^[0-9]"), 1).otherwise(0).alias("number"), F.when(t.rlike("^[0-9]"), F.lpad(t, 20, "0")).otherwise(t).alias("value")))
    return F.when(F.size(tokens) > 0, key)


def semver_key(version: Column) -> Column:
    """Release numbers, then whether it is a release, then the pre-release identifiers; null for what is no strict version.

    Three numbers without leading zeros, then -identifiers and +build words, which do not count."""
    number = r"(0|[1-9]\d*)"
    pattern = rf"^\s*[v=]?\s*{number}\.{number}\.{number}(?:-([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?(?:\+[0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*)?\s*$"
    part = lambda i: F.regexp_extract(version, pattern, i)
    # numbers of any length compare as text behind their length
    sized = lambda t: F.concat(F.lpad(F.length(t).cast("string"), 4, "0"), t)
    bare = lambda t: F.regexp_replace(t, r"^0+(?=\d)", "")
    identifiers = F.transform(F.split(part(4), r"\."), lambda t: F.struct(F.when(t.rlike(r"^\d+$"), 0).otherwise(1).alias("word"), F.when(t.rlike(r"^\d+$"), sized(bare(t))).otherwise(t).alias("value")))
    pre = F.when(part(4) == "", F.array().cast("array<struct<word:int,value:string>>")).otherwise(identifiers)
    return F.when(part(1) != "", F.struct(sized(part(1)).alias("major"), sized(part(2)).alias("minor"), sized(part(3)).alias("patch"), (part(4) == "").alias("release"), pre.alias("pre")))


def pep440_key(version: Column) -> Column:
    """Epoch, release without trailing zeros, then dev < a < b < rc < final < post; local versions after."""
    v = F.lower(F.trim(version))
    pattern = r"^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[._-]?(a|b|c|rc|alpha|beta|pre|preview)[._-]?(\d*))?(?:(?:[._-]?(?:post|rev|r)[._-]?(\d*))|-(\d+))?(?:[._-]?(dev)[._-]?(\d*))?(?:\+([a-z0-9]+(?:[._-][a-z0-9]+)*))?$"
    part = lambda i: F.regexp_extract(v, pattern, i)
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).cast("long"), F.lit(0))
    release = F.transform(F.split(F.regexp_replace(part(2), r"(\.0+)+$", ""), r"\."), lambda t: t.cast("long"))
    word = part(3)
    post = v.rlike(r"[._-]?(post|rev|r)[._-]?\d*([._-]?dev[._-]?\d*)?(\+.*)?$") & ~v.rlike(r"\d+[._-]?rc[._-]?\d*$") | (part(6) != "")
    dev = part(7) == "dev"
    phase = F.when(word.isin("a", "alpha"), 1).when(word.isin("b", "beta"), 2).when(word != "", 3).when(dev & ~post, 0).otherwise(4)
    return F.when(
        v.rlike(pattern),
        F.struct(
            number(part(1)).alias("epoch"), release.alias("release"), phase.alias("phase"), number(part(4)).alias("pre"),
            F.when(post, number(F.concat(part(5), part(6)))).otherwise(F.lit(-1)).alias("post"),
            F.when(dev, number(part(8))).otherwise(F.lit(1 << 40)).alias("dev"), F.transform(F.split(part(9), r"[._-]"), lambda t: F.struct(t.rlike(r"^\d+$").alias("number"), F.when(t.rlike(r"^\d+$"), F.lpad(t, 20, "0")).otherwise(t).alias("value"))).alias("local"),
        ),
    )


def lowest_fix_above(installed: Column, fixes: Column, key=version_key) -> Column:
    """The lowest fix above the installed version; the lowest of all if none sorts above. What cannot be read comes last."""
    keyed = F.transform(F.filter(fixes, lambda f: f.isNotNull()), lambda f: F.struct(key(f).isNull().alias("unreadable"), key(f).alias("k"), f.alias("v")))
    above = F.filter(keyed, lambda f: f["k"] > key(installed))
    return F.coalesce(F.array_min(above)["v"], F.array_min(keyed)["v"])


def version_line(version: Column) -> Column:
    """The major line, or 0.minor."""
    major, minor = F.regexp_extract(version, r"^v?(\d+)", 1), F.regexp_extract(version, r"^v?\d+\.(\d+)", 1)
    return F.when(major == "0", F.concat(F.lit("0."), minor)).when(major != "", major)


def prerelease(version: Column) -> Column:
    return F.lower(version).rlike(r"\d[._-]?(a|b|c|rc|alpha|beta|pre|preview|dev|snapshot)[._-]?\d*|-[0-9a-z]")


def crosses_major(a: Column, b: Column) -> Column:
    """Whether a move leaves the version line; null if either is unreadable."""
    return version_line(a) != version_line(b)


def path_scope(path: Column) -> Column:
    """The segment that makes a path non-runtime, or null."""
    return F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)(tests?|__tests__|spec|examples?|docs?|fixtures|benchmarks?)(?:/|$)", 1), F.lit(""))


def log_clean(line: Column, width: int = 400) -> Column:
    """A log line without time stamp, colours and control characters."""
    c = F.regexp_replace(line, r"^\d{4}-\d\d-\d\dT[0-9:.]+Z\s?", "")
    c = F.regexp_replace(c, r"\x1B\[[0-9;?]*[ -/]*[@-~]", "")
    return F.substring(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F]", ""), 1, width)


SECRET_SHAPES = {
    "assignment": r"(?i)\b(token|secret|password|api[_-]?key)\b(\s*[:=]\s*[\"']?)[A-Za-z0-9_\-./+=]{8,}",
    "bearer": r"(?i)\b(bearer)(\s+)[A-Za-z0-9_\-.=]{16,}",
    "url": r"(?i)\b([a-z][a-z0-9+.-]*://)([^/\s:@]+:)[^/\s@]+(?=@)",
}


def secret_mask(text: Column) -> Column:
    """Credentials of known shapes masked."""
    for shape in SECRET_SHAPES.values():
        text = F.regexp_replace(text, shape, "$1$2[MASKED]")
    return text


def secret_kinds(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in SECRET_SHAPES.items())))


def deadline(first: Column, days: Column) -> Column:
    """First detection plus the window of days; without a window none."""
    return F.when(days.isNotNull(), first + F.make_dt_interval(days))


def sla_state(due: Column, as_of: Column, lead_days: int) -> Column:
    return F.when(due.isNull(), "none").when(due < as_of, "breached").when(due <= as_of + F.make_dt_interval(F.lit(lead_days)), "due_soon").otherwise("on_track")


def age_days(ts: Column, as_of: Column) -> Column:
    return F.datediff(as_of, ts)

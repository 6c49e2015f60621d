"""Target lines and clean targets against a plain walk over lists."""

import random

import pytest

from karst.functions.scalars import semver_key
from karst.operators.targets import Targets

PACKAGES = "package_id int, ecosystem string, name string, installed string, scanner_target string"
SPANS = "ecosystem string, name string, advisory string, introduced string, fixed string, last_affected string"


def parse(v):
    import re

    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(-rc\d)?", v or "")
    return (int(m[1]), int(m[2]), int(m[3]), m[4] is None, m[4] or "") if m else None


def line(v):
    k = parse(v)
    return None if k is None else f"0.{k[1]}" if k[0] == 0 else str(k[0])


def affects(spans, v):
    """Whether a version lies in any span; unreadable ends hold everything."""
    k = parse(v)
    for lo, hi, last in spans:
        a, z = parse(lo), parse(hi or last)
        if (lo != "0" and a is None) or ((hi or last) and z is None):
            return True
        if (lo == "0" or a <= k) and (hi is None and last is None or (k < z if hi else k <= z)):
            return True
    return False


def plain(package, spans, most):
    _, eco, name, have, aim = package
    own = {}
    for e, n, adv, lo, hi, last in spans:
        if (e, n) == (eco, name):
            own.setdefault(adv, []).append((lo, hi, last))
    jump = bool(line(have) and line(aim) and line(have) != line(aim))
    unknown = (aim, "unknown", line(aim), jump, [])
    if parse(have) is None or aim is None:
        return unknown, None
    relevant = {a: s for a, s in own.items() if affects(s, have)}
    fixes_of = lambda group: {hi for s in group for _, hi, _ in s if parse(hi)}
    fits = lambda v: parse(v) and parse(v)[3] and parse(v) > parse(have) and not any(affects(s, v) for s in relevant.values())
    clean = sorted({v for v in fixes_of(relevant.values()) | {aim} if fits(v)}, key=parse)
    if not relevant or not clean:
        return unknown, None
    on = [v for v in clean if line(v) == line(have)]
    pick = (on or clean)[0]
    first = (pick, "measured", line(pick), not on, sorted(relevant))
    cands = {v for v in clean if line(v) == line(pick)}
    v, skipped = pick, []
    for step in range(1, most + 1):
        open_ = sorted(a for a, s in own.items() if affects(s, v))
        if not open_:
            return first, (v, step, True, [], skipped)
        skipped.append((v, open_))
        cands |= {x for x in fixes_of(own[a] for a in open_) if fits(x) and line(x) == line(pick)}
        later = sorted((x for x in cands if parse(x) > parse(v)), key=parse)
        if not later or step == most:
            break
        v = later[0]
    return first, (pick, step, False, skipped[0][1], skipped)


def tables(seed):
    rng = random.Random(seed)
    version = lambda: f"{rng.choice([0, 1, 1, 1, 2])}.{rng.randint(0, 5)}.{rng.randint(0, 1)}" + rng.choice(["", "", "", "", "-rc1"])
    packages, spans = [], []
    for n in range(16):
        for a in range(rng.randint(0, 7)):
            for _ in range(rng.choice([1, 1, 2])):
                end, major, minor = rng.random(), rng.choice([1, 1, 1, 2]), rng.randint(0, 7)
                lo = "junk" if rng.random() < 0.02 else "0" if rng.random() < 0.2 else f"{major}.{minor}.0"
                hi = f"{major}.{minor + rng.randint(1, 3)}.{rng.randint(0, 1)}" + rng.choice(["", "", "", "-rc1"]) if rng.random() < 0.85 else "2.0.0"
                spans.append(("npm", f"p{n}", f"A{a}", lo, hi if end < 0.9 else None, hi if end > 0.95 else None))
        for _ in range(8):
            packages.append((len(packages), rng.choice(["npm", "npm", "npm", "npm", "pypi"]), f"p{n}", rng.choice([f"1.{rng.randint(0, 4)}.0"] * 9 + [version(), None, "bad"]), rng.choice([*(version() for _ in range(9)), None, "bad"])))
    packages += [(len(packages) + i, *packages[0][1:]) for i in range(5)]
    return packages, spans


@pytest.mark.parametrize(("seed", "most"), [(1, 10), (2, 10), (3, 2)])
def test_targets(spark, seed, most):
    packages, spans = tables(seed)
    t = Targets(spark.createDataFrame(packages, PACKAGES).repartition(3), spark.createDataFrame(spans, SPANS), semver_key)
    lines = {r["package_id"]: (r["target"], r["basis"], r["target_line"], r["major_jump"], list(r["advisories"])) for r in t.target_line().collect()}
    walks = {r["package_id"]: (r["target"], r["steps"], r["settled"], list(r["open_advisories"]), list(r["skipped"])) for r in t.clean_target(most).collect()}
    stepped = 0
    for p in packages:
        first, walk = plain(p, spans, most)
        got = lines[p[0]]
        assert got[1:2] + got[3:] == first[1:2] + first[3:] and (parse(got[0]), line(got[0])) == (parse(first[0]), line(first[0])), p
        if walk is None:
            assert p[0] not in walks
        else:
            assert walks[p[0]] == (*walk[:4], [v for v, _ in walk[4]]), p
            stepped += bool(walk[4])
    assert stepped > 2 and len(lines) == len(packages)


def test_targets_of_nothing(spark):
    t = Targets(spark.createDataFrame([], PACKAGES), spark.createDataFrame([], SPANS), semver_key)
    assert t.target_line().count() == t.clean_target().count() == 0


def test_admits_works_the_version_key_out_once(spark):
    from pyspark.sql import functions as F

    from karst.operators import planning

    keys = []

    def key(text):
        keys.append(text)
        return planning.pep440_key(text)

    rows = spark.createDataFrame([("1.5", ">=1.0,<2"), ("1.5", "^2 || ~=1.4"), ("1.5", "git+x"), (None, "*"), ("x y", ">1"), ("2.0", "!=1.*")], "version string, spec string")
    got = [r[0] for r in rows.select(planning.admits(F.col("version"), F.col("spec"), key)).collect()]
    assert got == [True, True, None, False, None, True]
    assert sum("version" in k._jc.toString() for k in keys) == 1

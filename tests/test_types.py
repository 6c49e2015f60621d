"""Type spellings against a recursive reader, and searches whose words hold wildcards or are too many."""

import random

import pytest
from pyspark.sql import functions as F

from karst.functions import scalars as S
from karst.functions.types import ALIASES, MODULES, canonical_type
from karst.operators import filters


def pieces(s, at):
    """Split at a character outside of brackets and quotes; None where they do not match."""
    out, depth, quote, cur = [], 0, "", ""
    for ch in s:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        if ch == at and not quote and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [*out, cur]


def balanced(s):
    depth, quote = 0, ""
    for ch in s:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        else:
            depth += (ch in "([{") - (ch in ")]}")
            if depth < 0:
                return False
    return depth == 0 and not quote


def bare(name):
    module, _, last = name.rpartition(".")
    return last if module in MODULES else name


def read(s):
    """(union, members)"""
    s = s.strip()
    parts = pieces(s, "|")
    if len(parts) > 1:
        return True, sorted({m for p in parts for m in read(p)[1]})
    head, bracket, _ = s.partition("[")
    if bracket and head.strip() and s.endswith("]") and balanced(s[len(head) + 1 : -1]) and not set(head) & set("({'\""):
        args = [read(p) for p in pieces(s[len(head) + 1 : -1], ",")]
        name = bare(head.strip())
        if name == "Optional" and len(args) == 1:
            return True, sorted({*args[0][1], "None"})
        if name == "Union":
            return True, sorted({m for a in args for m in a[1]})
        return False, [f"{ALIASES.get(name, head.strip())}[{', '.join(map(show, args))}]"]
    return False, [ALIASES.get(bare(s), s)]


def show(e):
    return f"Union[{', '.join(e[1])}]" if e[0] else e[1][0]


def spelling(rng, depth=3):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(["int", "str", "None", "typing.Any", "Dict", "typing.List", "m.Set", "T", "'a|b,['", '"x]"', "()", "...", "f(a, b | c)"])
    sub = lambda: spelling(rng, depth - 1)
    space = lambda: rng.choice(["", "", " "])
    kind = rng.randint(0, 6)
    if kind < 2:
        return f"{space()}{sub()}{space()}|{space()}{sub()}"
    name = rng.choice(["Optional", "typing.Optional"]) if kind == 2 else rng.choice(["Union", "t.Union", "m.Union"]) if kind == 3 else rng.choice(["List", "collections.abc.Callable", "Dict", "typing.Tuple", "Callable", "Foo", "Literal"])
    args = [sub() for _ in range(1 if kind == 2 else rng.randint(1, 3))]
    if name == "Callable":
        args[0] = f"[{args[0]}]"
    return f"{name}{space()}[{(',' + space()).join(args)}]"


def test_spellings(spark):
    rng = random.Random(11)
    types = sorted({spelling(rng) for _ in range(500)}) + ["", "X[", "X]", "[", "]", "a, b", "Foo[int].Bar", "List[int", "int]", "Union[int", "A[(]"]
    got = spark.createDataFrame([(t,) for t in types], "t string").select("t", canonical_type(F.col("t")).alias("c")).collect()
    for t, c in got[: len(got)]:
        if t in ("X]", "]", "int]", "A[(]", "X[", "[", "List[int", "Union[int"):
            assert c == t
        else:
            assert c == show(read(t)), t


@pytest.mark.parametrize(("a", "b"), [("Optional[Union[int, str]]", "Union[int, str, None]"), ("Dict[str, Optional[int]]", "dict[str, int | None]"), ("List[Union[B, A]]", "list[A|B]"), ("Optional[Dict[str, Union[C, B, None]]]", "None | typing.Dict[str, Optional[B | C]]")])
def test_same_types(spark, a, b):
    row = spark.createDataFrame([(a, b, None)], "a string, b string, n string").select(canonical_type(F.col("a")), canonical_type(F.col("b")), canonical_type(F.col("n"))).first()
    assert row[0] == row[1] and row[2] is None


def test_strict_versions(spark):
    good = ["0.0.0-0", "0.0.0-1", "0.0.0-11", "0.0.0-a", "0.0.0-a.1", "0.0.0", "1.2.3-rc.1", "1.2.3", "1.2.99999999999999999999", "1.10.0", "11.0.0"]
    bad = ["1.2.3rc1", "1.2.3.4", "1.2.3garbage", "1.2", "1", "01.2.3", "", "x", "1.2.3-", "1.2.3-a..b", None]
    df = spark.createDataFrame([(v,) for v in [*reversed(good), *bad]], "v string").withColumn("k", S.semver_key(F.col("v")))
    assert [r[0] for r in df.where("k is not null").orderBy("k").collect()] == good
    assert {r[0] for r in df.where("k is null").collect()} == set(bad)
    same = spark.createDataFrame([("v1.2.3", " =1.2.3+x.5 ")], "a string, b string").select(S.semver_key(F.col("a")) == S.semver_key(F.col("b")))
    assert same.first()[0]


def test_words_are_not_patterns(spark):
    df = spark.createDataFrame([(1, "a_b", None), (2, "axb", "AXB"), (3, None, "100%"), (4, "100x", "A_B"), (5, r"a\_b", "")], "id int, x string, y string")
    ids = lambda word: [r["id"] for r in filters.topic(df, ["x", "y"], word).orderBy("id").collect()]
    assert ids("A_b") == [1, 4] and ids("0%") == [3] and ids("\\_") == [5] and ids("") == [1, 2, 3, 4, 5]


def test_too_many_terms_are_an_error(spark):
    eight = " ".join(f"t{i}" for i in range(7)) + " -secret"
    assert filters.parse_terms(eight)[-1] == ("secret", False)
    with pytest.raises(ValueError, match="9 terms"):
        filters.parse_terms("more " + eight)

"""Which version fixes a package: the lowest on its line that its advisories leave, and the walk past targets with advisories of their own.

Versions become dense numbers within (ecosystem, name), in the order of a key, and advisories' spans become intervals of these
numbers, so every question is an integer comparison behind an equi-join. Packages of the same name, version and target
are one case and meet their advisories once, however many places install them. A span with an unreadable end counts as
holding every version: what cannot be measured never clears a target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import prerelease, version_line
from .graphs import cut

_NAME = ["ecosystem", "name"]
_CASE = [*_NAME, "have", "aim"]
_END = 2**31 - 1


class Targets:
    """Packages (package_id, ecosystem, name, installed, scanner_target) and spans of advisories (ecosystem, name, advisory, introduced,
    fixed, last_affected; introduced '0' is the beginning), under the order that `key` gives versions."""

    def __init__(self, packages: DataFrame, spans: DataFrame, key):
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        self.packages = packages.select("package_id", *_NAME, text("installed").alias("have"), text("scanner_target").alias("aim"))
        cases = self.packages.select(*_CASE).distinct()
        spans = spans.select(*_NAME, "advisory", "introduced", "fixed", "last_affected")
        told = [cases.select(*_NAME, F.col(c).alias("version")) for c in ("have", "aim")] + [spans.select(*_NAME, F.col(c).alias("version")) for c in ("introduced", "fixed", "last_affected")]
        versions = told[0]
        for more in told[1:]:
            versions = versions.unionByName(more)
        versions = versions.where("version is not null").distinct().withColumn("key", key(F.col("version"))).where("key is not null")
        numbered = versions.select(*_NAME, "version", F.dense_rank().over(Window.partitionBy(*_NAME).orderBy("key")).alias("no"))
        self.numbers = cut(numbered.withColumn("line", version_line(F.col("version"))).withColumn("pre", prerelease(F.col("version"))))
        at = lambda df, c, to: df.join(self.numbers.select(*_NAME, F.col("version").alias(c), F.col("no").alias(to)), [*_NAME, c], "left")
        s = at(at(at(spans, "introduced", "lo"), "fixed", "hi"), "last_affected", "last")
        from_ = F.when(F.col("introduced") == "0", 0).otherwise(F.col("lo"))
        to = F.when(F.col("fixed").isNotNull(), F.col("hi")).when(F.col("last_affected").isNotNull(), F.col("last") + 1).otherwise(_END)
        unread = from_.isNull() | to.isNull()
        self.spans = cut(s.select(*_NAME, "advisory", F.when(unread, 0).otherwise(from_).alias("lo"), F.when(unread, _END).otherwise(to).alias("hi"), F.col("hi").alias("fix")))
        have = self.numbers.select(*_NAME, F.col("version").alias("have"), F.col("no").alias("at"), F.col("line").alias("have_line"))
        self.cases = cut(cases.join(have, [*_NAME, "have"], "left"))

    def _holding(self, places: DataFrame, number: str) -> DataFrame:
        """places x the spans that hold their version."""
        return places.join(self.spans, _NAME).where((F.col("lo") <= F.col(number)) & (F.col(number) < F.col("hi")))

    def _clean(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(case, advisory) that affect what is installed; (case, no) fixes that none of them holds; (case, lo, hi) of their spans."""
        readable = self.cases.where("at is not null and aim <> '' and have_line is not null")
        relevant = cut(self._holding(readable, "at").select(*_CASE, "at", "have_line", "advisory").distinct())
        of_them = cut(relevant.join(self.spans, [*_NAME, "advisory"]).select(*_CASE, "at", "have_line", "lo", "hi", "fix"))
        aims = relevant.select(*_CASE, "at", "have_line").distinct().join(self.numbers.select(*_NAME, F.col("version").alias("aim"), F.col("no").alias("fix")), [*_NAME, "aim"])
        wanted = of_them.where("fix is not null").select(*_CASE, "at", "have_line", "fix").unionByName(aims.select(*_CASE, "at", "have_line", "fix")).where("fix > at").distinct()
        return relevant, cut(self._free(wanted, of_them)), of_them.select(*_CASE, "lo", "hi")

    def _free(self, wanted: DataFrame, held: DataFrame) -> DataFrame:
        """Of (case, fix): releases that no span of the case's advisories holds, as (case..., no, version, line)."""
        known = self.numbers.where("not pre").groupBy(*_NAME, F.col("no").alias("fix")).agg(F.min("version").alias("version"), F.min("line").alias("line"))
        spans = held.select(*(F.col(c).alias(f"span {c}") for c in _CASE), F.col("lo").alias("span lo"), F.col("hi").alias("span hi"))
        same = [F.col(c) == F.col(f"span {c}") for c in _CASE]
        inside = (F.col("fix") >= F.col("span lo")) & (F.col("fix") < F.col("span hi"))
        on = same[0] & same[1] & same[2] & same[3] & inside
        return wanted.join(spans, on, "left_anti").join(known, [*_NAME, "fix"]).withColumnRenamed("fix", "no")

    def target_line(self) -> DataFrame:
        """(package_id, target, basis, target_line, major_jump, advisories).

        The lowest release above the installed one that none of the advisories affecting it holds: on its own line, else on
        another (a major jump). Where nothing can be measured the scanner's target stands, with basis unknown."""
        relevant, clean, _ = self._clean()
        off = F.col("line") != F.col("have_line")
        pick = clean.groupBy(*_CASE).agg(F.min(F.struct(off.alias("off"), "no", "version", "line")).alias("pick"))
        ids = relevant.groupBy(*_CASE).agg(F.array_sort(F.collect_set("advisory")).alias("advisories"))  # those of one name and version
        both = pick.join(ids, _CASE)
        out = self.packages.join(both, _CASE, "left").withColumn("jump", version_line(F.col("aim")) != version_line(F.col("have")))
        found = F.col("pick").isNotNull()
        return out.select(
            "package_id",
            F.when(found, F.col("pick.version")).otherwise(F.nullif("aim", F.lit(""))).alias("target"),
            F.when(found, "measured").otherwise("unknown").alias("basis"),
            F.when(found, F.col("pick.line")).otherwise(version_line(F.col("aim"))).alias("target_line"),
            F.when(found, F.col("pick.off")).otherwise(F.coalesce("jump", F.lit(False))).alias("major_jump"),
            F.when(found, F.col("advisories")).otherwise(F.array().cast("array<string>")).alias("advisories"),
        )

    def clean_target(self, most: int = 10) -> DataFrame:
        """(package_id, target, steps, settled, open_advisories, skipped): `target_line`'s measured target, walked up its line past
        versions that have advisories of their own.

        The fixes of an advisory met on the way become candidates too, if they are clean against what affects the installed
        version. A walk of at most `most` versions that finds none without advisories keeps the first, with what is open there."""
        _, clean, held = self._clean()
        off = F.col("line") != F.col("have_line")
        first = clean.groupBy(*_CASE).agg(F.min(F.struct(off.alias("off"), "no", "version", "line")).alias("pick")).select(*_CASE, F.col("pick.no").alias("first"), F.col("pick.line").alias("line"), F.col("pick.version").alias("version"))
        candidates = cut(clean.select(*_CASE, "no", "line").join(first.select(*_CASE, "line", "first"), [*_CASE, "line"]).where("no >= first").select(*_CASE, "no").distinct())
        lines = cut(first)
        walk = lines.select(*_CASE, F.col("first").alias("no"))
        visited = []
        for turn in range(1, most + 1):
            met = self._holding(walk, "no").select(*_CASE, "no", "advisory").distinct()
            seen = walk.join(met.groupBy(*_CASE).agg(F.array_sort(F.collect_set("advisory")).alias("open")), _CASE, "left")
            seen = cut(seen.select(*_CASE, "no", F.lit(turn).alias("turn"), F.coalesce("open", F.array().cast("array<string>")).alias("open")))
            visited.append(seen)
            going = seen.where(F.size("open") > 0)
            if turn == most or going.isEmpty():
                break
            fixes = going.withColumn("advisory", F.explode("open")).join(self.spans.where("fix is not null").select(*_NAME, "advisory", "fix"), [*_NAME, "advisory"]).where("fix > no").select(*_CASE, "fix").distinct()
            more = self._free(fixes, held).join(lines.select(*_CASE, "line"), [*_CASE, "line"]).select(*_CASE, "no")
            candidates = cut(candidates.unionByName(more).distinct())
            after = going.select(*_CASE, F.col("no").alias("now"))
            walk = cut(candidates.join(after, _CASE).where("no > now").groupBy(*_CASE).agg(F.min("no").alias("no")))
        steps = visited[0]
        for more in visited[1:]:
            steps = steps.unionByName(more)
        name = self.numbers.where("not pre").groupBy(*_NAME, "no").agg(F.min("version").alias("version"))
        steps = steps.join(name, [*_NAME, "no"])
        row = F.struct("turn", "version", "open")
        ends = steps.groupBy(*_CASE).agg(F.max(row).alias("last"), F.min(row).alias("begin"), F.array_sort(F.collect_list(F.when(F.size("open") > 0, F.struct("turn", "version")))).alias("passed"))  # `most` at most
        settled = F.size("last.open") == 0
        ends = ends.select(
            *_CASE,
            F.when(settled, F.col("last.version")).otherwise(F.col("begin.version")).alias("target"),
            F.col("last.turn").alias("steps"),
            settled.alias("settled"),
            F.when(settled, F.array().cast("array<string>")).otherwise(F.col("begin.open")).alias("open_advisories"),
            F.transform("passed", lambda p: p["version"]).alias("skipped"),
        )
        return self.packages.join(ends, _CASE).drop(*_CASE)

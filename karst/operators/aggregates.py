"""Aggregations: several measures in one pass, shares with their own denominator, unknowns kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named_measures(df: DataFrame, by: list[str], cve: str = "cve_id") -> DataFrame:
    """Rows, distinct CVEs and rows without a CVE, side by side."""
    return df.groupBy(*by).agg(F.count("*").alias("findings"), F.count_distinct(cve).alias("distinct_cves"), F.count_if(F.col(cve).isNull()).alias("without_cve"))


def filtered_counts(df: DataFrame, by: list[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()))


def share_total(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of groups and their share of the same query's total."""
    out = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return out.select(*by, "n", total.alias("total"), F.round(100.0 * F.col("n") / total, 2).alias("share_pct"))


def safe_ratio(a: Column, b: Column, digits: int = 1) -> Column:
    """100 a / b, null where b is 0."""
    return F.round(100.0 * a / F.nullif(b, F.lit(0)), digits)


def unknown_bucket(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column), F.lit("Unknown")).alias(column)).agg(F.count("*").alias("n"))


def mttr(df: DataFrame, by: list[str], start: str = "first_detected", end: str = "fixed_at") -> DataFrame:
    """Mean, median and 90th percentile of days to fix, of rows whose status is Fixed."""
    days = F.timestamp_diff("DAY", F.col(start), F.col(end))
    done = df.where("status = 'Fixed'").withColumn("_d", days)
    return done.groupBy(*by).agg(F.count("*").alias("fixed"), F.round(F.avg("_d"), 2).alias("mean_days"), F.round(F.percentile("_d", 0.5), 2).alias("median_days"), F.round(F.percentile("_d", 0.9), 2).alias("p90_days"))


def monthly_flow(df: DataFrame, start: str = "first_detected", end: str = "fixed_at") -> DataFrame:
    """New, fixed and net rows of each month and the running backlog."""
    month = lambda c: F.date_trunc("month", c).cast("date")
    events = df.select(month(start).alias("month"), F.lit(1).alias("new"), F.lit(0).alias("fixed")).unionByName(df.where(F.col(end).isNotNull()).select(month(end).alias("month"), F.lit(0).alias("new"), F.lit(1).alias("fixed")))
    out = events.groupBy("month").agg(F.sum("new").alias("new"), F.sum("fixed").alias("fixed"))
    net = F.col("new") - F.col("fixed")
    # one row a month, so the running sum is short
    return out.select("month", "new", "fixed", net.alias("net"), F.sum(net).over(Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)).alias("backlog"))


def severity_split(df: DataFrame, ranks: DataFrame, floor: int) -> DataFrame:
    """Rows at or above a rank, below it, and unclassified."""
    out = df.join(ranks, "severity", "left")
    box = F.when(F.coalesce(F.col("rnk"), F.lit(0)) == 0, "unclassified").when(F.col("rnk") >= floor, "at_or_above").otherwise("below")
    return out.groupBy(box.alias("box")).agg(F.count("*").alias("n"))


def grouping_total(df: DataFrame, by: str, column: str) -> DataFrame:
    """Distinct values of each group and overall: the groups need not add up."""
    return df.groupingSets([[F.col(by)], []], F.col(by)).agg(F.count_distinct(column).alias("n")).withColumn(by, F.coalesce(by, F.lit("all")))


def cube(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.cube(a, b).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def pivot(df: DataFrame, by: str, across: str, values: list[str]) -> DataFrame:
    """Counts of two dimensions as a table; an absent combination is 0."""
    return df.groupBy(by).pivot(across, values).agg(F.count(F.lit(1))).na.fill(0)


def alias_merge(df: DataFrame, key: list[str], rank: str, score: str, row_id: str, fix: str) -> DataFrame:
    """Alias records of a key as one: the best by (rank, score, id), all ids, a fix borrowed if the winner has none."""
    order = F.struct(F.col(rank), F.coalesce(F.col(score), F.lit(-1.0)), F.col(row_id))
    best = F.max_by(F.struct(row_id, rank, score, fix), order)
    out = df.groupBy(*key).agg(best.alias("b"), F.sort_array(F.collect_set(row_id)).alias("ids"), F.min(fix).alias("_fix"))
    return out.select(*key, *(F.col(f"b.{c}").alias(c) for c in (row_id, rank, score)), F.coalesce(f"b.{fix}", "_fix").alias(fix), "ids")


def fix_targets(df: DataFrame, by: list[str], row_id: str, fix: str, version_key: Column) -> DataFrame:
    """Per package and installed version: flaws, those without a fix, their ids, the highest fix."""
    return df.groupBy(*by).agg(F.count("*").alias("flaws"), F.count_if(F.col(fix).isNull()).alias("no_fix"), F.max_by(fix, F.when(F.col(fix).isNotNull(), version_key)).alias("highest_fix"), F.array_join(F.slice(F.sort_array(F.collect_list(row_id)), 1, 5), ",").alias("first_ids"))


def fix_candidates(df: DataFrame, by: list[str], fix: str, key: str) -> DataFrame:
    """For each distinct fix version: flaws it clears (fix at or below it) and those left open.

    Running counts over the distinct versions of a package, so flaws are not paired with versions."""
    per = df.where(F.col(fix).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("_n"), F.min(fix).alias(fix))
    total = df.groupBy(*by).agg(F.count("*").alias("_total"))
    upto = Window.partitionBy(*by).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    out = per.withColumn("cleared", F.sum("_n").over(upto)).join(total, by)
    return out.select(*by, fix, "cleared", (F.col("_total") - F.col("cleared")).alias("left_open"))


def plan_groups(df: DataFrame, fixable: str, group: Column, edit: str) -> DataFrame:
    return df.groupBy(F.col(fixable), group.alias("plan_group")).agg(F.count("*").alias("n"), F.count_distinct(edit).alias("edits"))


def edge_merge(edges: DataFrame, levels: dict[str, int]) -> DataFrame:
    """One row per edge: the highest confidence ever seen, sources gathered."""
    names = F.create_map(*(x for k, v in levels.items() for x in (F.lit(v), F.lit(k))))
    rank = F.create_map(*(x for k, v in levels.items() for x in (F.lit(k), F.lit(v))))
    out = edges.groupBy("from_key", "to_key", "edge_type").agg(F.max(rank[F.col("confidence")]).alias("_r"), F.count("*").alias("sightings"))
    return out.select("from_key", "to_key", "edge_type", names[F.col("_r")].alias("confidence"), "sightings")


def worst_of(df: DataFrame, by: list[str], verdict: str, order: list[str]) -> DataFrame:
    """The strictest verdict of a group; one not in the order ranks in the middle. It can only tighten."""
    rank = reduce(lambda a, x: a.when(F.col(verdict) == x[1], x[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(len(order) / 2)
    return df.groupBy(*by).agg(F.max_by(verdict, F.struct(rank, F.col(verdict))).alias("verdict"), F.count("*").alias("votes"))


def tree_answers(df: DataFrame, by: list[str], answer: str) -> DataFrame:
    """Merge answers of several trees: any hit is a hit, any unreadable one else makes it unavailable, absent only if all say so."""
    hit, bad, none = (F.bool_or(F.col(answer) == v) for v in ("imported", "unreadable", "inconclusive"))
    return df.groupBy(*by).agg(F.when(hit, "imported").when(bad, "unavailable").when(none, "inconclusive").otherwise("not_imported").alias("answer"), F.count("*").alias("trees"))


def default_owner(members: DataFrame, entry: str, team: str, chosen: DataFrame | None = None) -> DataFrame:
    """The team of most open members, ties by name; none makes it admin; a person's choice wins."""
    counts = members.where(F.col(team).isNotNull()).groupBy(entry, team).agg(F.count("*").alias("_n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(entry).orderBy(F.desc("_n"), team))).where("_r = 1").select(entry, F.col(team).alias("_team"))
    out = members.select(entry).distinct().join(best, entry, "left")
    if chosen is None:
        return out.select(entry, F.coalesce("_team", F.lit("admin")).alias("owner"))
    return out.join(chosen.select(entry, "choice"), entry, "left").select(entry, F.coalesce("choice", "_team", F.lit("admin")).alias("owner"))


def table_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, missing and distinct values, smallest and largest, of each column, in one scan."""
    one = df.agg(F.count("*").alias("_rows"), *(x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.count_distinct(c).alias(f"{c}__d"), F.min(F.col(c).cast("string")).alias(f"{c}__lo"), F.max(F.col(c).cast("string")).alias(f"{c}__hi"))))
    stack = ", ".join(f"'{c}', _rows, _rows - `{c}__n`, `{c}__d`, `{c}__lo`, `{c}__hi`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, n_rows, n_null, n_distinct, lowest, highest)")


def fill_and_shape(profile: DataFrame, enum: int = 25) -> DataFrame:
    """What a column looks like by its profile."""
    filled = F.col("n_rows") - F.col("n_null")
    shape = F.when(filled == 0, "empty").when(F.col("n_distinct") == 1, "constant").when(F.col("n_distinct") == filled, "key").when(F.col("n_distinct") <= enum, "enum").otherwise("high_cardinality")
    return profile.select("column_name", filled.alias("filled"), shape.alias("shape"))


def sighting_rollup(df: DataFrame, key: list[str], ts: str, reporter: str) -> DataFrame:
    return df.groupBy(*key).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("times_seen"), F.count_distinct(reporter).alias("reporters"))


def counters(df: DataFrame, spec: dict[str, tuple[Column, str]]) -> DataFrame:
    """Named counters as rows, each saying of which counter it is a part."""
    one = df.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, (c, _) in spec.items()))
    return one.selectExpr("stack(%d, %s) AS (counter, part_of, n)" % (len(spec), ", ".join(f"'{n}', '{part}', `{n}`" for n, (_, part) in spec.items())))


def run_status(df: DataFrame, by: list[str], part: str, ok: str) -> DataFrame:
    """success if all parts are, data_only if only the data part is, failed if none, else partial."""
    every, some = F.bool_and(ok), F.bool_or(ok)
    data = F.bool_or(F.when(F.col(part) == "data", F.col(ok)))
    others = F.bool_or(F.when(F.col(part) != "data", F.col(ok)))
    return df.groupBy(*by).agg(F.when(every, "success").when(~some, "failed").when(data & ~F.coalesce(others, F.lit(False)), "data_only").otherwise("partial").alias("run_status"))


def widget_series(df: DataFrame, by: str, value: Column) -> DataFrame:
    """A result as points of a series in order, for charts; one row per distinct value of `by`."""
    return df.groupBy(by).agg(value.alias("y")).select(F.col(by).cast("string").alias("x"), "y")


def permission_union(grants: DataFrame, members: DataFrame, roles: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(user, permission) over the roles (principal, role) of users and of the groups they are in (user, grp), groups within groups included.

    A permission `resource:*` stands for all actions of a resource and `*` for all there are, if the catalog (permission) of
    concrete permissions is given; each of these is matched by its own patterns, so the join is on equal text. Whoever
    has members is a group and no user; groups that hold each other are allowed."""
    from .graphs import cut

    members = members.select(F.col("user").cast("string").alias("user"), F.col("grp").cast("string").alias("grp")).where("user is not null and grp is not null").distinct()
    grants = grants.select(F.col("principal").cast("string").alias("principal"), "role").where("principal is not null").distinct()
    groups = cut(members.select(F.col("grp").alias("user")).distinct())
    # what each group is in, at any distance: new pairs only go on
    links = cut(members.join(groups, "user", "left_semi"))
    within = frontier = links
    while not frontier.isEmpty():
        step = frontier.join(links.select(F.col("user").alias("grp"), F.col("grp").alias("over")), "grp").select("user", F.col("over").alias("grp")).distinct()
        frontier = cut(step.join(within, ["user", "grp"], "left_anti"))
        within = cut(within.unionByName(frontier))
    # roles of a group are those of all groups it is in
    over = within.unionByName(groups.select("user", F.col("user").alias("grp"))).distinct()
    given = over.join(grants.select(F.col("principal").alias("grp"), "role"), "grp").select(F.col("user").alias("grp"), "role").distinct()
    people = grants.join(groups.select(F.col("user").alias("principal")), "principal", "left_anti").select(F.col("principal").alias("user"), "role")
    joined = members.join(groups, "user", "left_anti").join(given, "grp").select("user", "role")
    held = people.unionByName(joined).distinct().join(roles.select("role", "permission"), "role").select("user", "permission").distinct()
    if catalog is None:
        return held
    patterns = F.array(F.col("permission"), F.concat(F.substring_index("permission", ":", 1), F.lit(":*")), F.lit("*"))
    known = catalog.select("permission").where("permission is not null").distinct().select(F.col("permission").alias("concrete"), F.explode(F.array_distinct(patterns)).alias("permission"))
    return held.join(known, "permission").select("user", F.col("concrete").alias("permission")).distinct()

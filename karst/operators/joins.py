"""Joins that keep their gaps visible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich_coverage(left: DataFrame, right: DataFrame, key: str, condition: Column | None = None) -> DataFrame:
    """Left enrichment whose right-hand conditions are part of the match, then counted: total, joined, unmatched."""
    right = right if condition is None else right.where(condition)
    out = left.join(right.select(key).distinct().withColumn("karst hit", F.lit(1)), key, "left")
    return out.agg(F.count("*").alias("total"), F.count("karst hit").alias("joined"), F.count_if(F.col("karst hit").isNull()).alias("unmatched"))


def trust_report(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
    """Share of the left side's distinct keys that the right side lacks, and whether to rely on the join."""
    keys = left.where(F.col(key).isNotNull()).select(key).distinct()
    have = right.where(F.col(key).isNotNull()).select(key).distinct().withColumn("karst hit", F.lit(1))
    counts = keys.join(have, key, "left").agg(F.count("*").alias("keys"), F.count_if(F.col("karst hit").isNull()).alias("orphans"), F.count("karst hit").alias("_found"))
    rate = F.col("orphans") / F.nullif(F.col("keys"), F.lit(0))
    tag = F.when(rate.isNull(), "UNMEASURED").when(rate <= 0.01, "RELY").when(rate <= 0.2, "DEGRADED").otherwise("NORELY")
    return counts.select(F.lit(name).alias("join_name"), "keys", "orphans", F.round(100 * rate, 2).alias("orphan_pct"), tag.alias("trust"))


def fanout_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows before and after the join; counted by key, so the join's rows are never made."""
    a = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("a"))
    b = right.groupBy(key).agg(F.count("*").alias("b"))
    before = left.agg(F.count("*").alias("rows_before"))
    after = a.join(b, key).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("rows_after"), F.count_if(F.col("b") > 1).alias("keys_multiplied"))
    return before.join(after, F.lit(True)).withColumn("multiplies", F.col("keys_multiplied") > 0)


def governance_two_path(df: DataFrame, resolved: DataFrame, own: DataFrame, resolved_key: str, own_key: str, columns: list[str]) -> DataFrame:
    """Columns from the resolved entity where it has them, else from the own one, each by itself."""
    a = resolved.select(resolved_key, *(F.col(c).alias(f"_r_{c}") for c in columns))
    b = own.select(own_key, *(F.col(c).alias(f"_o_{c}") for c in columns))
    out = df.join(a, resolved_key, "left").join(b, own_key, "left")
    return out.select(*df.columns, *(F.coalesce(f"_r_{c}", f"_o_{c}").alias(c) for c in columns))


def owner_with_source(df: DataFrame, assets: DataFrame, repositories: DataFrame) -> DataFrame:
    """The declared team, else the repository's owner, and which of both it is."""
    out = df.join(assets.select("asset_id", "team"), "asset_id", "left").join(repositories.select("repository_id", "owner"), "repository_id", "left")
    source = F.when(F.col("team").isNotNull(), "declared").when(F.col("owner").isNotNull(), "repository").otherwise("none")
    return out.select(*df.columns, F.coalesce("team", "owner").alias("owner"), source.alias("owner_source"))


def either_key(left: DataFrame, right: DataFrame, left_id: str, keys: list[tuple[str, str]], right_id: str) -> DataFrame:
    """Match on any of several key pairs: one row per left and right row; unmatched left rows stay.

    Each key of the right side is one row with its ids, joined by equality; an OR between the keys would compare all
    pairs. Only the ids that one row matches are gathered, as many as it returns."""
    out = left
    for i, (a, b) in enumerate(keys):
        side = right.where(F.col(b).isNotNull()).groupBy(F.col(b).alias(f"_key{i}")).agg(F.collect_set(right_id).alias(f"_ids{i}"))
        out = out.join(side, F.col(a) == F.col(f"_key{i}"), "left")
    none = F.array().cast(f"array<{right.schema[right_id].dataType.simpleString()}>")
    ids = reduce(F.array_union, (F.coalesce(F.col(f"_ids{i}"), none) for i in range(len(keys))))
    return out.select(left_id, F.explode_outer(ids).alias(right_id))


def semi_running(df: DataFrame, running: DataFrame, key: str) -> DataFrame:
    return df.join(running.select(key), key, "left_semi").select(*df.columns)


def anti_orphans(df: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose owner record is gone."""
    return df.where(F.col(key).isNotNull()).join(owners.select(key), key, "left_anti").select(*df.columns)


def fallback_key(df: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Match on the first key, else on the second."""
    a = right.where(F.col(first).isNotNull()).groupBy(first).agg(F.min(value).alias("_a"))
    b = right.where(F.col(second).isNotNull()).groupBy(second).agg(F.min(value).alias("_b"))
    return df.join(a, first, "left").join(b, second, "left").select(*df.columns, F.coalesce("_a", "_b").alias(value))


def nth_occurrence(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pair the n-th left row of a key with its n-th right row, each used once; rows without a partner stay."""
    a = left.withColumn("karst n", F.row_number().over(Window.partitionBy(*key).orderBy(*left_order)))
    b = right.withColumn("karst n", F.row_number().over(Window.partitionBy(*key).orderBy(*right_order)))
    return a.join(b, [*key, "karst n"], "full_outer").withColumnRenamed("karst n", "n")


def path_suffix(changed: DataFrame, covered: DataFrame) -> DataFrame:
    """(path) against (covered_path): either ends with the other, the exact match first, then the longest.

    Joined on the base name, which such paths share."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    pairs = changed.select("path", base("path").alias("_b")).join(covered.select("covered_path", base("covered_path").alias("_b")), "_b")
    a, b = F.concat(F.lit("/"), "path"), F.concat(F.lit("/"), "covered_path")
    pairs = pairs.where(a.endswith(b) | b.endswith(a))
    best = Window.partitionBy("path").orderBy((F.col("path") != F.col("covered_path")).cast("int"), F.desc(F.length("covered_path")), "covered_path")
    hit = pairs.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("path", "covered_path")
    return changed.select("path").distinct().join(hit, "path", "left")


def line_range(points: DataFrame, ranges: DataFrame, key: str, at: str, low: str, high: str, bin_size: int = 64) -> DataFrame:
    """Points inside ranges of the same key. Ranges are put into bins of lines, so the join is on equality."""
    binned = ranges.withColumn("_bin", F.explode(F.expr(f"sequence({low} div {bin_size}, {high} div {bin_size})")))
    return points.withColumn("_bin", F.expr(f"{at} div {bin_size}")).join(binned, [key, "_bin"]).where(f"{at} BETWEEN {low} AND {high}").drop("_bin")


def policy_asof(df: DataFrame, policy: DataFrame, at: str, key: list[str], value: str) -> DataFrame:
    """The value in force when the row was raised; later changes do not move it. Of two values from one time the larger holds.

    Each version is a span up to the next one of its key, so a row meets its key's versions once and keeps one at most."""
    versions = policy.groupBy(*key, "valid_from").agg(F.max(value).alias(value))
    spans = versions.withColumn("_until", F.lead("valid_from").over(Window.partitionBy(*key).orderBy("valid_from")))
    spans = spans.select(*(F.col(k).alias(f"_of_{k}") for k in key), F.col("valid_from").alias("_from"), "_until", value)
    same = reduce(lambda p, q: p & q, (F.col(k) == F.col(f"_of_{k}") for k in key))
    held = (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return df.join(spans, same & held, "left").select(*df.columns, value)


def precedence(scoped: DataFrame, general: DataFrame, key: str) -> DataFrame:
    """A scoped mapping beats a general one."""
    both = scoped.withColumn("origin", F.lit("scoped")).unionByName(general.withColumn("origin", F.lit("tenant")))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("origin") != "scoped"))).where("_r = 1").drop("_r")


def reference_first(tenant: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Reference rows are only read through the tenant's table."""
    return tenant.join(reference, key)


def cve_intel(items: DataFrame, reference: DataFrame, key: str, score: str, cap: int) -> DataFrame:
    """Distinct CVEs of each item with reference facts; unknown ones are listed; the worst first, capped, with the total."""
    out = items.select("item_id", key).where(F.col(key).isNotNull()).distinct().join(reference, key, "left")
    order = Window.partitionBy("item_id").orderBy(F.col(score).desc_nulls_last(), key)
    out = out.withColumn("known", F.col(score).isNotNull()).withColumn("total", F.count("*").over(Window.partitionBy("item_id")))
    out = out.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= cap)
    return out.withColumn("truncated", F.col("total") > cap)


def full_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two snapshots key by key: added, removed, changed, same."""
    x = a.select(key, F.lit(True).alias("_a"), *(F.col(c).alias(f"old_{c}") for c in columns))
    y = b.select(key, F.lit(True).alias("_b"), *(F.col(c).alias(f"new_{c}") for c in columns))
    same = reduce(lambda p, q: p & q, (F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns), F.lit(True))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(same, "same").otherwise("changed")
    return x.join(y, key, "full_outer").withColumn("state", state).drop("_a", "_b")

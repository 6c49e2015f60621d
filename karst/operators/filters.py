"""Predicates and projections. A missing value is "not recorded": neither false nor zero."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_true(flag: str) -> Column:
    """False or not recorded."""
    return ~F.coalesce(F.col(flag), F.lit(False))


def distinct_from(column: str, value) -> Column:
    """Unequal, missing values included."""
    return ~F.col(column).eqNullSafe(F.lit(value))


def live_rows(df: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """Rows not marked as deleted; a table without the mark has only live rows."""
    return df.where(not_true(flag)) if flag in df.columns else df


def open_population(df: DataFrame, statuses: list[str], include_accepted: bool = False) -> DataFrame:
    """Live, of an open status, not a false positive; accepted risks only where policy includes them."""
    out = live_rows(df).where(F.col("status").isin(statuses) & not_true("is_false_positive"))
    return out if include_accepted else out.where(not_true("is_risk_accepted"))


def history_population(df: DataFrame, closed: list[str]) -> DataFrame:
    """Everything ever recorded, deleted rows too, with whether it is closed; the date says when, not whether."""
    return df.withColumn("is_closed", F.col("status").isin(closed))


def unreported_counts(df: DataFrame, flags: list[str]) -> DataFrame:
    """For each flag: rows it is true for, and rows it cannot judge."""
    return df.agg(F.count("*").alias("total"), *(c for f in flags for c in (F.count_if(F.col(f)).alias(f"{f}_true"), F.count_if(F.col(f).isNull()).alias(f"{f}_unreported"))))


def changed_set(df: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is in the changed set, and rows without a path."""
    hit = df.where(F.col(path).isNotNull()).join(changed.select(path).distinct(), path, "left_semi").select(*df.columns)
    return hit.unionByName(df.where(F.col(path).isNull()))


def closed_domain(df: DataFrame, column: str, domain: DataFrame) -> DataFrame:
    """Values outside a closed domain, with their rows."""
    seen = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return seen.join(domain.select(column), column, "left_anti")


def parse_terms(query: str, limit: int = 8) -> list[tuple[str, bool]]:
    """Words, quoted phrases and -exclusions of a query as (term, wanted); more than `limit` are an error, none is dropped."""
    found = re.findall(r'(-?)(?:"([^"]+)"|(\S+))', query)
    if len(found) > limit:
        raise ValueError(f"{len(found)} terms; at most {limit} are searched")
    return [((phrase or word).lower(), sign != "-") for sign, phrase, word in found]


def term_search(parents: DataFrame, children: DataFrame, key: str, text: str, child_text: str, query: str) -> DataFrame:
    """Parents that hold every wanted term, in their own text or in any child's, and no excluded one."""
    terms = parse_terms(query)
    marks = [F.max(F.lower(F.col(child_text)).contains(t)).alias(f"_{i}") for i, (t, _) in enumerate(terms)]
    out = parents.join(children.groupBy(key).agg(*marks), key, "left")
    for i, (t, wanted) in enumerate(terms):
        hit = F.coalesce(F.lower(F.col(text)).contains(t), F.lit(False)) | F.coalesce(F.col(f"_{i}"), F.lit(False))
        out = out.where(hit if wanted else ~hit)
    return out.select(*parents.columns)


def topic(df: DataFrame, columns: list[str], word: str) -> DataFrame:
    """Case-insensitive substring on any of several columns; no character of the word is a wildcard."""
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lower(F.lit(word))), F.lit(False)) for c in columns)))


_OPERATORS = {"eq": lambda c, v: c == v, "ne": lambda c, v: ~c.eqNullSafe(F.lit(v)), "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v, "in": lambda c, v: c.isin(v), "contains": lambda c, v: c.contains(v), "is_null": lambda c, v: c.isNull() if v else c.isNotNull()}


def expression_map(df: DataFrame, spec: dict) -> DataFrame:
    """{column: value, list or {op, value}} as a conjunction; an unknown column or operator raises."""
    for name, want in spec.items():
        if name not in df.columns:
            raise ValueError(f"no such column: {name}")
        if isinstance(want, dict):
            if want.get("op") not in _OPERATORS:
                raise ValueError(f"no such operator: {want.get('op')}")
            df = df.where(_OPERATORS[want["op"]](F.col(name), want["value"]))
        else:
            df = df.where(F.col(name).isin(want) if isinstance(want, list) else F.col(name) == want)
    return df


def time_window(df: DataFrame, column: str, as_of: str, since: str) -> DataFrame:
    """Rows of the last "24h" or "7d" before as_of."""
    number, unit = re.fullmatch(r"(\d+)([hd])", since).groups()
    return df.where(f"{column} >= {as_of} - INTERVAL '{number}' {'HOUR' if unit == 'h' else 'DAY'} AND {column} <= {as_of}")


def ttl_live(df: DataFrame, created: str, ttl_days: str, archived: str, as_of: str) -> DataFrame:
    """Entries that are not archived and not past their optional time to live."""
    return df.where(f"NOT coalesce({archived}, false) AND ({ttl_days} IS NULL OR {created} + make_dt_interval({ttl_days}) > {as_of})")


def tenant_scope(df: DataFrame, tenant: str, allowed: DataFrame) -> DataFrame:
    """Rows of the caller's tenants only."""
    return df.join(allowed.select(tenant).distinct(), tenant, "left_semi")


def label(*parts: str, separator: str = " on ") -> Column:
    """A label of the parts that are there."""
    return F.concat_ws(separator, *(F.col(p).cast("string") for p in parts))


def drop_unusable(df: DataFrame, unusable: list[str]) -> DataFrame:
    """Unusable columns may leave the projection (never a filter, join or group)."""
    return df.drop(*unusable)


def compact(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns)


def redact_rows(df: DataFrame, engine: str, engines: list[str], columns: list[str]) -> DataFrame:
    """Blank the columns of rows from engines that report secrets."""
    return df.withColumns({c: F.when(F.col(engine).isin(engines), F.lit("[REDACTED]")).otherwise(F.col(c)) for c in columns})

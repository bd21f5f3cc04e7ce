"""Pruning: which chunks of rows might match a predicate, judged by their minimum and maximum.

The rules are those of a statistics cache that must never lose a row: only 64-bit integers and floating-point
numbers prune, against a literal of their own kind; everything unknown keeps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from prunescan.plans.predicate import Predicate, Value


def _test(op: str, low: Column, high: Column, v: Column) -> Column:
    return {"Eq": (low <= v) & (high >= v), "Lt": low < v, "Gt": high > v, "Le": low <= v, "Ge": high >= v}[op]


def _leaf(stats: Column, op: str, v: Value) -> Column:
    """Might a comparison hold, given one column's statistics?"""
    if op == "Ne" or v.kind not in ("Int64", "Float64"):
        return F.lit(True)
    if v.kind == "Int64":
        kind = (stats["physical_type"] == "INT64") & ~F.coalesce(stats["logical_type"].contains("isSigned=false"), F.lit(False))
        held = _test(op, stats["min_long"], stats["max_long"], F.lit(v.value))
    else:
        kind = stats["physical_type"].isin("DOUBLE", "FLOAT")
        low, high = stats["min_double"], stats["max_double"]
        held = F.lit(False) if v.value != v.value else _test(op, low, high, F.lit(v.value))  # NaN compares with nothing
        kind = kind & low.isNotNull() & ~F.isnan(low) & ~F.isnan(high)
    return F.coalesce(F.when(kind, held), F.lit(True))


def might_match(p: Predicate, stats: str = "stats") -> Column:
    """Condition over a map of column statistics: true unless no row of the chunk can match."""
    if p.kind == "And":
        return reduce(lambda a, b: a & b, (might_match(x, stats) for x in p.parts))
    if p.kind == "Or":
        return reduce(lambda a, b: a | b, (might_match(x, stats) for x in p.parts))
    if p.kind in ("Not", "IsNull"):
        return F.lit(True)
    s = F.try_element_at(F.col(stats), F.lit(p.column))
    if p.kind == "In":
        if not p.values:
            return ~F.coalesce(s["has_stats"], F.lit(False))
        return reduce(lambda a, b: a | b, (_leaf(s, "Eq", v) for v in p.values))
    if p.kind == "Between":
        return _leaf(s, "Ge", p.values[0]) & _leaf(s, "Le", p.values[1])
    return _leaf(s, p.op, p.values[0])


def survivors(row_groups: DataFrame, p: Predicate | None) -> DataFrame:
    """The row groups that might match, with their byte and row ranges; no predicate keeps all."""
    kept = row_groups if p is None else row_groups.filter(might_match(p))
    return kept.drop("stats")


def matching(row_groups: DataFrame, predicates: dict[str, Predicate]) -> DataFrame:
    """Row groups against a set of named predicates in one pass: ``predicate`` is the name of each that might match."""
    named = F.array(*(F.when(might_match(p), F.lit(name)) for name, p in predicates.items()))
    return row_groups.withColumn("predicate", F.explode(F.array_compact(named))).drop("stats")


def zone_map(df: DataFrame, zone: Column, columns: dict[str, str]) -> DataFrame:
    """Statistics of logical chunks of rows, in the form that ``might_match`` reads.

    ``columns`` maps a column to its physical type (``INT64``, ``DOUBLE``, anything else never prunes).
    """
    bounds = [f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("min", F.min), ("max", F.max))]
    zones = df.groupBy(zone.alias("zone")).agg(F.count("*").alias("rows"), *bounds)

    def stats(i: int, kind: str) -> Column:
        low, high = F.col(f"min_{i}"), F.col(f"max_{i}")
        whole, real, none = kind == "INT64", kind in ("DOUBLE", "FLOAT"), F.lit(None)
        return F.struct(
            F.lit(kind).alias("physical_type"), F.lit("").alias("logical_type"), low.isNotNull().alias("has_stats"),
            (low if whole else none).cast("long").alias("min_long"), (high if whole else none).cast("long").alias("max_long"),
            (low if real else none).cast("double").alias("min_double"), (high if real else none).cast("double").alias("max_double"),
        )

    entries = [x for i, (c, kind) in enumerate(columns.items()) for x in (F.lit(c), stats(i, kind))]
    return zones.select("zone", "rows", F.create_map(*entries).alias("stats"))

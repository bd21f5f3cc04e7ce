"""Cache access traces: which accesses an LRU cache would serve, and how often keys are asked for."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def _distances(frame: pd.DataFrame) -> pd.DataFrame:
    """Different keys asked for since the key's last access, by a tree of counts over the trace's places."""
    frame = frame.sort_values("t", kind="stable")
    n = len(frame)
    tree, last, out = [0] * (n + 1), {}, []

    def add(i: int, d: int) -> None:
        while i <= n:
            tree[i] += d
            i += i & -i

    def total(i: int) -> int:
        s = 0
        while i:
            s += tree[i]
            i -= i & -i
        return s

    for i, key in enumerate(frame["key"], 1):
        p = last.get(key)
        out.append(total(i - 1) - total(p) if p else None)
        if p:
            add(p, -1)
        add(i, 1)
        last[key] = i
    return frame.assign(distance=pd.array(out, "Int64"))[["cache", "t", "key", "distance"]]


def reuse_distances(trace: DataFrame) -> DataFrame:
    """``cache, t, key, distance`` of a trace (``cache, t, key``): null at a key's first access.

    An LRU cache of ``c`` equal pages serves an access exactly if its distance is under ``c``, for every ``c``
    at once. Caches are independent and each is one group, so a trace spreads over as many tasks as it has caches.
    """
    kind = ", ".join(f"{c} {trace.schema[c].dataType.simpleString()}" for c in ("cache", "t", "key"))
    return trace.select("cache", "t", "key").groupBy("cache").applyInPandas(_distances, f"{kind}, distance bigint")


def hit_curve(distances: DataFrame, capacities: list[int]) -> DataFrame:
    """Share of accesses served at each capacity: ``capacity, hits, accesses, hit_rate``."""
    counts = [F.count_if(F.col("distance") < c).alias(f"h{c}") for c in capacities]
    one = distances.agg(F.count("*").alias("accesses"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("capacity"), F.col(f"h{c}").alias("hits")) for c in capacities)))
    return one.select("accesses", rows.alias("r")).select("r.capacity", "r.hits", "accesses", (F.col("r.hits") / F.col("accesses")).alias("hit_rate"))


def frequencies(trace: DataFrame) -> DataFrame:
    """Exact accesses by key."""
    return trace.groupBy("key").agg(F.count("*").alias("n"))


def sketched(trace: DataFrame, rows: int = 4, width: int = 4096) -> DataFrame:
    """Count-min estimates by key: ``key, estimate``, never under the true count.

    The sketch is ``rows`` times ``width`` sums, made with partial aggregation and sent to all tasks.
    """
    cell = lambda r: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(r), F.col("key"))), 1, 15), 16, 10).cast("long") % width
    counted = trace.groupBy("key").agg(F.count("*").alias("n"))
    cells = counted.select("n", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), cell(r).alias("c")) for r in range(rows)))).alias("x"))
    sketch = cells.groupBy("x.r", "x.c").agg(F.sum("n").alias("s"))
    each = counted.select("key", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), cell(r).alias("c")) for r in range(rows)))).alias("x"))
    return each.join(F.broadcast(sketch), (F.col("x.r") == F.col("r")) & (F.col("x.c") == F.col("c"))).groupBy("key").agg(F.min("s").alias("estimate"))


def admitted(distances: DataFrame, frequency: DataFrame, least: int = 2) -> DataFrame:
    """Accesses of keys that are asked for at least ``least`` times, the pages worth caching."""
    return distances.join(frequency.filter(F.col("n") >= least), "key", "left_semi")

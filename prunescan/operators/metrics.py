"""Operational metrics over a log of operations: counters, gauges, histograms, nearest-rank percentiles, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

#: Upper bounds of latency buckets, in the log's own unit.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def counters(log: DataFrame, key: str, value: str) -> DataFrame:
    """Requests and the sum of ``value`` by key."""
    return log.groupBy(key).agg(F.count("*").alias("requests"), F.sum(value).alias("total"))


def gauge(log: DataFrame, key: str, ts: str, delta: Column, buckets: int = 4096) -> DataFrame:
    """The running sum of ``delta`` by key in the order of ``ts`` (a number or a time), as ``level``.

    A key's log is cut into buckets of equal spans: sums of the buckets, a running sum over them, and a
    running sum within each bucket, so that no task holds a whole key. Null keys are a key, null times come first.
    """
    place = F.col(ts).cast("double") if isinstance(log.schema[ts].dataType, T.NumericType) else F.unix_micros(F.col(ts).cast("timestamp")).cast("double")
    low, high = (log.select(f(place)).scalar() for f in (F.min, F.max))
    bucket = F.when(high > low, F.floor((place - low) / (high - low) * buckets)).otherwise(F.lit(0))
    placed = log.withColumn("_bucket", F.when(place.isNull(), F.lit(-1)).otherwise(bucket))
    sums = placed.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.sum(delta).alias("_sum"))
    before = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    run = Window.partitionBy(key, "_bucket").orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = placed.withColumn("_run", F.coalesce(F.sum(delta).over(run), F.lit(0)))
    both = own.join(sums, own[key].eqNullSafe(sums["_key"]) & (own["_bucket"] == sums["_of"]))
    return both.withColumn("level", F.col("_run") + F.col("_before")).drop("_bucket", "_run", "_key", "_of", "_before")


def throughput(log: DataFrame, key: str, ts: str, size: str) -> DataFrame:
    """Operations and bytes a second between a key's first and last: ``key, ops, bytes, seconds, ops_per_second, bytes_per_second``; null rates without elapsed time."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    out = log.groupBy(key).agg(F.count("*").alias("ops"), F.sum(size).alias("bytes"), ((F.max(at) - F.min(at)) / F.lit(1_000_000)).alias("seconds"))
    rate = lambda c: F.when(F.col("seconds") > 0, F.col(c) / F.col("seconds"))
    return out.withColumns({"ops_per_second": rate("ops"), "bytes_per_second": rate("bytes")})


def histogram(log: DataFrame, key: str, value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative counts: ``key, le, n`` for every bound, ``Infinity`` last. Null and NaN values count only there."""
    counts = [F.count_if((F.col(value) <= b) & ~F.isnan(value)).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = log.groupBy(key).agg(*counts, F.count("*").alias("all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return wide.select(key, F.inline(F.array(*rows)))


def percentiles(log: DataFrame, key: str, value: str, points: tuple[int, ...] = (50, 90, 99), bins: int = 1024) -> DataFrame:
    """Nearest-rank percentiles: the value at place ``floor(n p / 100)`` (from 0, at most n - 1) of a key's sorted values.

    Exact without sorting a key's values in one place: counts in equal bins between least and largest tell
    which bin holds the rank, and only that bin's values are ranked. Nulls are left out; all others must be finite.
    """
    v = log.select(key, F.col(value).alias("v")).filter("v is not null")
    span = v.groupBy(key).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(F.lit(0))
    binned = v.join(span, key).withColumn("bin", place)
    counts = binned.groupBy(key, "bin", "n").agg(F.count("*").alias("c"))
    before = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("p", F.explode(F.array(*map(F.lit, points))))
    rank = F.least(F.floor(F.col("n") * F.col("p") / 100), F.col("n") - 1)
    wanted = counts.withColumn("rank", rank).filter("rank >= before and rank < before + c").select(key, "bin", "p", (F.col("rank") - F.col("before") + 1).alias("k"))
    ranked = binned.join(wanted.select(key, "bin").distinct(), [key, "bin"], "left_semi").withColumn("k", F.row_number().over(Window.partitionBy(key, "bin").orderBy("v")))
    return ranked.join(wanted, [key, "bin", "k"]).select(key, F.col("p").alias("percentile"), F.col("v").alias("value"))


def rates(log: DataFrame, key: str, ts: str, width: str = "1 hour", value: str | None = None) -> DataFrame:
    """Operations by key and time window with the change since the key's last window: ``key, start, ops, delta`` (and ``total``)."""
    sums = [F.sum(value).alias("total")] if value else []
    out = log.groupBy(key, F.window(ts, width).alias("w")).agg(F.count("*").alias("ops"), *sums)
    out = out.withColumn("start", F.col("w.start")).drop("w")
    return out.withColumn("delta", F.col("ops") - F.lag("ops").over(Window.partitionBy(key).orderBy("start")))


def exposition(metric: str, rows: DataFrame, label: str, value: str, kind: str = "counter") -> DataFrame:
    """Text lines of a metrics page, one a row: ``line``."""
    line = F.format_string(f'{metric}{{{label}="%s"}} %s', F.col(label).cast("string"), F.col(value).cast("string"))
    head = rows.sparkSession.range(1).select(F.lit(f"# TYPE {metric} {kind}").alias("line"))
    return head.unionByName(rows.select(line.alias("line")))

"""Structured Streaming forms: predicate scans, windowed metrics, deduplicated requests, expiry."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from prunescan.plans.predicate import Predicate


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files that appear under a path; ``files_per_trigger`` bounds a micro-batch."""
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in there.inputFiles()):  # a file: its folder, narrowed to its name
        reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def filtered(stream: DataFrame, predicate: Predicate, projection: list[str] | None = None) -> DataFrame:
    """Rows of a stream that match a predicate."""
    out = stream.filter(predicate.to_column(stream.schema))
    return out.select(*projection) if projection else out


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """``ts`` as a timestamp with zone (UTC sessions), which watermarks ask for."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed(stream: DataFrame, ts: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", value: str | None = None) -> DataFrame:
    """Counts (and sums) by key in tumbling or sliding windows; later events than the watermark are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    sums = [F.sum(value).alias("total")] if value else []
    out = event_time(stream, ts).withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("ops"), *sums)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "ops", *[c for c in ("total",) if value])


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events less than ``gap`` apart."""
    out = event_time(stream, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("ops"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "ops")


def deduplicated(stream: DataFrame, keys: list[str], ts: str, within: str = "10 seconds") -> DataFrame:
    """One of equal requests within a time span, so that only one fetches: the first to arrive (of a micro-batch any one); ``earliest`` goes by time."""
    return event_time(stream, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def earliest(requests: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The earliest request of each key, with all its columns; null times come last, any one of equal times stays.

    Over a stream it is kept as state, one row a key, and no event is too late: in ``update`` mode the keys whose earliest
    request changed come out. ``earliest`` of what came out is the same as that of all requests.
    """
    rest = F.struct(*[c for c in requests.columns if c not in keys])
    return requests.groupBy(*keys).agg(F.min_by(rest, F.struct(F.col(ts).isNull(), F.col(ts))).alias("_first")).select(*keys, "_first.*")


def fetch_leaders(log: DataFrame, key: str, ts: str, seconds: float, order: str) -> DataFrame:
    """Batch form: ``leads`` marks requests whose key wasn't asked for within ``seconds`` before."""
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(Window.partitionBy(key).orderBy(ts, order))
    return log.withColumn("leads", F.coalesce(gap >= int(seconds * 1_000_000), F.lit(True)))


def live(entries: DataFrame, cached_at: str, now: Column, ttl_seconds: int = 300) -> DataFrame:
    """Entries that haven't outlived their time."""
    age = F.unix_micros(now) - F.unix_micros(F.col(cached_at).cast("timestamp"))
    return entries.filter(age <= ttl_seconds * 1_000_000)


def lookup(requests: DataFrame, entries: DataFrame, key: str, asked_at: str, cached_at: str = "cached_at", ttl_seconds: int = 300) -> DataFrame:
    """``requests`` with ``hit``: whether the table of entries (one a key, the latest put) has one of that key that is not yet outlived when asked for."""
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = entries.select(F.col(key).alias("_entry"), F.col(cached_at).alias("_cached")).groupBy("_entry").agg(F.max("_cached").alias("_cached"))
    age = at(asked_at) - at("_cached")
    both = requests.join(known, F.col(key) == F.col("_entry"), "left")
    return both.withColumn("hit", F.coalesce((age >= 0) & (age <= ttl_seconds * 1_000_000), F.lit(False))).drop("_entry", "_cached")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that's there now into Parquet under ``folder`` and read the result.

    ``append`` writes each micro-batch's rows once; ``update`` adds the rows that each micro-batch changes to those of the
    ones before; ``complete`` keeps the last full result.
    """
    spark, name = stream.sparkSession, uuid.uuid4().hex
    out, state = f"{folder}/stream-{name}", f"{folder}/stream-state-{name}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
    else:
        kept = "append" if mode == "update" else "overwrite"
        writer.foreachBatch(lambda df, _: df.write.mode(kept).parquet(out)).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)

"""Scans: exact rows, or all rows of the row groups that might match."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from prunescan.plans.predicate import Predicate
from prunescan.plans.prune import might_match
from prunescan.sources.footer import footers, row_groups

#: Survivors are sent to all tasks up to this many; beyond, they're joined by file.
MOST_SENT = 100_000
#: Up to this many files are named in the scan's filter.
MOST_FILES = 10_000
#: Spans of one column's values in the scan's filter.
MOST_SPANS = 64


def scan(spark: SparkSession, uri: str | list[str], predicate: Predicate | None = None, projection: list[str] | None = None, mode: str = "exact") -> DataFrame:
    """Read Parquet rows.

    ``exact`` filters rows, which Catalyst pushes to the files; an unknown column raises. ``row_group`` returns all
    rows of every row group that the statistics can't rule out, a superset that another engine filters again.
    ``projection`` picks columns.
    """
    uris = [uri] if isinstance(uri, str) else uri
    df = spark.read.parquet(*uris)
    if mode == "row_group" and predicate is not None:
        df = _surviving(spark, df, predicate)
    elif mode == "exact" and predicate is not None:
        df = df.filter(predicate.to_column(df.schema))
    elif mode not in ("exact", "row_group"):
        raise ValueError(f"INVALID_REQUEST: unknown mode {mode}")
    return df.select(*projection) if projection else df


def _bounds(df: DataFrame, predicate: Predicate) -> dict[str, str]:
    """The predicate's own top-level columns whose statistics are numbers, and the kind of their bounds."""
    kinds = {"bigint": "long", "int": "long", "smallint": "long", "tinyint": "long", "double": "double", "float": "double"}
    return {f.name: kinds[f.dataType.simpleString()] for f in df.schema.fields if f.name in predicate.columns() and f.dataType.simpleString() in kinds}


def merged(spans: list[tuple], most: int = MOST_SPANS) -> list[tuple]:
    """Closed spans (low, high) joined where they overlap, then over the smallest gaps until ``most`` are left."""
    out: list[list] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)
        starts = [0, *sorted(gaps[: most - 1]), len(out)]
        out = [[out[i][0], out[j - 1][1]] for i, j in zip(starts, starts[1:])]
    return [tuple(x) for x in out]


def _within(column: str, spans: list[tuple], kind: str) -> Column:
    """True for all values of the spans, null and NaN too (NaN is above every number), in a form that files can prune by."""
    c = F.col(f"`{column}`")
    held = reduce(lambda a, b: a | b, ((c >= low) & (c <= high) for low, high in spans)) | c.isNull()
    return held | (c > spans[-1][1]) if kind == "double" else held


def _surviving(spark: SparkSession, df: DataFrame, predicate: Predicate) -> DataFrame:
    """All rows of the row groups that might match, by Spark's Parquet reader.

    Up to MOST_SENT survivors are known to the driver: their files are named in a filter on the file's path, which
    leaves the other files out of the plan, and the bounds of the predicate's columns in them become spans that
    the reader prunes row groups and pages by. Both only leave out what lies in no survivor; a semi join by file and row
    index then settles which rows stay. Beyond MOST_SENT, which is most of a large table or a very large one, the
    join alone decides.
    """
    bounds = _bounds(df, predicate)
    low, high = ({c: F.try_element_at("stats", F.lit(c))[f"{end}_{kind}"].alias(f"{end}_{i}") for i, (c, kind) in enumerate(bounds.items())} for end in ("min", "max"))
    groups = row_groups(footers(spark, df.inputFiles())).filter(might_match(predicate))
    kept = groups.select(F.regexp_replace("uri", "^file:/+", "/").alias("_uri"), "uri", "first_row", "last_row", *low.values(), *high.values())
    first = kept.limit(MOST_SENT + 1).collect()
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if len(first) > MOST_SENT:
        side = kept.select("_uri", "first_row", "last_row")
    elif not first:
        return df.limit(0)
    else:
        side = F.broadcast(spark.createDataFrame([(r["_uri"], r["first_row"], r["last_row"]) for r in first], "_uri string, first_row long, last_row long"))
        files = sorted({re.sub("^file:/+", "file:/", r["uri"]) for r in first})  # local files have other slashes in listings than in metadata
        if len(files) <= MOST_FILES:
            rows = rows.filter(F.col("_file").isin(files))
        for i, (c, kind) in enumerate(bounds.items()):
            spans = [(r[f"min_{i}"], r[f"max_{i}"]) for r in first]
            if all(a is not None and b is not None and a <= b for a, b in spans):  # no bounds, or NaN: nothing is known
                rows = rows.filter(_within(c, merged(spans), kind))
    here = F.regexp_replace(F.col("_file"), "^file:/+", "/")
    on = (here == side["_uri"]) & (F.col("_row") >= side["first_row"]) & (F.col("_row") <= side["last_row"])
    return rows.join(side, on, "left_semi").drop("_file", "_row")


def read_row_groups(spark: SparkSession, uris: list[str], predicate: Predicate | None = None, columns: list[str] | None = None) -> DataFrame:
    """All rows of the row groups that might match, of files given by name."""
    return scan(spark, uris, predicate, columns, mode="row_group")


def batch_scan(spark: SparkSession, requests: list[tuple[str, Predicate | None, list[str] | None]], mode: str = "exact") -> DataFrame:
    """Several scans as one DataFrame; ``scan_id`` is the request's place, columns that one lacks are null."""
    parts = [scan(spark, uri, p, cols, mode).withColumn("scan_id", F.lit(k)) for k, (uri, p, cols) in enumerate(requests)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

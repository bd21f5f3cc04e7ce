"""Byte ranges of files as rows, and listings of files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from prunescan.sources.footer import open_uri

#: Scheme and host of a path's uri.
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _bytes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for uri, own in frame.groupby("uri", sort=False):
            source, size = open_uri(uri)
            with source:
                for r in own.itertuples():
                    first, end = min(r.offset, size), min(r.offset + max(r.length, 0), size)
                    source.seek(first)
                    yield pd.DataFrame({"ord": [r.ord], "uri": [uri], "offset": [r.offset], "length": [end - first], "data": [source.read(end - first)]})


def read_ranges(requests: DataFrame) -> DataFrame:
    """The bytes of ranges (``ord, uri, offset, length``): ``ord, uri, offset, length, data``.

    Ranges are clamped to the file: length 0, or a start past the end, gives no bytes. A file's ranges are read
    by one task for each partition that holds some; order by ``ord`` to have the order asked for.
    """
    return requests.select("ord", "uri", "offset", "length").mapInPandas(_bytes, "ord bigint, uri string, offset bigint, length bigint, data binary")


def read_range(spark: SparkSession, uri: str, offset: int = 0, length: int | None = None) -> DataFrame:
    """One range as one row; without ``length`` up to the end of the file."""
    return read_ranges(spark.createDataFrame([(0, uri, offset, 2**62 if length is None else length)], "ord bigint, uri string, offset bigint, length bigint"))


def tails(files: DataFrame, size: int = 8) -> DataFrame:
    """Requests for the last ``size`` bytes of files (``uri, file_size``)."""
    start = F.greatest(F.col("file_size") - size, F.lit(0))
    return files.select(F.monotonically_increasing_id().alias("ord"), "uri", start.alias("offset"), F.lit(size).cast("long").alias("length"))


def list_objects(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Files under a folder, or (not ``recursive``) directly in it: ``path, length, modificationTime``; contents aren't read.

    All are listed either way, as Spark takes folders within for partitions else. A relative folder is the driver's.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "modificationTime")
    if recursive:
        return files
    own = os.path.abspath(re.sub(SCHEME, "", folder)).rstrip("/")
    return files.filter(F.regexp_replace(F.regexp_replace("path", "/[^/]*$", ""), SCHEME, "") == own)

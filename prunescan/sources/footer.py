"""Parquet footers as DataFrames: files, row groups and column chunks with their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK = (
    "column_id int, path string, physical_type string, logical_type string, has_stats boolean, min_long bigint, max_long bigint, "
    "min_double double, max_double double, null_count bigint, start_offset bigint, size bigint"
)
FOOTER = f"uri string, file_size bigint, footer_size bigint, n_rows bigint, n_row_groups int, row_group int, first_row bigint, rows bigint, chunks array<struct<{', '.join(c.replace(' ', ': ', 1) for c in CHUNK.split(', '))}>>"


def open_uri(uri: str):
    """An input file of any store that Arrow reads (file:, s3:, gs:, hdfs:), and its size; only ranges asked for are read."""
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("/", "file:")) else f"/{uri}")
    return store.open_input_file(path), store.get_file_info(path).size


def _chunk(k: int, c) -> dict:
    s = c.statistics if c.is_stats_set else None
    bounds = s is not None and s.has_min_max
    logical = str(s.logical_type) if s is not None else None
    out = {"column_id": k, "path": c.path_in_schema, "physical_type": c.physical_type, "logical_type": logical, "has_stats": s is not None}
    low, high = (s.min_raw, s.max_raw) if bounds else (None, None)
    whole = c.physical_type in ("INT32", "INT64") and bounds
    real = c.physical_type in ("FLOAT", "DOUBLE") and bounds
    out |= {"min_long": int(low) if whole else None, "max_long": int(high) if whole else None}
    out |= {"min_double": float(low) if real else None, "max_double": float(high) if real else None}
    start = c.dictionary_page_offset if c.has_dictionary_page and c.dictionary_page_offset else c.data_page_offset
    return out | {"null_count": s.null_count if s is not None and s.has_null_count else None, "start_offset": start, "size": c.total_compressed_size}


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for uri in frame["uri"]:
            source, size = open_uri(uri)
            with source:
                m = pq.ParquetFile(source).metadata
            first, file = 0, {"uri": uri, "file_size": size, "footer_size": m.serialized_size, "n_rows": m.num_rows, "n_row_groups": m.num_row_groups}
            for g in range(m.num_row_groups):
                r = m.row_group(g)
                rows.append(file | {"row_group": g, "first_row": first, "rows": r.num_rows, "chunks": [_chunk(k, r.column(k)) for k in range(r.num_columns)]})
                first += r.num_rows
            if not m.num_row_groups:
                rows.append(file | {"row_group": None, "first_row": None, "rows": None, "chunks": None})
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in FOOTER.split(", chunks")[0].split(", ")] + ["chunks"])
        yield out.astype({c: "Int64" for c in ("row_group", "first_row", "rows")})


def footers(spark: SparkSession, uris: list[str] | DataFrame) -> DataFrame:
    """One row per row group with its column chunks; a file without row groups has one row with nulls.

    ``uris`` is a list or a DataFrame with a ``uri`` column (for very many files). Each task reads the ends of
    its files only.
    """
    if isinstance(uris, DataFrame):
        files = uris.select("uri")
    else:
        files = spark.createDataFrame([(u,) for u in uris], "uri string").repartition(max(1, min(len(uris), 10_000)))
    return files.mapInPandas(_read, FOOTER)


def files(footer: DataFrame) -> DataFrame:
    """``uri, file_size, footer_size, n_rows, n_row_groups``."""
    return footer.select("uri", "file_size", "footer_size", "n_rows", "n_row_groups").distinct()


def row_groups(footer: DataFrame) -> DataFrame:
    """Byte and row ranges of the row groups, statistics by column path in ``stats``.

    ``offset`` is the least start of any chunk; ``first_column_offset`` the start of the first column, which is
    the same in most files.
    """
    chunks = F.col("chunks")
    ends = F.transform(chunks, lambda c: c["start_offset"] + c["size"])
    return footer.filter("row_group is not null").select(
        "uri", "row_group", "first_row", (F.col("first_row") + F.col("rows") - 1).alias("last_row"), "rows",
        F.array_min(F.transform(chunks, lambda c: c["start_offset"])).alias("offset"),
        chunks[0]["start_offset"].alias("first_column_offset"),
        (F.array_max(ends) - F.array_min(F.transform(chunks, lambda c: c["start_offset"]))).alias("length"),
        F.map_from_entries(F.transform(F.array_distinct(F.transform(chunks, lambda c: c["path"])), lambda p: F.struct(p, F.filter(chunks, lambda c: c["path"] == p)[0]))).alias("stats"),
    )


def column_chunks(footer: DataFrame) -> DataFrame:
    """One row per column chunk."""
    return footer.filter("row_group is not null").select("uri", "row_group", F.inline("chunks"))

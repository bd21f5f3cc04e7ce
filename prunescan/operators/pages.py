"""Fixed-size pages of files: page arithmetic, hits and misses, coalesced ranges, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Default page size: 4 MiB.
PAGE_SIZE = 4 << 20


def first_page(offset: Column, page_size: int = PAGE_SIZE) -> Column:
    """Index of the page that holds a byte."""
    return F.floor(offset / F.lit(page_size)) if page_size & (page_size - 1) else F.shiftright(offset, page_size.bit_length() - 1)


def needed_pages(ranges: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per page that a byte range (``offset``, ``length``) touches, as ``page_index``; length 0 touches none.

    Pages are made by an array per range; very long ranges are best split first.
    """
    last = first_page(F.col("offset") + F.col("length") - 1, page_size)
    pages = F.when(F.col("length") > 0, F.sequence(first_page(F.col("offset"), page_size), last))
    return ranges.withColumn("page_index", F.explode(pages))


def slices(ranges: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """The part of each page that a range needs: ``page_index, slice_start, slice_end`` (within the page)."""
    start = F.col("page_index") * page_size
    return needed_pages(ranges, page_size).withColumns({
        "slice_start": F.greatest(F.col("offset") - start, F.lit(0)),
        "slice_end": F.least(F.col("offset") + F.col("length") - start, F.lit(page_size)),
    })


def hits(need: DataFrame, cached: DataFrame, key: tuple[str, ...] = ("file_id", "page_index")) -> DataFrame:
    """Needed pages that are cached."""
    return need.join(cached, list(key), "left_semi")


def misses(need: DataFrame, cached: DataFrame, key: tuple[str, ...] = ("file_id", "page_index")) -> DataFrame:
    """Needed pages that aren't cached (nor, with their table given, in flight)."""
    return need.join(cached, list(key), "left_anti")


def coalesce_pages(pages: DataFrame, page_size: int = PAGE_SIZE, sizes: DataFrame | None = None) -> DataFrame:
    """Adjacent pages of a file as one range: ``file_id, range_start, range_end, n_pages``.

    ``sizes`` (``file_id, file_size``) clamps the last page to the end of its file.
    """
    run = F.col("page_index") - F.row_number().over(Window.partitionBy("file_id").orderBy("page_index"))
    out = pages.select("file_id", "page_index").distinct().withColumn("run", run).groupBy("file_id", "run").agg(
        (F.min("page_index") * page_size).alias("range_start"), ((F.max("page_index") + 1) * page_size).alias("range_end"), F.count("*").alias("n_pages")
    ).drop("run")
    if sizes is not None:
        out = out.join(sizes, "file_id", "left").withColumn("range_end", F.least("range_end", F.col("file_size"))).drop("file_size")
    return out


def file_info(cached: DataFrame) -> DataFrame:
    """Cached pages and bytes of each file: ``file_id, n_pages, total_bytes``; a page counts once, at its largest size."""
    once = cached.groupBy("file_id", "page_index").agg(F.max("size").alias("size"))
    return once.groupBy("file_id").agg(F.count("*").alias("n_pages"), F.sum("size").alias("total_bytes"))


def corrupt(cached: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Pages whose stored size can't be right: empty, or over twice the page size."""
    return cached.filter((F.col("size") <= 0) | (F.col("size") > 2 * page_size))


def write_pages(pages: DataFrame, path: str) -> None:
    """Store pages (``file_id, page_index, data``) as Parquet in folders by bucket of the file id."""
    pages.withColumn("bucket", F.format_string("%03d", F.pmod(F.xxhash64("file_id"), F.lit(1000)))).write.partitionBy("bucket").mode("append").parquet(path)


def read_pages(spark, path: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """Stored pages with their sizes; corrupt ones are left out."""
    df = spark.read.parquet(path).withColumn("size", F.octet_length("data"))
    return df.filter((F.col("size") > 0) & (F.col("size") <= 2 * page_size))


def assemble(ranges: DataFrame, stored: DataFrame, range_id: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """The bytes of ranges (``range_id, file_id, offset, length``) out of stored pages (``file_id, page_index, data``): ``range_id, data``.

    ``data`` is null where a page is missing or too short. Only the slices are shuffled to their range, whose bytes are one
    value, as a reply is. Ranges of length 0 have no row.
    """
    need = slices(ranges, page_size).select(range_id, "file_id", "page_index", "slice_start", "slice_end")
    wanted = F.col("slice_end") - F.col("slice_start")
    once = stored.select("file_id", "page_index", "data").dropDuplicates(["file_id", "page_index"])
    cut = need.join(once, ["file_id", "page_index"], "left").select(
        range_id, "page_index", wanted.alias("_wanted"), F.expr("substring(data, int(slice_start + 1), int(slice_end - slice_start))").alias("_piece")
    )
    whole = F.every(F.coalesce(F.octet_length("_piece") == F.col("_wanted"), F.lit(False))).alias("_whole")
    joined = cut.groupBy(range_id).agg(whole, F.expr("listagg(_piece) within group (order by page_index)").alias("_data"))
    return joined.select(range_id, F.when(F.col("_whole"), F.col("_data")).alias("data"))


def chunks(lengths: DataFrame, chunk: int = PAGE_SIZE) -> DataFrame:
    """Positions at which a stream of ``length`` bytes is cut: ``chunk_no, chunk_offset, chunk_length``."""
    at = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long")))
    return lengths.select("*", F.posexplode(at).alias("chunk_no", "chunk_offset")).withColumn("chunk_length", F.least(F.lit(chunk), F.col("length") - F.col("chunk_offset")))

"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them, one kept vector a group."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prunescan.llm.common import components, cut, stored

#: Rows of a block; two blocks and their product are what a task holds at once.
BLOCK = 2048


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True, initial=0)  # so that no square over- or underflows
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` unit centres of unit vectors ``x``, started from evenly spaced rows; an empty cell keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _assigned(batches: Iterator[pa.RecordBatch], centres: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """(did, m, v) -> one row for the home cell (home true) and one for every visited cell; ``visits`` is a bit a cell.

    Linked vectors are at most ``sqrt(2 (1 - least))`` apart and lie on either side of the plane between their homes
    ``c_i`` and ``c_j``, so one of them is within half of that of the plane: it visits the other's home.
    """
    square = (centres**2).sum(axis=1)
    reach = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * centres @ centres.T, 0)) * np.sqrt((1 - least) / 2) + 1e-6
    for batch in batches:
        if batch.num_rows:
            score = _matrix(batch.column("v")) @ centres.T
            best = score.argmax(axis=1)
            near = score >= score.max(axis=1, keepdims=True) - reach[best]
            row, cell = np.nonzero(near)
            visits = pa.array([bits.tobytes() for bits in np.packbits(near, axis=1)], pa.binary())
            kept = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(best[row] == cell), pa.array(best[row]), visits.take(pa.array(row)), *kept.columns], ["cell", "home", "own", "visits", *kept.schema.names])


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links (a, b) connect, one for each node but one of a group."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if p in parent else p
        return x

    edges = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            edges.append((x, y))
    return edges


def _compared(t: pa.Table, least: float) -> pa.Table:
    """Links of one block of home vectors with one block of vectors of their cell: counts, and a forest.

    A link counts for the home vector; for the visitor the cell of its own home counts it if the home vector
    visits that, else it is counted here.
    """
    home = np.asarray(t.column("side")) == 0
    if home.all() or not home.any():  # a visited cell without vectors of its own
        return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
    did, m, v = np.asarray(t.column("did")), np.asarray(t.column("m")), _matrix(t.column("v"))
    linked = v[home] @ v[~home].T >= least
    linked &= did[home][:, None] != did[~home][None, :]
    n = linked @ m[~home]
    visits = np.unpackbits(np.frombuffer(b"".join(t.column("visits").filter(pa.array(home)).to_pylist()), np.uint8).reshape(home.sum(), -1), axis=1)
    once = (linked & (visits[:, np.asarray(t.column("own"))[~home]] == 0)).T @ m[home]
    i, j = np.nonzero(linked)
    edges = _forest(did[home][i], did[~home][j])
    dids, n = np.concatenate([did[home], did[~home]]), np.concatenate([n, once])
    some = n > 0
    a = np.concatenate([dids[some], np.array([e[0] for e in edges], np.int64)])
    b = np.concatenate([np.full(some.sum(), -1), np.array([e[1] for e in edges], np.int64)])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(np.concatenate([n[some], np.zeros(len(edges), np.int64)]), pa.int64())})


def _links(d: DataFrame, least: float, cells: int | None) -> DataFrame:
    """``a, b, n`` for distinct vectors ``did, m, v`` of one dimension: link counts (b is -1) and connecting edges."""
    spark = d.sparkSession
    k = cells or min(1024, math.isqrt(d.count()) // 4 + 1)
    sample = d.orderBy(F.xxhash64("v"), "did").limit(32 * k).select("v").toArrow()
    centres = _matrix(sample.column("v"))
    centres = spark.sparkContext.broadcast(spherical_kmeans(centres, k))
    kind = d.schema["v"].dataType.simpleString()
    placed = stored(d.mapInArrow(lambda it: _assigned(it, centres.value, least), f"cell long, home boolean, own long, visits binary, did long, m long, v {kind}"))
    sizes = placed.groupBy("cell").agg(F.count_if("home").alias("h"), F.count("*").alias("all")).collect()  # one row a cell
    cuts = {side: F.create_map(*(F.lit(x) for r in sizes for x in (r.cell, -(-r[side] // BLOCK)))) for side in ("h", "all")}
    part = lambda side: F.pmod(F.xxhash64("did"), F.greatest(F.element_at(cuts[side], F.col("cell")), F.lit(1)))
    every = lambda side: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.element_at(cuts[side], F.col("cell")), F.lit(1)).cast("long") - 1))
    homes = placed.filter("home").select("cell", part("h").cast("long").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), "own", "visits", "did", "m", "v")
    others = placed.select("cell", every("h").alias("i"), part("all").cast("long").alias("j"), F.lit(1).alias("side"), "own", "visits", "did", "m", "v")
    pairs = homes.unionByName(others).groupBy("cell", "i", "j")
    return pairs.applyInArrow(lambda t: _compared(t, least), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9, cells: int | None = None) -> DataFrame:
    """Links of cosine ``least`` or more: the id column, ``n_links``, ``component_id``, ``kept`` for every input row.

    Equal vectors, however many, are compared once with their number as weight. Centres are fitted on the 32
    vectors a cell of smallest hash (a bounded sample); every vector has one home cell and visits all cells to
    whose dividing plane it is nearer than half the distance of two vectors that only just link. Of two linked
    vectors at least one visits the other's home, whatever the data and their dimension, so no link is missed. A
    home vector is compared with all that are in its cell, in blocks of ``BLOCK`` rows, so a crowded cell is
    many tasks. Every product is exact in double precision, so no link is wrong.

    ``cells`` are by default a quarter of the square root of the vectors' number, up to 1024, which is what the driver can
    fit; beyond about 17 million vectors cells grow instead and are cut into more blocks, with the same result. As
    no link may be missed, vectors that spread evenly over many dimensions visit a good part of all cells, and
    work grows faster than the data; near copies of few kinds visit few.

    ``n_links`` counts other rows; ``component_id`` is the smallest id reachable; ``kept`` marks the row whose id
    that is. Vectors that are null, empty, zero, or hold null or non-finite components have no links and are
    their own component, as are those of a null id without links (``component_id`` null). Vectors of different
    length never link. Other columns are not read. An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(finite, F.lit(False)), F.col("v")))
    same = rows.filter("v is not null").groupBy("v").agg(F.count("*").alias("m"), F.min("vec_id").alias("least"))
    d = stored(same.withColumn("did", F.monotonically_increasing_id()))
    links = None
    for r in d.groupBy(F.size("v").alias("n")).count().collect():
        one = _links(d.filter(F.size("v") == r.n).select("did", "m", "v"), least, cells)
        links = one if links is None else links.unionByName(one)
    if links is None:
        links = d.select(F.col("did").alias("a"), F.col("did").alias("b"), F.lit(0).alias("n")).limit(0)
    links = cut(links)
    counts = links.filter("b < 0").groupBy(F.col("a").alias("did")).agg(F.sum("n").alias("n"))
    whole = components(links.filter("b >= 0"))
    c = d.join(counts, "did", "left").join(whole, F.col("did") == F.col("node"), "left").withColumn("component", F.coalesce("component", "did"))
    smallest = c.groupBy("component").agg(F.min("least").alias("component_id"))
    c = c.join(smallest, "component").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    out = rows.join(c, "v", "left")
    root = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(F.col("vec_id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))

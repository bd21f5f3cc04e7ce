"""Substring dedup: relative Lempel-Ziv factors against indexed reference blocks of all documents.

Every document is cut into reference blocks where the smallest hash of a short word run (the block's seed)
changes within a sliding window; equal windows have equal seeds, wherever they stand. The index knows for each
seed which document holds it first, and where, and whether all its blocks read alike. A document is then parsed
greedily from left to right: a block known from an earlier document opens a factor that refers to it, and the factor
goes on as long as the next block is the next one there too. A block covers at least one window, so every factor is
long enough. Where blocks of a seed differ, which happens at the ends of common passages, the factor's boundary is
checked by looking up the windows of each different block one by one. The words of all factors and of the windows
matched at their boundaries make up the duplicate spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from prunescan.llm.common import sliced, stored

#: Stands for a null document id, which counts as after all others.
LAST = 2**63 - 1
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _joined(x: np.ndarray, a: int, y: np.ndarray, b: int) -> np.ndarray:
    """Hashes of runs of ``a + b`` words from those of runs of ``a`` (x) and of ``b`` words (y)."""
    n = max(0, len(y) - a)
    return x[:n] * np.uint64(pow(int(_MUL), b, 1 << 64)) + y[a : a + n]


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes, by runs of 1, 2, 4 and so on."""
    out, have, run, size = None, 0, h, 1
    while True:
        if k & size:
            out = run if out is None else _joined(out, have, run, size)
            have += size
        if have == k:
            return _mixed(out)
        run, size = _joined(run, size, run, size), 2 * size


def _least(x: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` consecutive values, by spans of 1, 2, 4 and so on."""
    have = 1
    while 2 * have <= span:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    rest = span - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def windows(words: list[bytes], window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a document: its seed and its hash, both int64. Fewer words than a window: none."""
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    least = _least(_runs(h, seed_words), window - seed_words + 1)
    return least.view(np.int64), _runs(h, window).view(np.int64)


def _cut_up(seeds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of every reference block and the blocks' hashes."""
    at = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1]))
    return at, np.add.reduceat(_mixed(hashes.view(np.uint64)), at).view(np.int64)


def _texts(batch: pa.RecordBatch, at: int) -> list:
    return batch.column(at).cast(pa.binary()).to_pylist()


def factors(n: np.ndarray, ref: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy parse of a document's known blocks: (first block, last block, document referred to).

    ``n`` are the numbers of the known blocks in order, ``ref`` and ``place`` the document and the number of the block
    that each refers to. A factor goes on while both it and what it refers to go on.
    """
    if not len(n):
        return []
    new = np.append(True, (np.diff(n) != 1) | (np.diff(ref) != 0) | (np.diff(place) != 1))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(n)) - 1
    return list(zip(n[first].tolist(), n[last].tolist(), ref[first].tolist()))


def _blocks(batches: Iterator[pa.RecordBatch], window: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """(doc, text) -> (seed, doc, block, n): one row per reference block, ``n`` its number in the document."""
    for batch in sliced(batches):
        out: list[tuple] = []
        for doc, text in zip(batch.column(0).to_pylist(), _texts(batch, 1)):
            seeds, hashes = windows((text or b"").split(), window, seed_words)
            if len(seeds):
                at, block = _cut_up(seeds, hashes)
                out.append((seeds[at], np.full(len(at), doc), block, np.arange(len(at), dtype=np.int32)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["seed", "doc", "block", "n"])


def _uneven(batches: Iterator[pa.RecordBatch], window: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """(doc, text, seeds) -> (seed, hash, doc): the different windows of the named seeds."""
    for batch in sliced(batches):
        out: list[tuple] = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), _texts(batch, 1), batch.column(2)):
            seeds, hashes = windows((text or b"").split(), window, seed_words)
            hit = np.unique(np.stack([seeds, hashes])[:, np.isin(seeds, np.asarray(wanted.values))], axis=1)
            out.append((*hit, np.full(hit.shape[1], doc)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["seed", "hash", "doc"])


def _factored(batches: Iterator[pa.RecordBatch], window: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """(text, known, single) -> (n_words, n_removed, kept, factors): drops the words of the factors and of single windows."""
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("doc", pa.int64())]))
    for batch in sliced(batches):
        n_words, n_removed, kept, found = [], [], [], []
        for text, known, single in zip(_texts(batch, 0), batch.column(1), batch.column(2)):
            words, n, own = (text or b"").split(), 0, []
            n_words.append(len(words))
            if known.is_valid or single.is_valid:
                seeds, hashes = windows(words, window, seed_words)
                hit = np.zeros(len(seeds), bool)
                if known.is_valid and len(seeds):
                    at, block = _cut_up(seeds, hashes)
                    number, its, ref, place = (np.asarray(known.values.field(c)) for c in ("n", "block", "ref", "place"))
                    mine = np.flatnonzero(block[np.minimum(number, len(at) - 1)] == its)  # rows that share an id may differ
                    mine = mine[np.unique(number[mine], return_index=True)[1]]
                    mine, at = mine[number[mine] < len(at)], np.append(at, len(seeds))
                    for first, last, doc in factors(number[mine], ref[mine], place[mine]):
                        hit[at[first] : at[last + 1]] = True
                        own.append({"first": at[first], "end": at[last + 1] - 1 + window, "doc": doc})
                if single.is_valid:
                    hit |= np.isin(hashes, np.asarray(single.values))
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.flatnonzero(hit)
                edge[starts] += 1
                edge[starts + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                n = int(gone.sum())
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            n_removed.append(n)
            found.append(own)
            kept.append(b" ".join(words))
        rest = batch.select(range(3, batch.num_columns)).columns
        own = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, kind)]
        yield pa.RecordBatch.from_arrays([*rest, *own], [*batch.schema.names[3:], "n_words", "n_removed", "kept_sha256", "kept", "factors"])


def drop_repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 13, seed_words: int = 5) -> DataFrame:
    """Remove every word covered by a ``window`` of words that also starts in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input. Returns the id column,
    ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space, UTF-8), ``kept``
    (that text) and ``factors`` (word spans ``first`` to ``end`` with the earlier document ``doc`` that each repeats)
    for every input row.

    The index holds one row per reference block, about a third as many as words. Seeds are counted with
    partial aggregation, so a passage that very many documents share is one row per task; only minima and
    maxima meet. A document's matched seeds are at most its own blocks. Block and window hashes are 64 bits
    and count only under an equal 64-bit seed.

    Null or empty texts, and those shorter than a window, keep all words. A null id counts as after all
    others; rows that share an id are one document to each other, and each keeps its row. Other columns are
    not returned, so clashing names do no harm. An empty table gives no rows.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    d = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.col(text).alias("text"), F.col(doc_id).alias("id"))
    size = (window, seed_words)
    blocks = d.select("doc", "text").mapInArrow(lambda it: _blocks(it, *size), "seed long, doc long, block long, n int")
    index = blocks.groupBy("seed").agg(F.min("doc").alias("ref"), F.min_by("n", "doc").alias("place"), F.max("doc").alias("last"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    index = index.filter("ref < last").select("seed", "ref", "place", (F.col("b0") == F.col("b1")).alias("alike"))
    hits = stored(blocks.join(index, "seed").filter("doc > ref or not alike"))
    uneven = hits.filter("not alike").drop("ref", "place")
    own = uneven.groupBy("seed", "block").agg(F.min("doc").alias("ref"), F.min_by("n", "doc").alias("place"))
    uneven = uneven.join(own, ["seed", "block"])
    known = hits.filter("alike").unionByName(uneven.filter("doc > ref"), allowMissingColumns=True)
    known = known.groupBy("doc").agg(F.collect_list(F.struct("n", "block", "ref", "place")).alias("known"))
    unsure = uneven.filter("doc = ref").groupBy("doc").agg(F.collect_set("seed").alias("seeds"))
    single = stored(d.select("doc", "text").join(unsure, "doc").mapInArrow(lambda it: _uneven(it, *size), "seed long, hash long, doc long"))
    first = single.groupBy("seed", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    single = single.join(first, ["seed", "hash"]).filter("doc > first").groupBy("doc").agg(F.collect_set("hash").alias("single"))
    flags = known.join(single, "doc", "full")
    rows = d.join(flags, "doc", "left").select("text", "known", "single", "id")
    out = rows.mapInArrow(lambda it: _factored(it, *size), f"id {id_type}, n_words long, n_removed long, kept_sha256 string, kept string, factors array<struct<first long, end long, doc long>>")
    return out.withColumnRenamed("id", doc_id)

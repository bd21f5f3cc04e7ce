"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of passages with test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prunescan.llm.common import sliced

TOKEN = re.compile(r"\w+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return TOKEN.findall(text.lower().replace("_", " "))


@dataclass
class Items:
    """One block of test items: token ids (from 1; 0 is any other token) and the n-gram seeds of each.

    ``sizes`` are the lengths of the seeds: ``n``, and those of the items that are shorter.
    """

    n: int
    sizes: list[int] = field(default_factory=list)
    vocabulary: dict[str, int] = field(default_factory=dict)
    ids: list = field(default_factory=list)
    tokens: list[np.ndarray] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    owners: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    places: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def encode(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def grams(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of ``size`` tokens that hold known tokens only."""
        m = len(ids) - size + 1
        if m < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        known = np.lib.stride_tricks.sliding_window_view(ids > 0, size).all(axis=1)
        at = np.flatnonzero(known)
        h = np.full(len(at), size, np.uint64)
        for j in range(size):
            h = (h + ids[at + j].astype(np.uint64)) * _MUL
            h ^= h >> np.uint64(29)
        return at, h


def read_items(rows: list[tuple], n: int) -> Items:
    """Encode items (id, text); every n-gram of an item is a seed until ``keep_rare``. Items without tokens match nothing."""
    items = Items(n)
    for item, text in rows:
        words = tokens(text or "")
        for w in words:
            items.vocabulary.setdefault(w, len(items.vocabulary) + 1)
        items.ids.append(item)
        items.tokens.append(items.encode(words))
    return items


def keep_rare(items: Items, counts: np.ndarray, total: int, chance: float) -> None:
    """Keep as seeds the n-grams expected at most ``chance * total`` times among ``total`` tokens drawn by their shares.

    The expectation comes from the corpus counts of the single tokens, so a passage that leaked into very many
    documents doesn't make its own seeds look common. An item with no such n-gram keeps its rarest. One that is
    shorter than ``n`` tokens is a seed as a whole; if that isn't improbable, finding it proves nothing and
    the item is matched nowhere.
    """
    share = np.log((counts + 1.0) / (total + len(counts)))
    seeds, owners, places = [], [], []
    for k, ids in enumerate(items.tokens):
        size = min(items.n, len(ids))
        at, h = items.grams(ids, size) if size else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        if len(at):
            expected = share[np.lib.stride_tricks.sliding_window_view(ids, size)].sum(axis=1)
            good = (expected <= np.log(chance)) | (expected == expected.min()) & (size == items.n)
            seeds.append(h[good])
            owners.append(np.full(good.sum(), k))
            places.append(at[good])
            if good.any() and size not in items.sizes:
                items.sizes.append(size)
    if seeds:
        h, owner, place = np.concatenate(seeds), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        items.seeds, items.owners, items.places = h[order], owner[order], place[order]


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Smith-Waterman local alignment of two token sequences: best score, and where it begins and ends in ``b``.

    One row per token of ``a``; within a row, gaps along ``b`` are a running maximum. Unknown tokens (0) match nothing.
    """
    m = len(b)
    score, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0)
    steps = gap * np.arange(m + 1)
    for x in a:
        diagonal = score[:-1] + np.where((b == x) & (x > 0), match, mismatch)
        down = score[1:] + gap
        row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
        take = diagonal >= down
        value = np.where(take, diagonal, down)
        source = np.where(take, start[:-1], start[1:])
        row[1:], origin[1:] = np.where(value > 0, value, 0), np.where(value > 0, source, origin[1:])
        level = row - steps
        along = np.maximum.accumulate(level)
        lead = np.maximum.accumulate(np.where(level == along, np.arange(m + 1), 0))
        spread = along + steps
        grown = spread > row
        origin = np.where(grown, origin[lead], origin)
        score, start = np.where(grown, spread, row), origin
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (int(score[k]), int(start[k]), k)
    return best


def matches(items: Items, ids: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """Items that a document's tokens contain: (item place, score share, first token, end)."""
    spots: dict[int, set[int]] = {}
    for size in items.sizes:
        at, h = items.grams(ids, size)
        low = np.searchsorted(items.seeds, h, "left")
        some = np.flatnonzero(items.seeds[np.minimum(low, len(items.seeds) - 1)] == h)
        high = np.searchsorted(items.seeds, h[some], "right")
        for k, end in zip(some, high):
            for s in range(low[k], end):
                spots.setdefault(int(items.owners[s]), set()).add(int(at[k] - items.places[s]))
    out = []
    for owner, offsets in spots.items():
        own, best = items.tokens[owner], (0, 0, 0)
        slack, done = len(own) // 4 + items.n, -1
        for offset in sorted(offsets):  # where the item would begin; near ones share a window
            if offset <= done:
                continue
            first, end = max(0, offset - slack), min(len(ids), offset + len(own) + 2 * slack)
            done = offset + slack
            score, a, b = align(own, ids[first:end])
            if score > best[0]:
                best = (score, first + a, first + b)
        share = best[0] / (2 * len(own))
        if share >= least:
            out.append((owner, share, best[1], best[2]))
    return out


def _tally(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(len(items.vocabulary) + 1, np.int64)
    for batch in sliced(batches):
        for text in batch.column(0).to_pylist():
            if text:
                counts += np.bincount(items.encode(tokens(text)), minlength=len(counts))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["token", "n"])


def _find(batches: Iterator[pa.RecordBatch], items: Items, least: float) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows, found = [], []
        for k, text in enumerate(batch.column(0).to_pylist()):
            if text:
                hit = matches(items, items.encode(tokens(text)), least)
                rows += [k] * len(hit)
                found += hit
        kept = batch.take(pa.array(rows, pa.int64()))
        own = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([kept.column(1), *own], ["doc_id", "item", "score", "first_token", "end_token"])


def blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of at most about ``block_chars`` characters, one block on the driver at a time."""
    rows = benchmark.select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")).filter("text is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item, r.text))
        size += len(r.text)
    yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", n: int = 4, chance: float = 1e-6, least: float = 0.6, block_chars: int = 16 << 20) -> DataFrame:
    """Which documents hold which test items: ``doc_id, item_id, score, first_token, end_token``.

    Tokens are lower-cased runs of letters and digits. Seeds are the items' n-grams of ``n`` tokens whose expected
    share of the corpus, from its token counts, is at most ``chance``. Wherever a document has a seed, the
    passage around it is aligned with the whole item; the pair is returned if the local alignment (match 2,
    mismatch and gap -1) reaches ``least`` of the item's perfect score, so copies with some words
    changed, left out or put in are found too.

    The items are sent to the tasks in blocks of ``block_chars`` characters, which bounds the broadcast; a larger
    benchmark takes more passes over the documents. Documents are neither shuffled nor grouped, so an item
    that leaked into very many documents costs one alignment in each.

    Items under ``n`` tokens are matched whole, if their tokens are improbable enough together. Null and empty texts,
    and items without tokens, match nothing. Repeated rows are each judged; a null
    id is returned as null. Other columns are not read. Empty tables give no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    id_type, item_type = d.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_id].dataType
    out = None
    for rows in blocks(benchmark, item_id, item_text, block_chars):
        items = read_items(rows, n)
        sent = spark.sparkContext.broadcast(items)
        tally = d.select("text").mapInArrow(lambda it, s=sent: _tally(it, s.value), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros(len(items.vocabulary) + 1)
        for r in tally:  # one row per token of the block's items
            counts[r.token] = r.n
        keep_rare(items, counts, int(counts.sum()), chance)
        seeded = spark.sparkContext.broadcast(items)
        found = d.mapInArrow(lambda it, s=seeded: _find(it, s.value, least), f"doc_id {id_type}, item long, score double, first_token int, end_token int")
        names = spark.createDataFrame(list(enumerate(items.ids)), f"item long, item_id {item_type.simpleString()}")
        found = found.join(F.broadcast(names), "item").drop("item")
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "score", "first_token", "end_token")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns. Rows with a null id are judged too, as one document."""
    leaks = contaminated(docs, benchmark, text, doc_id, **options).select(F.col(doc_id).alias("_leak")).distinct()
    return docs.join(leaks, docs[doc_id].eqNullSafe(leaks["_leak"]), "left_anti")

"""Toxicity: maximum-scoring segments of token log-odds with Dirichlet priors, under extreme-value calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from prunescan.llm.common import cut, sliced, stored

TOKEN = re.compile(r"[^\W\d_]+")
#: Lengths of stems, longest first.
STEMS = (5, 4)
#: Width of the calibration's steps, and the statistic of texts without tokens, which is under that of any other.
STEP, LOW = 0.25, -1e6


@dataclass(frozen=True)
class Model:
    """Scores of tokens and stems, the score of all other tokens, and the decay rate of chance segments (``rate``)."""

    scores: dict[str, float]
    other: float
    rate: float

    @cached_property
    def known(self) -> frozenset[str]:
        """First letters of all scored tokens and stems."""
        return frozenset(k[: STEMS[-1]] for k in self.scores)

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        """Places of the words that have a score of their own, else by their longest stem in the model."""
        get, known, out = self.scores.get, self.known, []
        for i, w in enumerate(words):
            if w[: STEMS[-1]] in known:
                s = next((s for k in (w, *stems(w)) if (s := get(k)) is not None), None)
                if s is not None:
                    out.append((i, s))
        return out


def tokens(text: str) -> list[str]:
    """Runs of letters, lower-cased; digits, marks and underscores separate them."""
    return TOKEN.findall(text.lower())


def stems(word: str) -> list[str]:
    """A word's stems, longest first: its first letters and ``*``. They stand for its inflected forms."""
    return [f"{word[:n]}*" for n in STEMS if len(word) > n]


def segments(hits: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) in one pass of linear time over a sequence.

    ``hits`` are places with their scores in order; every place between scores ``other`` (negative). Each
    positive place opens a segment, which swallows the earlier ones from the nearest that started lower as
    long as those ended lower too; what remains are the segments that no extension improves. Every segment
    keeps the index of the nearest one that started lower, so a search steps from one to the next and never
    comes back to those between: they started higher, and so can't be what a later search looks for.
    """
    open_: list[tuple[float, float, int, int, int]] = []  # sum before, sum after, first place, end, nearest that started lower
    total, at = 0.0, 0
    for place, score in hits:
        total += other * (place - at)
        at = place + 1
        before, total = total, total + score
        if score <= 0:
            continue
        low, first, j = before, place, len(open_) - 1
        while True:
            while j >= 0 and open_[j][0] >= low:
                j = open_[j][4]
            if j < 0 or open_[j][1] >= total:
                break
            low, _, first, _, lower = open_[j]
            del open_[j:]
            j = lower
        open_.append((low, total, first, place + 1, j))
    return [(first, end, after - low) for low, after, first, end, _ in open_]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        by = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[toxic].update(set(tokens(text or "")))
        for c in by:
            for word, n in list(c.items()):
                for stem in stems(word):
                    c[stem] += n
        words = list(by[0] | by[1])
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in by)], ["token", "clean", "toxic"])


def fit(docs: DataFrame, labels: DataFrame, prior: float = 0.1, least_z: float = 4.0, most_rows: int = 1 << 20) -> Model:
    """Learn token scores from labelled rows: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic).

    Texts that are equal count once (toxic if any copy is), and so does a token in a text. A token's score is the
    difference of its log-odds in toxic and clean texts, each smoothed by a Dirichlet prior in proportion to the
    token's share of all text, with ``prior`` times all counts as its weight. Stems are scored alike, so that a form
    not seen in learning has its stem's score. Tokens whose difference is under ``least_z`` standard errors share one
    score, the log ratio of how often such tokens occur, which is below zero. All such tokens are in the model.

    With more than ``most_rows`` labelled rows the classifier is fitted on a sample of about that many, those whose
    id has the least hash. This bounds the ids that are sent to the tasks, and with them the tokens that can reach
    ``least_z`` and so the model. With no toxic or no clean text the model is empty.
    """
    d = docs.select("doc_id", "text")
    y = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = most_rows / max(1, y.count())
    if share < 1:
        y = y.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    once = d.select("doc_id", F.xxhash64("text").alias("k"), F.length("text").alias("n")).join(y, "doc_id")
    once = once.groupBy("k", "n").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "toxic")
    counts = d.join(F.broadcast(stored(once)), "doc_id").select("text", "toxic").mapInArrow(_counts, "token string, clean long, toxic long")
    counts = cut(counts.groupBy("token").agg(F.sum("clean").cast("double").alias("y0"), F.sum("toxic").cast("double").alias("y1")))
    n0, n1 = counts.filter(~F.endswith("token", F.lit("*"))).agg(F.sum("y0"), F.sum("y1")).first()
    if not n0 or not n1:
        return Model({}, -1.0, 1.0)
    a, a0 = prior * (F.col("y0") + F.col("y1")), prior * (n0 + n1)
    odds = lambda y, n: F.log((F.col(y) + a) / (n + a0 - F.col(y) - a))
    z = (odds("y1", n1) - odds("y0", n0)) / F.sqrt(1 / (F.col("y1") + a) + 1 / (F.col("y0") + a))
    kept = counts.withColumns({"score": odds("y1", n1) - odds("y0", n0), "z": z, "p0": (F.col("y0") + a) / (n0 + a0), "p1": (F.col("y1") + a) / (n1 + a0)})
    kept = kept.filter(F.abs("z") >= least_z).select("token", "score", "p0", "p1").orderBy("token").collect()  # bounded by the sample
    scores = {r.token: r.score for r in kept}
    top = [r for r in kept if not any(t in scores for t in stems(r.token.rstrip("*")))]  # what has no stem in the model
    rest = max(1e-9, 1 - sum(r.p1 for r in top)), max(1e-9, 1 - sum(r.p0 for r in top))
    other = min(-1e-3, math.log(rest[0] / rest[1]))
    return Model(scores, other, _rate([r.score for r in top] + [other], [r.p0 for r in top] + [rest[1]]))


def _rate(scores: list[float], shares: list[float]) -> float:
    """The positive solution of sum(share * exp(rate * score)) = 1: how fast chance segment scores decay."""
    s, p = np.array(scores), np.array(shares) / sum(shares)
    if s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * s)).sum() < 1 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, high)
    return high


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    for batch in sliced(batches):
        lengths, found = [], []
        for text in batch.column(0).to_pylist():
            words = tokens(text or "")
            lengths.append(len(words))
            found.append([{"first": a, "end": b, "score": s} for a, b, s in segments(model.hits(words), model.other)])
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lengths, pa.int32()), pa.array(found, kind)], [*batch.schema.names[1:], "n_tokens", "segments"])


def _calibrated(batches: Iterator[pa.RecordBatch], at: list[float], rate: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = np.asarray(batch.column(0))
        score = 0.998 * np.interp(x, at, rate) + 0.001 * (1 + x / (8 + np.abs(x))) if at else np.zeros(len(x))  # beyond the last step still in order
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], [*batch.schema.names[1:], "score"])


def _monotone(table: list[tuple[float, int, int]]) -> tuple[list[float], list[float]]:
    """Rates of label 1 by step (place, rows, label-1 rows), smoothed, pooled until they don't fall."""
    n, t = sum(r[1] for r in table), sum(r[2] for r in table)
    pools: list[list] = []
    for place, rows, ones in sorted(table):
        pools.append([[place], rows + 1, ones + t / n])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return [p for places, _, _ in pools for p in places], [ones / rows for places, rows, ones in pools for _ in places]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", significance: float = 0.01) -> DataFrame:
    """Score every row's whole text: the id column, ``held_out``, ``score``, ``predicted``, ``n_tokens``, ``passages``.

    Tokens score by the model of ``fit``, learned from labelled rows that are not held out. A linear scan finds
    all maximal segments. By extreme-value theory a clean text of n tokens holds ``K n exp(-rate S)`` segments
    of score S or more; ``rate`` follows from the token shares and K from the best segments of the clean
    learning rows. A text's statistic is the sum of ``rate S - log(K n)`` over its segments that are rarer than
    once, or that of its best segment; the share of label 1 among learning rows by that statistic, made
    monotone, is ``score``. ``predicted`` is 1 from 0.5 on. ``passages`` are the segments (token places) that
    a clean text holds with a chance of at most ``significance``.

    Null, empty and wordless texts have the lowest statistic and so the lowest score. Repeated rows are each
    scored. A row with a null id is scored and never learned from. Without labels of both kinds every score
    is 0. Other columns are not read. An empty table gives no rows.
    """
    d = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).alias("doc_id"))
    y = labels.select("doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    model = fit(d, y)
    sent = d.sparkSession.sparkContext.broadcast(model)
    id_type = d.schema["doc_id"].dataType.simpleString()
    seen = cut(d.mapInArrow(lambda it: _scan(it, sent.value), f"doc_id {id_type}, n_tokens int, segments array<struct<first int, end int, score double>>"))
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    learn = y.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    gumbel = seen.join(learn.filter("toxic = 0"), "doc_id").filter("n_tokens > 0").agg(F.avg(model.rate * best - F.log("n_tokens"))).first()[0]
    log_k = (gumbel if gumbel is not None else 0.0) - 0.5772156649015329  # the mean of a standard Gumbel variable
    excess = lambda s: model.rate * s - log_k - F.log(F.greatest("n_tokens", F.lit(1)))
    rare = F.aggregate("segments", F.lit(0.0), lambda t, s: t + F.greatest(excess(s["score"]), F.lit(0.0)))
    seen = seen.withColumn("stat", F.when(F.col("n_tokens") == 0, F.lit(LOW)).when(rare > 0, rare).otherwise(excess(best)))
    steps = seen.join(learn, "doc_id").groupBy((F.floor(F.col("stat") / STEP) * STEP + STEP / 2).alias("x")).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()
    at, rate = _monotone([(r.x, r.n, int(r.t)) for r in steps]) if model.scores else ([], [])
    chance = lambda s: 1 - F.exp(-F.exp(-excess(s["score"])))
    passages = F.filter(F.transform("segments", lambda s: F.struct(s["first"].alias("first"), s["end"].alias("end"), s["score"].alias("score"), chance(s).alias("p_value"))), lambda s: s["p_value"] <= significance)
    out = seen.select("stat", "doc_id", "n_tokens", passages.alias("passages"))
    kind = f"doc_id {id_type}, n_tokens int, passages array<struct<first int, end int, score double, p_value double>>, score double"
    out = out.mapInArrow(lambda it: _calibrated(it, at, rate), kind)
    return out.select(F.col("doc_id").alias(doc_id), held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_tokens", "passages")

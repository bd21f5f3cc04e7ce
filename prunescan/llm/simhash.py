"""SimHash near-dedup through an inverted index of fingerprint bytes with count filtering."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from prunescan.llm.common import components, cut, sliced, stored

#: Shingle hashes of a text are tallied in pieces of this many, which bounds memory for very long texts.
PIECE = 1 << 16
#: Fingerprints link at this many differing bits or fewer; ``links`` relies on 2, the meeting of two single-bit changes.
MAX_BITS = 2


def _shingles(words: list[bytes], k: int) -> Iterator[bytes]:
    if len(words) < k:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(itertools.islice(words, i, None) for i in range(k))))


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined ``k``-word shingles, repeats included, of the text with A-Z lower-cased."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in _shingles(words, k)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits, each set where over half of the hashes have it set, as a signed number. No hashes: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), PIECE):
        counts += np.unpackbits(hashes[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        own = pa.array([fingerprint(shingle_hashes(t or b"", k)) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], own], [*batch.schema.names[1:], "fp"])


def fingerprints(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """``doc_id``, ``fp`` (signed 64 bits) of every row."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(doc_id).cast("long").alias("doc_id"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), "doc_id long, fp long")


def _byte_mask(places: tuple[int, ...]) -> int:
    m = sum(0xFF << (8 * p) for p in places)
    return m - (1 << 64) if m >= 1 << 63 else m


def _postings(fp: str) -> tuple[Column, Column]:
    """The index entries of a fingerprint and, for each, the single bits outside its bytes.

    Fingerprints that differ in at most MAX_BITS bits agree in at least 8 - MAX_BITS of their 8 bytes, so
    one entry for every set of that many positions (with the bytes there) makes all of them meet. Two
    fingerprints that share m bytes meet in C(m, 8 - MAX_BITS) entries.
    """
    places = list(itertools.combinations(range(8), 8 - MAX_BITS))
    entries = F.array(*(F.col(fp).bitwiseAND(F.lit(_byte_mask(p))) for p in places))
    bits = lambda p: [1 << b for q in range(8) if q not in p for b in range(8 * q, 8 * q + 8)]
    free = F.array(*(F.array(*(F.lit(b - (1 << 64) if b >> 63 else b) for b in bits(p))) for p in places))
    return entries, free


def shared_bytes(a: Column, b: Column) -> Column:
    """How many of the 8 byte positions hold the same byte."""
    return sum(((a.bitwiseXOR(b)).bitwiseAND(F.lit(_byte_mask((p,)))) == 0).cast("int") for p in range(8))


def links(fps: DataFrame) -> DataFrame:
    """Links between distinct fingerprints (``fp``, with ``rep``, the id that stands for it): ``a``, ``b`` (ids).

    The index is keyed by positional bytes (``_postings``); only entries that two or more fingerprints share go
    on, so what goes on has the guaranteed number of matching bytes. Inside an entry pairs are not all listed:
    its fingerprints are keyed by the values one free bit away (at most 65 fingerprints lie that near a value),
    and those that meet there are within 2 bits. They are linked to the smallest of them, after the tally of
    shared bytes and the bit difference of the pair are checked. This keeps what is connected connected, and the
    work in proportion to the fingerprints, however many near copies a group has.
    """
    entries, free = _postings("fp")
    index = fps.select("rep", "fp", F.posexplode(entries).alias("places", "bytes"))
    crowded = index.groupBy("places", "bytes").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    near = index.join(crowded, ["places", "bytes"])
    around = F.transform(F.element_at(free, F.col("places") + 1), lambda bit: F.col("fp").bitwiseXOR(bit))
    hubs = near.select("rep", "fp", F.explode(F.array_append(around, F.col("fp"))).alias("hub")).distinct()
    met = hubs.groupBy("hub").agg(F.collect_set(F.struct("rep", "fp")).alias("met")).filter(F.size("met") > 1)
    pair = met.select(F.array_min("met").alias("x"), F.explode("met").alias("y")).filter("x.rep <> y.rep")
    good = (shared_bytes(F.col("x.fp"), F.col("y.fp")) >= 8 - MAX_BITS) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS)
    return pair.filter(good).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()


def simhash_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """Groups of rows whose SimHash fingerprints are connected by links of at most MAX_BITS differing bits.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; shingles are ``shingle`` words joined by spaces,
    repeats included (fewer words: all of them). Returns the id column, ``fingerprint`` (16 lowercase hex
    digits) and ``component_id`` (the smallest id of the group) for every input row.

    Equal fingerprints, however many, are one entry of the index. Null and empty texts have fingerprint zero,
    linked like any other. Rows that share an id keep their rows. A null id never names a group; a group of
    null ids only has a null ``component_id``. Other columns are not returned. An empty table gives no rows.
    """
    f = cut(fingerprints(docs, text, doc_id, shingle))
    last = F.lit(2**63 - 1)
    reps = cut(f.groupBy("fp").agg(F.coalesce(F.min("doc_id"), last).alias("rep")))
    whole = components(links(reps))
    named = reps.join(whole, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = named.withColumn("component_id", F.when(F.col("component_id") != last, F.col("component_id")))
    out = f.join(named, "fp")
    return out.select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates by shingle similarity: an exact set-similarity join by prefixes.

#: The commonest shingles, at most this many, are sent to all tasks; they come last in the order of the prefixes.
COMMON = 100_000
#: Rows of a block: an entry's rows are paired block with block.
BLOCK = 256
#: Members, drawn by a hash, with which all others of an entry that is in several groups are compared, turn by turn.
HEADS = (16, 128)
#: Positional bytes of a sketch, and how many standard deviations below the expectation a pair's tally may fall.
SKETCH, SLACK = 128, 6.0


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: One odd multiplier for each position of a sketch.
_STEPS = _spread(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted, as signed numbers."""
    return np.unique(shingle_hashes(text, k).view(np.int64))


def _content(s: np.ndarray) -> int:
    """64 bits that stand for a set of shingle hashes."""
    return int(_spread(s.view(np.uint64)).sum(dtype=np.uint64).view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """One byte for each of SKETCH positions: of the least image of the set's hashes under the position's mapping.

    Two sets have a position's byte in common with their similarity as the probability (a little more, as bytes are few).
    """
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        x = s[i : i + 4096].view(np.uint64)
        np.minimum(least, ((x[:, None] ^ (x[:, None] >> np.uint64(29))) * _STEPS).min(axis=0), out=least)
    return (_spread(least) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def least_tally(similarity: float) -> int:
    """Positional bytes that a pair of that similarity shares, but for a chance of about 1e-9."""
    return max(1, math.ceil(SKETCH * similarity - SLACK * math.sqrt(SKETCH * similarity * (1 - similarity))))


def _tallied(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, x, y) -> (a, b): pairs whose sketches share at least ``least`` positional bytes."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= least))


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in sliced(batches):
        yield batch, [shingle_set(t or b"", k) for t in batch.column(0).cast(pa.binary()).to_pylist()]


def _sizes(batches: Iterator[pa.RecordBatch], k: int, words: int | None) -> Iterator[pa.RecordBatch]:
    """(text, doc_id) -> (doc_id, u, bytes, fp): hash and sketch of the shingle set, SimHash fingerprint of the shingles of ``words`` words."""
    for batch, sets in _texts(batches, k):
        texts = batch.column(0).cast(pa.binary()).to_pylist()
        fps = pa.array([fingerprint(shingle_hashes(t or b"", words)) for t in texts] if words else [None] * len(texts), pa.int64())
        own = [pa.array([_content(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), fps]
        yield pa.RecordBatch.from_arrays([batch.column(1), *own], ["doc_id", "u", "bytes", "fp"])


def _repeated(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(text) -> (key, c): shingles that several different sets of a slice hold. Only an order follows from it."""
    for _, sets in _texts(batches, k):
        key, c = np.unique(np.concatenate([np.empty(0, np.int64), *{_content(s): s for s in sets}.values()]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key[c > 1]), pa.array(c[c > 1].astype(np.int64))], ["key", "c"])


def needed(n: int, similarity: float) -> int:
    """How many of its ``n`` shingles a set shares at least with any other of that similarity."""
    return math.ceil(similarity * n - 1e-9)


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, similarity: float, common: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(text) -> (u, n, prefix): the first ``n - needed + 1`` shingles by count and hash."""
    for _, sets in _texts(batches, k):
        sets, out = [s for s in sets if len(s)], []
        for s in sets:
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            c = np.where(common[at] == s, counts[at], 0) if len(common) else np.zeros(len(s), np.int64)
            out.append(s[np.argsort(c, kind="stable")[: len(s) - needed(len(s), similarity) + 1]])
        yield pa.RecordBatch.from_arrays([pa.array([_content(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["u", "n", "prefix"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for _, sets in _texts(batches, k):
        yield pa.RecordBatch.from_arrays([pa.array([_content(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["u", "shingles"])


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 5, similarity: float = 0.8, fingerprint_words: int | None = None) -> DataFrame:
    """Groups of rows connected by a Jaccard similarity of at least ``similarity`` of their ``shingle``-word sets.

    With ``fingerprint_words`` SimHash comes first: the links of ``simhash_groups`` with shingles of that many words
    (inverted index of fingerprint bytes, count filtering, bit difference) are links here too, and what follows only
    looks at entries that they leave in several groups. It finds the pairs which the fingerprints miss, as no
    number of bits bounds this similarity.

    All shingles have one order, common ones last. Two sets
    that are similar enough share a shingle of both prefixes, the first ``n - ceil(similarity n) + 1`` of the order,
    so an index of the prefixes makes all such pairs meet (at the first shingle they share, where the sizes and
    what follows in both still allow the similarity). Equal sets are one entry. Pairs that meet are filtered by a count: the
    positional bytes that their sketches share must reach what is to be expected at that similarity less SLACK
    standard deviations (a similar pair fails with a chance of about 1e-9). Every link is verified on the whole sets.

    Not all pairs of an entry need a look, as only what is connected counts. First each set is compared with the
    smallest head (least member) of its entries, then, where the links so far leave an entry in several groups, with
    members drawn by a hash, a few at first and then more (HEADS); this is in proportion to the entries' rows. In the
    entries that are still in several groups every pair of different groups is compared, block by block, so none is
    left out.

    Returns the id column and ``component_id`` (smallest id of the group) for every row. Fewer words than a
    shingle are one shingle. Null and wordless texts have equal, empty sets and form one group. A null id
    never names a group. Other columns are not read. An empty table gives no rows.
    """
    last = F.lit(2**63 - 1)
    d = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(doc_id).cast("long"), last).alias("doc_id"))
    f = stored(d.mapInArrow(lambda it: _sizes(it, shingle, fingerprint_words), "doc_id long, u long, bytes binary, fp long"))
    reps = stored(f.groupBy("u").agg(F.min("doc_id").alias("rep"), F.min("bytes").alias("bytes")))
    least = least_tally(similarity)
    often = d.select("text").mapInArrow(lambda it: _repeated(it, shingle), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    often = often.orderBy(F.desc("c"), "key").limit(COMMON).toArrow().sort_by("key")
    order = docs.sparkSession.sparkContext.broadcast((np.asarray(often.column("key")), np.asarray(often.column("c"))))
    prefixes = d.select("text").mapInArrow(lambda it: _prefixes(it, shingle, similarity, *order.value), "u long, n long, prefix array<long>")
    index = prefixes.dropDuplicates(["u"]).select("u", F.col("n").cast("int"), F.posexplode("prefix").alias("at", "key"))
    crowded = index.groupBy("key").agg(F.min("u").alias("head"), F.min_by("n", "u").alias("n_head"), F.count("*").alias("k")).filter("k > 1")
    index = stored(index.join(crowded.select("key", "head", "n_head"), "key"))
    alike = lambda x, y: F.least(x, y) + 1e-9 >= similarity * F.greatest(x, y)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs.join(reps.select(F.col("u").alias("a"), F.col("bytes").alias("x")), "a").join(reps.select(F.col("u").alias("b"), F.col("bytes").alias("y")), "b")
        pairs = stored(pairs.select("a", "b", "x", "y").mapInArrow(lambda it: _tallied(it, least), "a long, b long"))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct().join(reps, "u")
        rows = d.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
        sets = rows.mapInArrow(lambda it: _sets(it, shingle), "u long, shingles array<long>").join(wanted.select("u"), "u", "left_semi").dropDuplicates(["u"])
        both = pairs.join(sets.select(F.col("u").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("u").alias("b"), F.col("shingles").alias("y")), "b")
        both = both.withColumn("shared", F.size(F.array_intersect("x", "y")))
        return stored(both.filter(F.col("shared") + 1e-9 >= similarity * (F.size("x") + F.size("y") - F.col("shared"))).select("a", "b"))

    def grown(groups: DataFrame | None, links: DataFrame) -> DataFrame:
        """Groups (``node, component``) by the links of before and more."""
        return components(links if groups is None else links.select("a", "b").unionByName(groups.select(F.col("component").alias("a"), F.col("node").alias("b"))))

    def divided(rows: DataFrame, groups: DataFrame) -> DataFrame:
        """The rows, with their group ``c``, of entries in several groups; as groups only grow, all later ones are among these."""
        rows = rows.drop("c", "k").join(groups.withColumnRenamed("node", "u"), "u", "left").withColumn("c", F.coalesce("component", "u")).drop("component")
        several = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).filter("low <> high")
        return stored(rows.join(several.select("key", "k"), "key"))

    groups, left = None, index
    if fingerprint_words:
        fps = stored(f.groupBy("fp").agg(F.min("u").alias("rep")))
        equal = f.select("u", "fp").distinct().join(fps, "fp").filter("u <> rep").select(F.col("rep").alias("a"), F.col("u").alias("b"))
        groups = grown(None, links(fps).unionByName(equal))
        left = divided(index, groups)
    heads = left.filter((F.col("u") != F.col("head")) & alike("n", "n_head"))
    groups = grown(groups, verified(heads.groupBy("u").agg(F.min("head").alias("a")).withColumnRenamed("u", "b")))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("u", "n", "at", "c")]
    shares = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    may = alike("n_a", "n_b") & (shares + 1e-9 >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")))
    for turn, most in enumerate(HEADS):
        left = divided(left, groups)
        order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(turn), "u"))
        heads = left.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).select("key", *side("a"))
        pairs = left.select("key", *side("b")).join(heads, "key").filter((F.col("c_a") != F.col("c_b")) & may)
        groups = grown(groups, verified(pairs.select(F.col("u_a").alias("a"), F.col("u_b").alias("b"))))
    left = divided(left, groups).withColumn("blocks", F.ceil(F.col("k") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("u"), "blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one, other = left.select("key", F.col("own").alias("i"), every.alias("j"), *side("a")), left.select("key", every.alias("i"), F.col("own").alias("j"), *side("b"))
    pairs = one.join(other, ["key", "i", "j"]).filter((F.col("u_a") < F.col("u_b")) & (F.col("c_a") != F.col("c_b")) & may)
    whole = grown(groups, verified(pairs.select(F.col("u_a").alias("a"), F.col("u_b").alias("b"))))
    named = reps.join(whole, F.col("u") == F.col("node"), "left").select("u", "rep", F.coalesce("component", "u").alias("c"))
    names = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    out = f.select("doc_id", "u").join(named.join(names, "c").select("u", "component_id"), "u")
    back = lambda c: F.when(F.col(c) != last, F.col(c))
    return out.select(back("doc_id").alias(doc_id), back("component_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id names its group of ``near_groups``, with all their columns; rows with a null id stay.

    Rows that share an id stay together if it names the group of one of them.
    """
    groups = near_groups(docs, text, doc_id, **options)
    gone = groups.groupBy(F.col(doc_id).alias("_gone")).agg(F.max(F.col(doc_id) == F.col("component_id")).alias("names")).filter("not names").select("_gone")
    return docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")

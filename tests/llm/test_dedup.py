"""SimHash groups, near duplicates and substring dedup against brute force."""

import hashlib
import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from prunescan.llm import simhash, substring_dedup
from prunescan.llm.common import components
from tests.llm.conftest import prose


def grouped(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 300)] + [(500, i) for i in range(501, 600)]
    edges += [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == grouped({x for e in real for x in e}, real)
    assert components(df.limit(0)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_groups(spark):
    rng, texts = random.Random(9), []
    for k in range(12):
        base = prose(100 + k, 120).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["One", "one", "ONE two", "É é", "É É"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(fp)), 2) if bin(fp[a] ^ fp[b]).count("1") <= 2]
    true = grouped(range(len(fp)), linked)
    assert linked and got == {i: (f"{fp[i]:016x}", true[i]) for i in range(len(fp))}


def test_chains_of_near_fingerprints(spark):
    """A crowd within a few bits of one another, and chains of two-bit steps, keep exactly their links."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in c) for r in (0, 1, 2, 3) for c in itertools.combinations(rng.sample(range(64), 9), r)}
    x = rng.getrandbits(64)
    for _ in range(20):
        x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    links = simhash.links(df).collect()
    assert all(bin(fps[r.a] ^ fps[r.b]).count("1") <= 2 for r in links)
    true = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    assert grouped(range(len(fps)), [(r.a, r.b) for r in links]) == grouped(range(len(fps)), true)


def test_long_texts_are_tallied_in_pieces(monkeypatch):
    h = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = simhash.fingerprint(h)
    monkeypatch.setattr(simhash, "PIECE", 7)
    assert simhash.fingerprint(h) == whole


def test_odd_rows(odd, none):
    got = simhash.simhash_groups(odd)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == odd.count()
    rows = [(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()]
    assert {(1, brute_fingerprint("a b c d e f").to_bytes(8).hex(), 1)} == {r for r in rows if r[0] == 1}
    assert {r[2] for r in rows if r[1] == "0" * 16} == {2}
    assert {r[2] for r in rows if r[0] in (5, 6)} == {5}
    assert simhash.simhash_groups(none).count() == 0
    near = simhash.near_groups(odd)
    assert near.count() == odd.count() and near.filter("doc_id = 9").first().component_id == 8
    assert simhash.drop_near_duplicates(none).columns == odd.columns and simhash.drop_near_duplicates(none).count() == 0


def test_only_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in simhash.simhash_groups(df).collect()] == [None, None]
    assert [r.component_id for r in simhash.near_groups(df).collect()] == [None, None]


def test_near_duplicates_by_similarity(spark):
    rng, texts = random.Random(21), []
    for k in range(25):
        base = prose(300 + k, rng.randint(80, 300)).split()
        texts.append(" ".join(base))
        for edits in (1, 2, 4):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 999)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(texts)), 2)}
    assert all(got[a] == got[b] for (a, b), s in sim.items() if s >= 0.86)
    whole = grouped(range(len(texts)), [p for p, s in sim.items() if s >= 0.8])
    assert sum(got[i] != whole[i] for i in got) <= 0.03 * len(got)
    kept = simhash.drop_near_duplicates(df)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in got.items() if i == c}


def test_sketches_share_bytes_in_proportion_to_the_similarity():
    rng = np.random.default_rng(1)
    for n, own in ((9, 1), (40, 4), (400, 44)):
        tally = []
        for _ in range(400):
            both, a, b = (rng.integers(0, 2**63, k, dtype=np.int64) for k in (n - own, own, own))
            x, y = (np.frombuffer(simhash.sketch(np.concatenate([both, s])), np.uint8) for s in (a, b))
            tally.append((x == y).sum())
        share = (n - own) / (n + own)
        assert abs(np.mean(tally) - simhash.SKETCH * (share + (1 - share) / 256)) < 1.5 and np.std(tally) < 1.15 * (simhash.SKETCH * share * (1 - share)) ** 0.5
        assert min(tally) >= simhash.least_tally(0.8)


def test_a_large_group_of_near_copies(spark):
    base, rng, texts = prose(77, 200).split(), random.Random(5), []
    for i in range(1500):
        copy = list(base)
        copy[rng.randrange(200)] = f"v{i}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in simhash.near_groups(df).select("component_id").distinct().collect()] == [0]


def test_near_groups_are_those_of_brute_force(spark, monkeypatch):
    """Pairs close to the threshold, and a family that shares a passage, in which single links hide among many unlike texts."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng, texts, passage = random.Random(8), [], prose(1, 60).split()
    for k in range(60):
        base = prose(500 + k, 100).split()
        copy = list(base)
        for at in rng.sample(range(100), 2 + k % 3):
            copy[at] = f"edit{rng.randint(0, 999)}"
        texts += [" ".join(base), " ".join(copy)]
    for k in range(200):  # passage shared by all; every fifth text has a copy with one more edit
        own = prose(900 + k, 16).split()
        texts.append(" ".join(passage + own))
        if k % 5 == 0:
            texts.append(" ".join(passage + own[:8] + ["edit"] + own[9:]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    assert got == grouped(range(len(texts)), pairs)


def brute_kept(docs, window=13):
    first, out = {}, {}
    for i, t in sorted(docs):
        w = (t or "").encode().split()
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def substring(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substring_dedup.drop_repeated(df).collect()}


def test_substring_dedup(spark):
    rng, docs = random.Random(6), []
    passages = [prose(k, n).split() for k, n in enumerate((12, 13, 14, 30, 60, 200))]
    for i in rng.sample(range(10_000), 160):
        words = prose(1000 + i, rng.randint(0, 80)).split()
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randint(0, max(0, len(p) - 20)) if rng.random() < 0.5 else 0
            at = rng.randint(0, len(words))
            words[at:at] = p[a : a + rng.randint(5, 250)]
        docs.append((i, " \n".join(words)))
    docs += [(10_001, docs[0][1]), (10_002, "same " * 100), (10_003, "same " * 50), (10_004, "a b " * 40 + "same " * 13)]
    assert substring(spark.createDataFrame(docs, "doc_id long, text string")) == brute_kept(docs)


def test_factors_are_those_of_a_naive_parser(spark):
    """Every factor is a passage of the earlier document it names, and no two neighbours could be one."""
    def parsed(n, ref, place):
        out = []
        for i, r, p in zip(n, ref, place):
            if out and out[-1][1] + 1 == i and out[-1][2] == r and out[-1][3] + 1 == p:
                out[-1][1:] = [i, r, p]
            else:
                out.append([i, i, r, p])
        return [(a, b, r) for a, b, r, _ in out]

    rng = random.Random(3)
    for _ in range(200):
        n = sorted(rng.sample(range(30), rng.randint(0, 25)))
        ref, place = [rng.choice([1, 1, 1, 2]) for _ in n], [i + rng.choice([0, 0, 0, 5]) for i in n]
        assert substring_dedup.factors(*(np.array(x, np.int64) for x in (n, ref, place))) == parsed(n, ref, place)

    long, other = prose(1, 400), prose(2, 300)
    docs = [(1, long), (2, other), (3, long), (4, " ".join([prose(5, 20), *long.split()[50:200], prose(6, 20), *other.split()[100:180]])), (7, prose(7, 60)), (9, prose(9, 8))]
    got = {r.doc_id: r for r in substring_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    words = {i: t.split() for i, t in docs}
    for i, r in got.items():
        for f in r.factors:
            span = words[i][f.first : f.end]
            assert f.doc < i and len(span) >= 13 and f" {' '.join(span)} " in f" {' '.join(words[f.doc])} "
    assert [(f.first, f.end, f.doc) for f in got[3].factors] == [(0, 400, 1)]
    assert [f.doc for f in got[4].factors] == [1, 2] and sum(f.end - f.first for f in got[4].factors) > 190 and got[4].n_removed == 230
    assert not got[1].factors and not got[7].factors


def test_rows_that_share_an_id_but_not_the_text(spark):
    a, b = prose(1, 60), prose(2, 60)
    docs = [(1, a), (2, b), (3, f"{prose(4, 30)} {a}"), (3, f"{b} x y"), (None, a), (None, prose(8, 70))]
    got = sorted((r.doc_id or 99, r.n_removed) for r in substring_dedup.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, 0), (2, 0), (3, 60), (3, 60), (99, 0), (99, 60)]


def test_substring_odd_rows(odd, none):
    got = substring_dedup.drop_repeated(odd)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "factors"] and got.count() == odd.count()
    rows = {}
    for r in got.collect():
        rows.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert rows[5] == [(60_000, 0)] and rows[6] == [(60_000, 60_000)] and rows[9] == [(40, 40)] and rows[2] == rows[3] == rows[4] == [(0, 0)]
    assert sorted(rows[None]) == [(0, 0), (3, 0)] and rows[1] == [(6, 0)] * 2
    assert got.filter("doc_id = 7").first().kept == "\u00a0nbsp\u00a0 \u2028 é 漢字 🙂 \x00 z"
    assert substring_dedup.drop_repeated(none).count() == 0


def test_a_null_id_counts_as_last(spark):
    t = prose(3, 20)
    got = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeated(spark.createDataFrame([(None, t), (9, t)], "doc_id long, text string")).collect()}
    assert got == {None: 20, 9: 0}


def test_text_column_by_another_name(odd):
    df = odd.select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    assert substring_dedup.drop_repeated(df, "body", "id").columns[0] == "id"
    assert simhash.simhash_groups(df, "body", "id").columns[0] == "id"


def test_near_groups_hold_simhash_links_and_similar_texts(spark):
    """Groups are those of both kinds of links: fingerprints within two bits, and similarity 0.8 of the shingle sets."""
    rng, texts = random.Random(14), []
    for k in range(40):
        base = prose(700 + k, 300).split()
        copies = [list(base), [*base, *prose(2000 + k, 5).split()], list(base)]
        for at in rng.sample(range(300), 20 if k % 2 else 4):  # dissimilar or similar by sets
            copies[2][at] = f"edit{rng.randint(0, 999)}"
        texts += [" ".join(c) for c in copies] + [" ".join(w for w in base for _ in "ab")]
    for k in range(20):  # a passage over and over with different ends: within few bits, while their sets are unlike
        texts += [" ".join(prose(3000 + k, 7).split() * 60 + prose(4000 + 2 * k + e, 12).split()) for e in (0, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(simhash.shingle_set(t.encode(), 5).tolist()) for t in texts]
    fps = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 3)) for t in texts]
    pairs = list(itertools.combinations(range(len(texts)), 2))
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    bits = {(a, b) for a, b in pairs if bin((fps[a] ^ fps[b]) & (2**64 - 1)).count("1") <= 2}
    assert near - bits and bits - near
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, fingerprint_words=3).collect()}
    assert got == grouped(range(len(texts)), near | bits)


def test_ids_shared_by_rows_of_several_groups_lose_no_group(spark):
    rows = [(0, prose(1, 50)), (1, prose(2, 50)), (1, prose(1, 50)), (5, prose(2, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (None, 3):
        assert sorted(r.doc_id for r in simhash.drop_near_duplicates(df, fingerprint_words=words).collect()) == [0, 1, 1]


def test_windows_are_as_defined():
    """Seeds and hashes of windows against one run after the other, for several sizes and lengths about them."""
    mul, full = 0x9E3779B97F4A7C15, 2**64 - 1
    for window, seed_words in ((13, 5), (13, 13), (5, 1), (8, 3), (1, 1)):
        for n in (0, window - 1, window, window + 1, 2 * window, 60):
            words = [w.encode() for w in prose(n + 1, max(n, 1)).split()][:n]
            h = [substring_dedup.xxhash.xxh64_intdigest(w) for w in words]
            run = lambda k: [sum(h[i + j] * pow(mul, k - 1 - j, 2**64) for j in range(k)) & full for i in range(n - k + 1)]
            mixed = lambda x: substring_dedup._mixed(np.array(x, np.uint64)).tolist()
            runs, span = mixed(run(seed_words)), window - seed_words + 1
            seeds, hashes = substring_dedup.windows(words, window, seed_words)
            assert seeds.view(np.uint64).tolist() == [min(runs[i : i + span]) for i in range(max(0, n - window + 1))]
            assert hashes.view(np.uint64).tolist() == mixed(run(window))

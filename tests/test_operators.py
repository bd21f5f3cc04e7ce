import random

import pytest
from pyspark.sql import functions as F

from prunescan.functions import errors, text
from prunescan.operators import access, membership, metrics, pages, ring


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_coalesce_adjacent(spark):
    df = spark.createDataFrame([("f", p) for p in (5, 6, 7, 10)], "file_id string, page_index long")
    m = 4 << 20
    assert rows(pages.coalesce_pages(df), "range_start") == [("f", 5 * m, 8 * m, 3), ("f", 10 * m, 11 * m, 1)]
    sizes = spark.createDataFrame([("f", 10 * m + 7)], "file_id string, file_size long")
    assert rows(pages.coalesce_pages(df, sizes=sizes), "range_start")[1][2] == 10 * m + 7
    assert pages.coalesce_pages(df.limit(0)).count() == 0


def test_pages_of_ranges(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1023, 2), (1024, 1024), (5, 3000)], "offset long, length long")
    got = {(r.offset, r.length): [] for r in df.collect()}
    for r in pages.slices(df, 1024).orderBy("page_index").collect():
        got[r.offset, r.length].append((r.page_index, r.slice_start, r.slice_end))
    assert got == {(0, 0): [], (0, 1): [(0, 0, 1)], (1023, 2): [(0, 1023, 1024), (1, 0, 1)], (1024, 1024): [(1, 0, 1024)], (5, 3000): [(0, 5, 1024), (1, 0, 1024), (2, 0, 957)]}


def test_file_info_and_store(spark, tmp_path):
    df = spark.createDataFrame([("gs://b/f", 0, bytearray(b"x" * 100)), ("gs://b/f", 1, bytearray(b"y" * 200)), ("g", 0, bytearray())], "file_id string, page_index long, data binary")
    pages.write_pages(df, str(tmp_path / "p"))
    back = pages.read_pages(spark, str(tmp_path / "p"), 150)
    assert rows(pages.file_info(back)) == [("gs://b/f", 2, 300)]
    sized = df.select("file_id", "page_index", F.octet_length("data").alias("size"))
    assert pages.corrupt(sized, 90).count() == 2


def ring_model(nodes, key, n=1):
    import hashlib

    h = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:15], 16)
    places = sorted({h(f"{x}#{v}"): x for x in nodes for v in range(150)}.items())
    out = []
    for _, x in [p for p in places if p[0] >= h(key)] + places:
        if x not in out:
            out.append(x)
    return out[:n]


def test_ring(spark, monkeypatch):
    nodes = ["oak", "elm", "ash", "fir", "yew"]
    df = spark.range(4000).select(F.format_string("lake/day=%d/%x", F.col("id") % 9, F.col("id") * 7919).alias("key"))
    whole = ring.build_ring(spark, nodes)
    got = {r.key: r.nodes for r in ring.place(df, whole, "key", 3).collect()}
    assert len(got) == 4000 and all(got[k] == ring_model(nodes, k, 3) for k in random.Random(1).sample(sorted(got), 250))
    share = [sum(v[0] == n for v in got.values()) for n in nodes]
    assert min(share) > 4000 / 5 / 2 and max(share) < 4000 / 5 * 2
    moved = ring.remapped(df, whole, ring.build_ring(spark, ["oak", "elm", "fir", "yew"]), "key").filter("owner_before <> owner_after")
    assert moved.count() == share[2] and moved.filter("owner_before <> 'ash'").count() == 0
    assert ring.local(df, whole, "key", "yew").filter("is_local").count() == share[4]
    assert ring.owners(df.limit(3), ring.build_ring(spark, []), "key").filter("owner is null").count() == 3
    assert ring.owners(df.limit(0), whole, "key").count() == 0
    assert {r.owner for r in ring.first_live(df.limit(40), whole, "key", ["oak", "elm"], 3).collect()} <= {"ash", "fir", "yew"}
    assert ring.first_live(df.limit(5), whole, "key", nodes, 5).filter("owner is null").count() == 5
    monkeypatch.setattr(ring, "MOST_SENT", 10)  # as a ring that is too large to send
    assert {r.key: r.nodes for r in ring.place(df, whole, "key", 3).collect()} == got


def test_gauge(spark):
    rng = random.Random(8)
    log = [(rng.choice(["a", "a", "b", None]), t, rng.choice([-1, 2, None])) for t in [None, *range(300)]]
    df = spark.createDataFrame(log, "k string, t int, d int")
    for buckets in (1, 7, 4096):
        got = {(r.k, r.t): r.level for r in metrics.gauge(df, "k", "t", F.col("d"), buckets).collect()}
        for k in ("a", "b", None):
            level = 0
            for _, t, x in (r for r in log if r[0] == k):
                level += x or 0
                assert got[k, t] == level
    one = spark.sql("select 'a' k, timestamp'2024-01-01' t, 5 d")
    assert rows(metrics.gauge(one, "k", "t", F.col("d")))[0][-1] == 5 and metrics.gauge(one.limit(0), "k", "t", F.col("d")).count() == 0
    assert metrics.throughput(one, "k", "t", "d").first().ops_per_second is None


def test_assembly(spark):
    stored = spark.createDataFrame([("f", 0, bytearray(b"abcd")), ("f", 1, bytearray(b"efgh")), ("f", 3, bytearray(b"m")), ("f", 1, bytearray(b"efgh"))], "file_id string, page_index long, data binary")
    asked = spark.createDataFrame([(1, "f", 1, 6), (2, "f", 4, 4), (3, "f", 6, 4), (4, "f", 12, 2), (5, "f", 12, 1), (6, "g", 0, 1), (7, "f", 3, 0)], "id int, file_id string, offset long, length long")
    got = {r.id: r.data and bytes(r.data) for r in pages.assemble(asked, stored, "id", 4).collect()}
    assert got == {1: b"bcdefg", 2: b"efgh", 3: None, 4: None, 5: b"m", 6: None}


def test_lru(spark):
    rng = random.Random(5)
    trace = [(c, t, rng.choice("abcdefg")) for c in range(3) for t in range(80)]
    df = access.reuse_distances(spark.createDataFrame(trace, "cache int, t int, key string"))
    got = {(r.cache, r.t): r.distance for r in df.collect()}
    for c in range(3):
        lru: list[str] = []
        for _, t, k in sorted(x for x in trace if x[0] == c):
            assert got[c, t] == (lru.index(k) if k in lru else None)
            lru = [k, *(x for x in lru if x != k)]
    curve = rows(access.hit_curve(df, [1, 7]))
    assert curve[1][1] == 240 - 21 and curve[0][2] == 240


def test_frequencies(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)], "key string")
    assert rows(access.frequencies(df)) == [("a", 5), ("b", 2), ("c", 1)]
    assert all(r.estimate >= {"a": 5, "b": 2, "c": 1}[r.key] for r in access.sketched(df, width=2).collect())
    d = spark.createDataFrame([("a", 1), ("c", 1)], "key string, distance int")
    assert rows(access.admitted(d, access.frequencies(df))) == [("a", 1)]


def test_nearest_rank_percentiles(spark):
    rng = random.Random(2)
    data = {"x": [rng.choice([1.0, 2.0, 7.5, 1e9]) for _ in range(57)], "y": [3.0], "z": [rng.random() for _ in range(400)], "w": [4.0] * 9}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in [*vs, None]], "key string, v double")
    got = {(r.key, r.percentile): r.value for r in metrics.percentiles(df, "key", "v", (0, 50, 99, 100)).collect()}
    assert got == {(k, p): sorted(vs)[min(len(vs) * p // 100, len(vs) - 1)] for k, vs in data.items() for p in (0, 50, 99, 100)}


def test_histogram_and_exposition(spark):
    df = spark.createDataFrame([("a", 0.004), ("a", 0.3), ("a", None), ("a", float("nan"))], "k string, v double")
    h = {r.le: r.n for r in metrics.histogram(df, "k", "v").collect()}
    assert h[0.005] == 1 and h[0.25] == 1 and h[0.5] == 2 and h[float("inf")] == 4
    assert rows(metrics.exposition("m", metrics.counters(df, "k", "v"), "k", "requests"))[1] == ('m{k="a"} 4',)


@pytest.mark.parametrize(
    "events, members",
    [
        ([("Snapshot", None, ["a", "b"]), ("Joined", "c", None)], ["a", "b", "c"]),
        ([("Snapshot", None, ["a", "b", "c"]), ("Left", "b", None)], ["a", "c"]),
        ([("Joined", "z", None), ("Snapshot", None, ["a", "b", "c", "d", "e"])], ["a", "b", "c", "d", "e"]),
        ([("Joined", "a", None), ("Joined", "a", None)], ["a"]),
        ([], []),
    ],
)
def test_membership(spark, events, members):
    df = spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], "cluster int, seq int, kind string, node string, members array<string>")
    assert [r.node for r in membership.fold(df).orderBy("node").collect()] == members


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(text.url_safe(lit("s3://lake/a b/ü.parquet"))) == "s3%3A%2F%2Flake%2Fa%20b%2F%C3%BC.parquet"
    for s in ("é ~*+%", "plain", ""):
        assert one(text.url_safe_decode(text.url_safe(lit(s)))) == s
    assert one(text.query_decode(lit("a+b%20c"))) == "a b c"
    assert one(text.object_name(lit("day=1/x y"))) == "day%3D1%2Fx%20y"
    assert [one(text.retry_delay(lit(a))) for a in (0, 1, 2, 3, 10, 20)] == [100, 200, 400, 800, 5000, 5000]
    assert [one(text.status_class(lit(s))) for s in (200, 503, 429, 500, 404, 403)] == ["ok", "transient", "transient", "transient", "permanent", "permanent"]
    assert one(text.status_code(lit("HTTP/1.1 206 Partial Content"))) == 206 and one(text.status_code(lit("junk"))) is None
    assert one(text.content_length(lit("X: 1\r\nContent-Length: 4194304"))) == 4194304 and one(text.content_length(lit("X-Other: foo"))) is None
    assert one(text.header_end(lit("a\r\n\r\nb"))) == 1 and one(text.header_end(lit("a"))) == -1
    assert one(text.query_value(lit("GET /read?uri=x%2Fy&uri=z HTTP/1.1"), "uri")) == "x/y" and one(text.query_value(lit("GET /read HTTP/1.1"), "uri")) is None
    assert one(text.hex_literal(lit(bytearray(b"\x01\xff")))) == "0x01ff" and one(text.truncated(lit("é" * 300))) == "é" * 200
    path = one(text.path_component(lit("s3://lake/t.parquet"), lit(5)))
    assert path.split("/")[1:] == ["s3%3A%2F%2Flake%2Ft.parquet", "5"] and len(path.split("/")[0]) == 3
    assert one(text.page_key(lit("f"), lit(3))) == "f:page3"


def test_errors(spark):
    table = {r.name: r for r in errors.error_codes(spark).collect()}
    assert len(table) == len({r.code for r in table.values()}) == 21
    assert table["GCS_TRANSIENT_ERROR"].retriable and not table["INVALID_REQUEST"].retriable
    shown = {r[0] for r in errors.error_codes(spark).select(errors.display(F.col("name"), F.col("code"))).collect()}
    assert {"INVALID_REQUEST:0x00000001", "GCS_TRANSIENT_ERROR:0x00030001"} <= shown
    assert errors.EngineError("DISK_IO_ERROR", "x").retriable

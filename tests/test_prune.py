import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from prunescan.engine import Engine
from prunescan.functions.errors import EngineError
from prunescan.plans import predicate as P, prune
from prunescan.plans.scan import merged, read_row_groups, scan
from prunescan.sources import footer


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Ten row groups of an integer, a float with NaN, strings, an unsigned and a nested column; one group all null; one file empty."""
    d = tmp_path_factory.mktemp("parquet")
    n = 1000
    k = list(range(n))
    table = pa.table({
        "k": pa.array(k, pa.int64()), "i": pa.array(k, pa.int32()), "f": pa.array([float("nan") if 200 <= x < 210 else x / 2 for x in k]),
        "s": pa.array([f"v{x:04d}" for x in k]), "u": pa.array([2**63 + x for x in k], pa.uint64()), "n": pa.array([None if 300 <= x < 400 else x for x in k], pa.int64()),
        "st": pa.array([{"id": x % 7, "k": -x} for x in k], pa.struct([("id", pa.int64()), ("k", pa.int64())])),
    })
    pq.write_table(table, d / "a.parquet", row_group_size=100)
    pq.write_table(table, d / "nostats.parquet", row_group_size=100, write_statistics=False)
    pq.ParquetWriter(d / "empty.parquet", table.schema).close()  # no row group at all
    return d


def groups(spark, files, p, name="a.parquet"):
    rg = footer.row_groups(footer.footers(spark, [str(files / name)]))
    return [r.row_group for r in prune.survivors(rg, p).orderBy("row_group").collect()]


EVERY = list(range(10))
CASES = [
    (P.compare("k", "Eq", 250), [2]), (P.compare("k", "Ne", 250), EVERY), (P.compare("k", "Lt", 100), [0]), (P.compare("k", "Le", 100), [0, 1]), (P.compare("k", "Gt", 899), [9]),
    (P.compare("k", "Ge", 899), [8, 9]), (P.compare("k", "Gt", 150) & P.compare("k", "Lt", 250), [1, 2]), (P.compare("k", "Lt", 50) | P.compare("k", "Gt", 950), [0, 9]),
    (~P.compare("k", "Lt", 50), EVERY), (P.is_in("k", [5, 905]), [0, 9]), (P.is_in("k", []), []), (P.is_in("k", [5, None]), EVERY), (P.between("k", 150, 250), [1, 2]),
    (P.is_null("k"), EVERY), (P.compare("k", "Eq", 1.5), EVERY), (P.compare("i", "Eq", 5), EVERY), (P.compare("s", "Eq", "x"), EVERY),
    (P.compare("u", "Eq", 5), EVERY), (P.compare("nope", "Eq", 5), EVERY), (P.compare("st.k", "Lt", -850), [8, 9]), (P.compare("f", "Gt", 474.0), [9]), (P.compare("n", "Eq", 5), [0, 3]),
]


@pytest.mark.parametrize("p, expected", CASES)
def test_might_match(spark, files, p, expected):
    assert groups(spark, files, p) == expected


def test_inverted_between_keeps_only_what_spans_both(spark, files):
    assert groups(spark, files, P.between("k", 250, 150)) == []
    assert groups(spark, files, P.between("k", 160, 150)) == [1]


def test_nan_literal_prunes_and_nan_bounds_keep(spark, files):
    kept = groups(spark, files, P.compare("f", "Eq", float("nan")))
    assert set(kept) <= {2}
    assert groups(spark, files, P.compare("f", "Ne", float("nan"))) == EVERY


def test_without_statistics_all_stay(spark, files):
    assert groups(spark, files, P.compare("k", "Eq", 250), "nostats.parquet") == EVERY
    assert groups(spark, files, P.is_in("k", []), "nostats.parquet") == EVERY


def test_empty_file(spark, files):
    f = footer.footers(spark, [str(files / "empty.parquet")])
    assert footer.files(f).first().n_rows == 0
    assert footer.row_groups(f).count() == 0


def test_ranges_agree_with_the_footer(spark, files):
    m = pq.ParquetFile(files / "a.parquet").metadata
    for r in footer.row_groups(footer.footers(spark, [str(files / "a.parquet")])).collect():
        cols = [m.row_group(r.row_group).column(i) for i in range(m.num_columns)]
        starts = [c.dictionary_page_offset if c.has_dictionary_page else c.data_page_offset for c in cols]
        assert r.offset == min(starts) and r.offset + r.length == max(s + c.total_compressed_size for s, c in zip(starts, cols))
        assert (r.first_row, r.last_row) == (100 * r.row_group, 100 * r.row_group + 99)


def test_superset_holds_the_exact_rows(spark, files):
    rng, uri = random.Random(3), str(files / "a.parquet")

    def tree(depth=0):
        if depth < 2 and rng.random() < 0.5:
            a, b = tree(depth + 1), tree(depth + 1)
            return rng.choice([a & b, a | b, ~a])
        c = rng.choice(["k", "n", "i", "f"])
        v = float(rng.randint(0, 500)) if c == "f" else rng.randint(-50, 1050)
        return rng.choice([P.compare(c, rng.choice(list(P.OPS)), v), P.is_in(c, [v, v]), P.between(c, v, v), P.is_null(c)])

    for _ in range(6):
        p = tree()
        exact = {r.k for r in scan(spark, uri, p, ["k"]).collect()}
        wide = {r.k for r in scan(spark, uri, p, ["k"], mode="row_group").collect()}
        assert exact <= wide, str(p)
        assert wide == {r.k for r in read_row_groups(spark, [uri], p, ["k"]).collect()}
        assert len(wide) % 100 == 0


def test_row_group_mode_reads_one_group(spark, files):
    rows = scan(spark, str(files / "a.parquet"), P.between("k", 210, 220), mode="row_group")
    assert sorted(r.k for r in rows.select("k").collect()) == list(range(200, 300))
    assert rows.columns == ["k", "i", "f", "s", "u", "n", "st"]


def scanned(df):
    """Rows that the file scans of a plan put out."""
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def visit(node):
        if node.nodeName().startswith("Scan parquet"):
            out.append(node.metrics().apply("numOutputRows").value())
        inner = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node.plan() if node.nodeName().endswith("QueryStage") else None
        for child in [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]:
            visit(child)

    visit(plan)
    return sum(out), rows


@pytest.mark.parametrize("p, n", [
    (P.between("k", 41_200, 41_300), 1), (P.is_in("k", [5, 99_999]), 2), (P.compare("v", "Gt", 49_900.0), 1), (P.between("k", 1500, 3500) & P.compare("v", "Lt", 1200.0), 2),
    (P.compare("k", "Lt", 10) | P.compare("v", "Ge", 49_600.0), 2), (P.compare("k", "Ge", 0), 100), (P.compare("k", "Gt", 10**6), 0),
])
def test_only_surviving_groups_are_read(spark, tmp_path_factory, p, n):
    """100 row groups in one file: the scan puts out no more than the survivors' rows, but for an Or over two columns."""
    path = tmp_path_factory.mktemp("hundred") / "t.parquet"
    k = list(range(100_000))
    pq.write_table(pa.table({"k": k, "v": [x / 2 for x in k]}), path, row_group_size=1000)
    out, rows = scanned(scan(spark, str(path), p, ["k"], mode="row_group"))
    assert len(rows) == 1000 * n and (p.kind == "Or" or out == len(rows))
    assert {r.k for r in scan(spark, str(path), p, ["k"]).collect()} <= {r.k for r in rows}


def test_spans():
    assert merged([(5, 9), (1, 2), (2, 3), (20, 21)]) == [(1, 3), (5, 9), (20, 21)]
    assert merged([(0, 1), (10, 11), (12, 13), (90, 91)], 2) == [(0, 13), (90, 91)]
    spans = [(x, x + 2) for x in random.Random(4).sample(range(10_000), 500)]
    wide = merged(spans, 7)
    assert len(wide) == 7 and all(any(a <= x and y <= b for a, b in wide) for x, y in spans)


def test_other_files_are_left_out(spark, files):
    """Files without a survivor aren't read; a file in which nothing is known stays."""
    uris = [str(files / f) for f in ("a.parquet", "nostats.parquet")]
    df = scan(spark, uris, P.compare("k", "Gt", 10**6), ["k"], mode="row_group")
    assert df.count() == 1000
    assert scan(spark, uris, P.compare("n", "Eq", 5), ["k"], mode="row_group").count() == 1200


def test_engine(spark, files):
    e, uri = Engine(spark), str(files / "a.parquet")
    assert e.scan(uri, P.compare("k", "Lt", 3).json(), ["k"]).count() == 3
    assert e.batch_scan([(uri, P.compare("k", "Lt", 3), ["k"]), (uri, None, ["s"])]).groupBy("scan_id").count().orderBy("scan_id").collect()[1]["count"] == 1000
    assert e.metadata([uri]).first().n_row_groups == 10 and e.row_groups([uri]).count() == 10
    assert bytes(e.read_range(uri, 0, 4).first().data) == b"PAR1" and e.read_range(uri, 0, 0).first().length == 0
    whole = e.read_range(uri, 8).first()
    assert bytes(whole.data) == (files / "a.parquet").read_bytes()[8:]
    with pytest.raises(EngineError, match="INVALID_REQUEST"):
        e.scan(uri, '{"Nope":1}')
    with pytest.raises(ValueError):
        e.scan(uri, mode="other")


def test_zone_map_of_empty_table(spark):
    df = spark.createDataFrame([], "k long")
    assert prune.zone_map(df, F.col("k"), {"k": "INT64"}).count() == 0

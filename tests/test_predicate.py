import json

import pytest
from pyspark.sql import types as T

from prunescan.plans import predicate as P

TREES = [
    P.compare("ts", "Gt", 1704067200) & P.compare("region", "Eq", "US"),
    P.compare("x", "!=", 1.5) | P.is_null("y"),
    ~P.is_in("s", ["a", None, True, b"\x01\x02"]),
    P.between("a.b", -1, 9),
]


def test_display():
    assert str(TREES[0]) == "(ts > 1704067200 AND region = 'US')"
    assert str(TREES[1]) == "(x != 1.5 OR y IS NULL)"
    assert str(TREES[2]) == "NOT (s IN ('a', NULL, true, 0x0102))"
    assert str(TREES[3]) == "a.b BETWEEN -1 AND 9"


@pytest.mark.parametrize("tree", TREES)
def test_json_round_trip(tree):
    assert P.from_json(tree.json()) == tree
    assert P.from_json(json.dumps(json.loads(tree.json()))) == tree


def test_known_json():
    assert P.from_json('{"Comparison":{"column":"ts","op":"Gt","value":{"Int64":1}}}') == P.compare("ts", ">", 1)
    assert P.from_json('{"IsNull":{"column":"c"}}') == P.is_null("c")
    with pytest.raises(ValueError):
        P.from_json('{"Like":{"column":"c"}}')
    with pytest.raises(ValueError):
        P.from_json('{"Comparison":{"column":"c","op":"Near","value":"Null"}}')


def test_text_is_sql_even_with_quotes(spark):
    df = spark.createDataFrame([("it's",), ("a\\b",), (None,)], "s string")
    for v in ("it's", "a\\b"):
        p = P.compare("s", "Eq", v)
        assert [r.s for r in df.filter(p.text()).collect()] == [r.s for r in df.filter(p.to_column()).collect()] == [v]


def test_exact_nulls_and_empty_lists(spark):
    df = spark.createDataFrame([(1,), (None,)], "x long")
    count = lambda p: df.filter(p.to_column()).count()
    assert count(P.is_in("x", [])) == 0 and count(P.is_null("x")) == 1 and count(~P.is_null("x")) == 1
    assert count(P.compare("x", "Eq", None)) == 0 and count(P.compare("x", "Ne", 5)) == 1


def test_integers_against_timestamps_are_micros(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' AS n, TIMESTAMP'2024-01-01 00:00:00.000001' AS z, DATE'2024-01-01' AS d")
    assert isinstance(P.field_type(df.schema, "n"), T.TimestampNTZType) and P.field_type(df.schema, "q") is None
    p = P.compare("n", "Eq", 1704067200000001) & P.compare("z", "Eq", 1704067200000001) & P.compare("d", "Eq", 19723)
    assert df.filter(p.to_column(df.schema)).count() == 1


def test_nested_column(spark):
    df = spark.sql("SELECT named_struct('b', 3) AS a UNION ALL SELECT named_struct('b', 30)")
    assert df.filter(TREES[3].to_column(df.schema)).count() == 1


def test_pushed_to_the_files(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS v").write.parquet(str(tmp_path / "t"))
    from prunescan.plans.scan import scan

    plan = scan(spark, str(tmp_path / "t"), P.compare("id", "Gt", 5), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "v" not in plan.split("ReadSchema")[1].split("\n")[0]

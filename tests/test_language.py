import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from millrace.errors import PlanError
from millrace.predicate import evaluate, lower, parse
from millrace.schema import Exact, Relative, Subset
from millrace.types import parse as kind
from millrace.types import spell

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType()), T.StructField("my col", T.DoubleType()), T.StructField("x.y", T.LongType())])
ROWS = [(1, "x", 0.5, 7), (5, "y", 1.5, None), (None, "x", 2.5, 8), (9, None, None, 9)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("a > 1", [5, 9]), ("a >= 1 and b == 'x'", [1]), ("`my col` < 2", [1, 5]), ("not a > 1", [1]), ("is_null(b)", [9]), ("is_not_null(`my col`) and not is_null(a)", [1, 5]),
        ("a == 1 or b == \"y\" and a > 4", [1, 5]), ("(a == 1 or b == 'y') and a > 4", [5]), ("5 <= a", [5, 9]), ("a != 5", [1, 9]), ("x.y == 9", [9]), ("a > 1.9", [5, 9]), ("not (a > 1 and b == 'y')", [1, None]),
    ],
)
def test_filters(spark, text, want):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    assert [r.a for r in df.where(lower(parse(text), SCHEMA)).collect()] == want


@pytest.mark.parametrize("text", ["", "a = 1", "1 == 2", "is_null(1)", "a >", "a > 1 b", "(a > 1", "a AND b", "b > 5", "a == 'x'", "zz > 1", "a == `my col`", "a > 99999999999999999999", "and", "a == 1 or"])
def test_refused(text):
    with pytest.raises(PlanError):
        lower(parse(text), SCHEMA)


leaf = st.sampled_from(["a > 1", "a == 5", "b == 'x'", "b != 'y'", "is_null(a)", "is_not_null(b)", "`my col` <= 1.5"])
tree = st.recursive(leaf, lambda t: st.one_of(t.map(lambda x: f"not ({x})"), st.tuples(t, st.sampled_from(["and", "or"]), t).map(lambda x: f"({x[0]}) {x[1]} ({x[2]})")), max_leaves=6)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(tree, min_size=4, max_size=4))
def test_three_valued_logic(spark, texts):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = df.select(*[lower(parse(t), SCHEMA).alias(str(i)) for i, t in enumerate(texts)]).collect()
    for row, values in zip(ROWS, got):
        assert list(values) == [evaluate(parse(t), dict(zip(SCHEMA.names, row))) for t in texts]


@pytest.mark.parametrize("text", ["null", "bool", "int8", "uint64", "halffloat", "double", "large_string", "binary_view", "date32[day]", "date64[ms]", "timestamp[ns]", "timestamp[us, tz=UTC]", "decimal128(12, 2)", "list<item: int64>", "struct<a: int64, b: list<item: string>>", "any"])
def test_types_round_trip(text):
    assert kind(text).text == text


def test_type_aliases_and_refusals():
    assert kind("float64").text == "double" and kind("utf8").text == "string" and kind("boolean").text == "bool"
    assert spell(kind("struct<a: list<item: int32>>").spark) == "struct<a: list<item: int32>>"
    for bad in ("map<a, b>", "timestamp[h]", "decimal128(40, 2)", "decimal128(5, -2)", "list<item>x", "struct<a>"):
        with pytest.raises(PlanError):
            kind(bad)


def test_schema_differences():
    got = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    codes = lambda d: [(x.code, x.column) for x in d.differences(got, got)]
    assert codes(Exact({"a": "int64", "b": "string"})) == []
    assert codes(Exact({"b": "string", "a": "int64"})) == [("position", "b"), ("position", "a")]
    assert codes(Exact({"a": "int32"})) == [("undeclared", "b"), ("type", "a")]
    assert codes(Subset({"b": "string"})) == [] and codes(Subset({"c": "any"})) == [("missing", "c")]
    assert Relative(adds={"c": "double"}, drops=["a"]).resolve(got).names == ["b", "c"]
    with pytest.raises(PlanError):
        Relative(drops=["z"]).resolve(got)

import datetime as dt
import hashlib
import struct

import pytest
from pyspark.sql import types as T

from millrace.errors import PlanError
from millrace.operators import STANDARD, Cast, ConcatStr, DateTrunc, Dedupe, Drop, Explode, FillNull, Filter, Hash, Join, Mask, Rename, Select, Union, chain, make
from millrace.operators.blake3 import blake3
from millrace.operators.combine import numbered
from millrace.types import same

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("at", T.TimestampNTZType()), T.StructField("tags", T.ArrayType(T.LongType())), T.StructField("day", T.DateType())])
ROWS = [
    (1, "alice", 1.5, dt.datetime(2024, 3, 15, 10, 30, 45), [1, 2], dt.date(2024, 3, 15)),
    (2, None, None, dt.datetime(1970, 1, 1), [], dt.date(1970, 1, 1)),
    (2, "bob", 20.0, dt.datetime(1969, 12, 31, 23, 59, 59), None, dt.date(1969, 12, 31)),
    (None, "carol", 7.25, None, [3], None),
]


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def column(df, name):
    return [r[name] for r in df.collect()]


def test_filter_keeps_true_rows_only(hand):
    assert column(Filter("score > 5 and is_not_null(name)").apply(hand), "id") == [2, None]


def test_fill_null(hand):
    out = FillNull({"name": "?", "score": 0}).apply(hand).collect()
    assert out[1].name == "?" and out[1].score == 0.0 and out[0].name == "alice"
    with pytest.raises(PlanError):
        FillNull({"name": 3}).apply(hand)
    with pytest.raises(PlanError):
        FillNull({"name": None})


def test_dedupe_keeps_the_first_and_treats_nulls_as_equal(spark, hand):
    from pyspark.sql import functions as F

    ordered = hand.withColumn("n", F.monotonically_increasing_id())
    assert sorted(column(Dedupe("id", order="n").apply(ordered.union(ordered)), "name"), key=str) == [None, "alice", "carol"]


def test_cast_lenient_and_strict(hand):
    assert column(Cast({"name": "int64"}).apply(hand), "name") == [None] * 4
    with pytest.raises(Exception, match="not a int64"):
        Cast({"name": "int64"}, strict=True).apply(hand).collect()
    # A dropped column is never cast.
    assert chain(hand, [Cast({"name": "int64"}, strict=True), Drop("name")]).count() == 4
    with pytest.raises(PlanError):
        Cast({"tags": "int64"}).apply(hand)
    with pytest.raises(PlanError):
        Cast({"id": "nonsense"})


def test_projections_refuse_what_is_absent(hand):
    for op in (Select(["nope"]), Drop("nope"), Rename({"nope": "x"}), Explode("nope"), Hash("nope"), Mask("nope"), ConcatStr(["nope"])):
        with pytest.raises(PlanError):
            op.apply(hand)
    assert Select("id").apply(hand).columns == ["id"]
    assert Select(["id", "name", "id"]).apply(hand).columns == ["id", "name", "id"]


def test_rename_applies_pairs_in_turn(hand):
    two = Select(["id", "name"]).apply(hand)
    assert Rename({"id": "name", "name": "id"}).apply(two).columns == ["id", "name"]
    with pytest.raises(PlanError):
        Rename({"id": "name"}).apply(two)


def test_mask(hand):
    assert column(Mask("name").apply(hand), "name") == ["*****", None, "***", "*****"]
    assert column(Mask("name", "partial", keep=2).apply(hand), "name") == ["***ce", None, "*ob", "***ol"]
    assert column(Mask("name", "partial", keep=0).apply(hand), "name")[0] == "*****"
    assert column(Mask("name", "partial").apply(hand), "name")[2] == "bob"
    assert column(Mask("name", "hash").apply(hand), "name")[0] == hashlib.sha256(b"alice").hexdigest()
    assert column(Mask("tags", "null").apply(hand), "tags") == [None] * 4
    for bad in (dict(mode="x"), dict(keep=2), dict(mode="partial", keep=-1)):
        with pytest.raises(PlanError):
            Mask("name", **bad)
    with pytest.raises(PlanError):
        Mask("id").apply(hand)


def test_concat_str_is_null_if_a_part_is(hand):
    assert column(ConcatStr(["name", "id"], "-").apply(hand), "concat") == ["alice-1", None, "bob-2", None]


def test_explode_keeps_rows_without_elements(hand):
    out = Explode("tags").apply(hand)
    assert column(out, "id") == [1, 1, 2, 2, None] and column(out, "tags") == [1, 2, None, None, 3]
    assert out.columns == hand.columns


def test_date_trunc_floors_before_1970(hand):
    assert column(DateTrunc("at", "month").apply(hand), "at") == [dt.datetime(2024, 3, 1), dt.datetime(1970, 1, 1), dt.datetime(1969, 12, 1), None]
    assert column(DateTrunc("day", "year").apply(hand), "day") == [dt.date(2024, 1, 1), dt.date(1970, 1, 1), dt.date(1969, 1, 1), None]
    assert column(DateTrunc("day", "hour").apply(hand), "day")[0] == dt.date(2024, 3, 15)
    assert isinstance(DateTrunc("at", "day").apply(hand).schema["at"].dataType, T.TimestampNTZType)
    with pytest.raises(PlanError):
        DateTrunc("at", "week")


def frame(*values):
    return b"".join(b"\0" if v is None else b"\1" + struct.pack("<Q", len(v)) + v for v in values)


def test_hash_frames_values(hand):
    want = [hashlib.sha256(frame(*v)).hexdigest() for v in [(b"alice", b"1"), (None, b"2"), (b"bob", b"2"), (b"carol", None)]]
    assert column(Hash(["name", "id"]).apply(hand), "hash") == want
    assert column(Hash("name", algo="blake3", output="b").apply(hand), "b")[0] == blake3(frame(b"alice")).hex()
    with pytest.raises(PlanError):
        Hash("name", output="id").apply(hand)
    with pytest.raises(PlanError):
        Hash("name", algo="md5")


def test_blake3_vectors():
    assert blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert blake3(bytes(i % 251 for i in range(2049))).hex().startswith("5f4d72f40d7a5f82b15ca2b2e44b1de3")


def test_union(spark, hand):
    a, b = Select(["id", "name"]).apply(hand), Select(["name", "id"]).apply(hand)
    assert Union().apply(a, a, a).count() == 12
    with pytest.raises(PlanError):
        Union().apply(a, b)
    with pytest.raises(PlanError):
        Union().apply(a, Cast({"id": "string"}).apply(a))
    with pytest.raises(PlanError):
        make("union", {"by": "id"})


def test_positional_join(spark, hand):
    out = Join.fold(hand, [[Select("id")], [Mask("name"), Select("name")]])
    assert [tuple(r) for r in out.collect()] == [(1, "*****"), (2, None), (2, "***"), (None, "*****")]
    with pytest.raises(PlanError):
        Join.fold(hand, [[Select("id")], [Select("id")]])
    with pytest.raises(PlanError):
        Join.fold(hand, [[Filter("id > 1")]])
    n = numbered(hand)
    assert Join().apply(n.select("__row_id", "id"), n.select("__row_id", "name")).count() == 4
    with pytest.raises(Exception, match="missing in an input"):
        Join().apply(n.select("__row_id", "id"), Filter("score > 5").apply(n).select("__row_id", "name")).collect()
    with pytest.raises(PlanError):
        make("join", {"on": "id"})


def test_planned_schema_is_the_produced_one(hand):
    for op in (Cast({"id": "string"}), Rename({"id": "key"}), Select(["name", "id"]), Drop("tags"), Filter("id > 1"), FillNull({"score": 1}), Dedupe("id"), Hash("name"), Mask("name"), Explode("tags"), ConcatStr(["name", "id"]), DateTrunc("at", "day", "cut")):
        planned, made = op.plan(hand.schema), op.apply(hand).schema
        assert planned.names == made.names and all(same(a.dataType, b.dataType) for a, b in zip(planned, made)), op


def test_fingerprint_ignores_key_order():
    assert Cast({"a": "int64", "b": "string"}).fingerprint() == Cast({"b": "string", "a": "int64"}).fingerprint()
    assert Cast({"a": "int64"}).fingerprint() != Cast({"a": "int32"}).fingerprint()


@pytest.mark.parametrize("name,args", [("cast", {}), ("cast", {"columns": {}}), ("select", {"columns": []}), ("filter", {"expr": ""}), ("hash", {"columns": "a", "what": 1}), ("nope", {}), ("explode", {"column": ["a"]}), ("rename", {"columns": {"a": 1}})])
def test_arguments_are_checked_at_construction(name, args):
    with pytest.raises(PlanError):
        make(name, args)


def test_the_vocabulary():
    assert sorted(STANDARD) == sorted("cast rename select drop filter fill_null dedupe hash mask explode concat_str date_trunc union join".split())


def test_filter_reaches_the_scan(spark, tmp_path, hand, capsys):
    hand.write.parquet(str(tmp_path / "t"))
    chain(spark.read.parquet(str(tmp_path / "t")), [Filter("score > 5"), Select("id")]).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(score,5.0)" in plan and "ReadSchema: struct<id:bigint,score:double>" in plan

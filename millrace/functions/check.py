"""Trying a function on made-up batches before any data: empty, one row, random, all null and edge values."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..schema import require
from .udf import Function

EDGES = {
    T.BooleanType: [True, False], T.ByteType: [-128, 0, 127], T.ShortType: [-(2**15), 0, 2**15 - 1], T.IntegerType: [-(2**31), 0, 2**31 - 1], T.LongType: [-(2**63), 0, 2**63 - 1],
    T.FloatType: [0.0, -0.0, float("inf"), float("nan")], T.DoubleType: [0.0, -0.0, 1e308, float("-inf"), float("nan")], T.StringType: ["", " ", "é漢😀", "a" * 300], T.BinaryType: [b"", b"\0\xff"],
    T.DateType: [dt.date(1, 1, 1), dt.date(1970, 1, 1), dt.date(9999, 12, 31)], T.TimestampNTZType: [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29)], T.TimestampType: [dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2024, 2, 29)],
}


def _value(kind: T.DataType, r: random.Random):
    if isinstance(kind, T.ArrayType):
        return [_value(kind.elementType, r) for _ in range(r.randint(0, 3))]
    if isinstance(kind, T.StructType):
        return {f.name: _value(f.dataType, r) for f in kind}
    if isinstance(kind, T.DecimalType):
        return Decimal(r.randint(-99, 99)).scaleb(-kind.scale) if kind.precision >= 2 else Decimal(0)
    if isinstance(kind, T.StringType):
        return "".join(r.choice("abc xyz09") for _ in range(r.randint(0, 12)))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return r.uniform(-100, 100)
    if type(kind) in (T.ByteType, T.ShortType, T.IntegerType, T.LongType):
        return r.randint(-100, 100)
    return r.choice(EDGES.get(type(kind), [None]))


def batches(schema: T.StructType, seed: int = 0, rows: int = 64) -> dict[str, pa.RecordBatch]:
    """The made-up batches by name; the seed determines them."""
    r, arrow = random.Random(seed), to_arrow_schema(schema)
    make = lambda rs: pa.RecordBatch.from_pylist(rs, schema=arrow)
    some = lambda n: [{f.name: _value(f.dataType, r) for f in schema} for _ in range(n)]
    longest = max((len(EDGES.get(type(f.dataType), [0])) for f in schema), default=1)
    edge = [{f.name: (e := EDGES.get(type(f.dataType)) or [_value(f.dataType, r)])[i % len(e)] for f in schema} for i in range(longest)]
    return {"empty": make([]), "one row": make(some(1)), "random": make(some(rows)), "all null": make([{f.name: None for f in schema}] * 4), "edges": make(edge)}


def check_function(f: Function, schema: T.StructType, seed: int = 0) -> dict[str, str]:
    """For each made-up batch, "ok" or what went wrong."""
    given, out = f.plan(schema), {}
    for what, batch in batches(schema, seed).items():
        try:
            for b in f._once(f._state(), batch):
                require(given, from_arrow_schema(b.schema), f.label)
            out[what] = "ok"
        except Exception as e:
            out[what] = f"{type(e).__name__}: {e}"
    return out

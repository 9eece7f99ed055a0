"""cast, rename, select, drop and fill_null: pure projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..predicate import strict as strict_literal
from ..schema import field_of
from ..types import parse
from .base import Env, Operator, Pairs, mapping, names

ATOMIC = (T.BooleanType, T.NumericType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def castable(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of a can be cast to b at all."""
    if type(a) is type(b) and not isinstance(a, (T.ArrayType, T.StructType)) or isinstance(a, T.NullType):
        return True
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return castable(a.elementType, b.elementType)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return len(a) == len(b) and all(castable(x.dataType, y.dataType) for x, y in zip(a, b))
    if not isinstance(a, ATOMIC) or not isinstance(b, ATOMIC) or isinstance(b, T.NullType):
        return False
    times, numbers = (T.DateType, T.TimestampType, T.TimestampNTZType), T.NumericType
    if isinstance(b, T.BinaryType) or isinstance(a, T.BinaryType):
        return isinstance(a, (T.StringType, T.BinaryType)) and isinstance(b, (T.StringType, T.BinaryType))
    if isinstance(a, times) and isinstance(b, (numbers, T.BooleanType)) or isinstance(b, times) and isinstance(a, (numbers, T.BooleanType)):
        return isinstance(a, T.TimestampType) and isinstance(b, numbers) or isinstance(b, T.TimestampType) and isinstance(a, numbers)
    return True


class Cast(Operator):
    """cast({column: type}, strict=None): failures become null, or errors if strict."""

    name, row_wise = "cast", True

    def __init__(self, columns: dict, strict: bool | None = None):
        self.columns = mapping(columns, "cast: columns")
        if strict is not None and not isinstance(strict, bool):
            raise PlanError("cast: strict must be true or false")
        self.strict = strict
        self._kinds = {}
        for n, t in self.columns.items():
            k = parse(t) if isinstance(t, str) else None
            if k is None or k.spark is None:
                raise PlanError(f"cast: {n!r} needs a type, not {t!r}")
            if "[ns" in k.text and strict is not False and strict is not None:
                raise PlanError(f"cast: {k.text} would lose digits")
            self._kinds[n] = k

    def plan(self, schema):
        for n, k in self._kinds.items():
            if not castable(field_of(schema, n, "cast").dataType, k.spark):
                raise PlanError(f"cast: {n!r} can't be a {k.text}")
        return T.StructType([T.StructField(f.name, self._kinds[f.name].spark) if f.name in self._kinds else f for f in schema])

    def _one(self, n: str, c: Column) -> Column:
        k = self._kinds[n]
        out = c.try_cast(k.spark)
        if k.limit is not None:
            out = F.when((out >= 0) & (out <= k.limit), out)
        if self.strict:
            out = F.when(c.isNotNull() & out.isNull(), F.raise_error(F.lit(f"cast: a value of {n} is not a {k.text}")).cast(k.spark)).otherwise(out)
        return out

    def project(self, env: Env, schema) -> Env:
        return {n: self._one(n, c) if n in self._kinds else c for n, c in env.items()}


class Rename(Operator):
    """rename({old: new}): pairs apply one after another in key order, each on the names of then."""

    name, row_wise = "rename", True

    def __init__(self, columns: dict):
        self.columns = mapping(columns, "rename: columns")
        if not all(isinstance(v, str) and v for v in self.columns.values()):
            raise PlanError("rename: new names must be text")

    def _names(self, old: list[str]) -> list[str]:
        now = list(old)
        for a, b in self.columns.items():
            if a not in now:
                raise PlanError(f"rename: no column {a!r}")
            now[now.index(a)] = b
        if len(set(now)) < len(now):
            raise PlanError(f"rename: two columns would be called {next(n for n in now if now.count(n) > 1)!r}")
        return now

    def plan(self, schema):
        return T.StructType([T.StructField(n, f.dataType, f.nullable, f.metadata) for n, f in zip(self._names(schema.names), schema)])

    def project(self, env: Env, schema) -> Env:
        return dict(zip(self._names(list(env)), env.values()))


class Select(Operator):
    """select(columns): these columns in this order; a name given twice comes twice."""

    name, row_wise = "select", True

    def __init__(self, columns):
        self.columns = names(columns, "select: columns")

    def plan(self, schema):
        return T.StructType([field_of(schema, n, "select") for n in self.columns])

    def project(self, env: Env, schema) -> Env:
        pairs = [(n, env[n]) for n in self.columns]
        return dict(pairs) if len(set(self.columns)) == len(pairs) else Pairs(pairs)


class Drop(Operator):
    """drop(columns): an absent column is an error."""

    name, row_wise = "drop", True

    def __init__(self, columns):
        self.columns = names(columns, "drop: columns")

    def plan(self, schema):
        for n in self.columns:
            field_of(schema, n, "drop")
        return T.StructType([f for f in schema if f.name not in self.columns])

    def project(self, env: Env, schema) -> Env:
        return {n: c for n, c in env.items() if n not in self.columns}


class FillNull(Operator):
    """fill_null({column: literal}): the literal must be of the column's type; text needs text."""

    name, row_wise = "fill_null", True

    def __init__(self, columns: dict):
        self.columns = mapping(columns, "fill_null: columns")
        for n, v in self.columns.items():
            if not isinstance(v, (str, int, float, bool)):
                raise PlanError(f"fill_null: {n!r} needs a literal that is not null")

    def _values(self, schema) -> dict:
        return {n: strict_literal(v, field_of(schema, n, "fill_null").dataType, f"fill_null: {n}") for n, v in self.columns.items()}

    def plan(self, schema):
        self._values(schema)
        return T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in self.columns) for f in schema])

    def project(self, env: Env, schema) -> Env:
        values = self._values(schema)
        return {n: F.coalesce(c, F.lit(values[n]).cast(schema[n].dataType)) if n in values else c for n, c in env.items()}

"""hash, mask, concat_str and date_trunc."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..schema import field_of
from .base import Env, Operator, names, new_name, text
from .blake3 import blake3_many


def as_text(c: Column, kind: T.DataType) -> Column:
    """The text form of a value: ISO 8601 with T for timestamps, plain digits for decimals; others as Spark casts them.

    Floats print in Spark's form (1.0E16), which is this package's canonical form.
    """
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        plain = F.regexp_replace(c.cast("string"), " ", "T")
        return F.concat(plain, F.lit("Z")) if isinstance(kind, T.TimestampType) else plain
    if isinstance(kind, T.BinaryType):
        return F.decode(c, "UTF-8")
    return c.cast("string")


def _texty(schema: T.StructType, columns: list[str], what: str) -> None:
    for n in columns:
        if isinstance(field_of(schema, n, what).dataType, (T.ArrayType, T.StructType, T.MapType)):
            raise PlanError(f"{what}: {n!r} has no text form")


def framed(c: Column, kind: T.DataType) -> Column:
    """Hex of 00 for null, else of 01, the length in bytes as 8 little-endian bytes, and the bytes."""
    raw = c if isinstance(kind, T.BinaryType) else as_text(c, kind).cast("binary")
    size = F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")
    little = F.concat(*[F.substring(size, i, 2) for i in range(15, 0, -2)])
    return F.when(c.isNull(), F.lit("00")).otherwise(F.concat(F.lit("01"), little, F.hex(raw)))


@F.pandas_udf(T.StringType())
def _blake3(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield pd.Series([h.hex() for h in blake3_many([bytes(b) for b in s])], s.index, dtype=object)


class Hash(Operator):
    """hash(columns, algo="sha256", output="hash"): appends lower-case hex over the framed values; never null."""

    name, row_wise = "hash", True

    def __init__(self, columns, algo: str = "sha256", output: str = "hash"):
        self.columns, self.algo, self.output = names(columns, "hash: columns"), text(algo, "hash: algo"), text(output, "hash: output")
        if algo not in ("sha256", "blake3"):
            raise PlanError(f"hash: no algo {algo!r}; there are sha256 and blake3")

    def plan(self, schema):
        _texty(schema, self.columns, "hash")
        new_name(schema, self.output, "hash")
        return T.StructType([*schema.fields, T.StructField(self.output, T.StringType(), False)])

    def project(self, env: Env, schema) -> Env:
        raw = F.unhex(F.concat(*[framed(env[n], schema[n].dataType) for n in self.columns]))
        return {**env, self.output: F.sha2(raw, 256) if self.algo == "sha256" else _blake3(raw)}


class Mask(Operator):
    """mask(columns, mode="redact", keep=4): in place; null stays null."""

    name, row_wise = "mask", True
    MODES = ("redact", "partial", "hash", "null")

    def __init__(self, columns, mode: str = "redact", keep: int | None = None):
        self.columns, self.mode = names(columns, "mask: columns"), mode
        if mode not in self.MODES:
            raise PlanError(f"mask: no mode {mode!r}; there are {', '.join(self.MODES)}")
        if keep is not None and (mode != "partial" or isinstance(keep, bool) or not isinstance(keep, int) or keep < 0):
            raise PlanError("mask: keep is a count, for mode partial only")
        self.keep = 4 if keep is None and mode == "partial" else keep

    def plan(self, schema):
        for n in self.columns:
            if self.mode != "null" and not isinstance(field_of(schema, n, "mask").dataType, T.StringType):
                raise PlanError(f"mask: {n!r} is not text")
            field_of(schema, n, "mask")
        return T.StructType([T.StructField(f.name, f.dataType, f.nullable or self.mode == "null" and f.name in self.columns) for f in schema])

    def _one(self, c: Column, kind: T.DataType) -> Column:
        if self.mode == "null":
            return F.lit(None).cast(kind)
        if self.mode == "hash":
            return F.sha2(c.cast("binary"), 256)
        if self.mode == "redact":
            return F.repeat(F.lit("*"), F.char_length(c))
        hidden = F.greatest(F.char_length(c) - self.keep, F.lit(0))
        return F.concat(F.repeat(F.lit("*"), hidden), F.substring(c, hidden + 1, F.char_length(c)))

    def project(self, env: Env, schema) -> Env:
        return {n: self._one(c, schema[n].dataType) if n in self.columns else c for n, c in env.items()}


class ConcatStr(Operator):
    """concat_str(columns, separator="", output="concat"): appends; null if any value is."""

    name, row_wise = "concat_str", True

    def __init__(self, columns, separator: str = "", output: str = "concat"):
        self.columns, self.separator, self.output = names(columns, "concat_str: columns"), text(separator, "concat_str: separator"), text(output, "concat_str: output")

    def plan(self, schema):
        _texty(schema, self.columns, "concat_str")
        new_name(schema, self.output, "concat_str")
        return T.StructType([*schema.fields, T.StructField(self.output, T.StringType(), True)])

    def project(self, env: Env, schema) -> Env:
        parts: list[Column] = []
        for n in self.columns:
            parts += [F.lit(self.separator)] * bool(parts) + [as_text(env[n], schema[n].dataType)]
        return {**env, self.output: F.concat(*parts)}


class DateTrunc(Operator):
    """date_trunc(column, unit, output=None): floor in UTC, type kept; in place, or in a new column."""

    name, row_wise = "date_trunc", True
    UNITS = ("year", "month", "day", "hour", "minute", "second")

    def __init__(self, column: str, unit: str, output: str | None = None):
        self.column, self.unit, self.output = text(column, "date_trunc: column"), unit, output
        if unit not in self.UNITS:
            raise PlanError(f"date_trunc: no unit {unit!r}; there are {', '.join(self.UNITS)}")
        if output is not None:
            text(output, "date_trunc: output")

    def plan(self, schema):
        kind = field_of(schema, self.column, "date_trunc").dataType
        if not isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            raise PlanError(f"date_trunc: {self.column!r} is not a date or timestamp")
        if self.output is None or self.output == self.column:
            return schema
        new_name(schema, self.output, "date_trunc")
        return T.StructType([*schema.fields, T.StructField(self.output, kind, True)])

    def project(self, env: Env, schema) -> Env:
        kind, c = schema[self.column].dataType, env[self.column]
        if isinstance(kind, T.DateType):
            cut = F.trunc(c, self.unit) if self.unit in ("year", "month") else c
        else:
            cut = F.date_trunc(self.unit, c).cast(kind)
        return {**env, self.output or self.column: cut}

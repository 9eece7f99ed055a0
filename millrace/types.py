"""The declared-type grammar and its Spark types.

Spark has no unsigned integers, half floats or nanoseconds: those widen (``uint64`` to decimal(20, 0)), keep their declared
spelling, and are range-checked on cast; ``timestamp[ns]`` is refused unless losses are allowed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

from .errors import PlanError

# The grammar's spellings and their aliases.
SIMPLE = {
    "null": T.NullType(), "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "halffloat": T.FloatType(), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "large_string": T.StringType(), "string_view": T.StringType(), "binary": T.BinaryType(), "large_binary": T.BinaryType(), "binary_view": T.BinaryType(),
    "date32[day]": T.DateType(), "date64[ms]": T.DateType(),
}
ALIASES = {"boolean": "bool", "float16": "halffloat", "float32": "float", "float64": "double", "utf8": "string", "str": "string", "date32": "date32[day]", "date64": "date64[ms]"}
UNSIGNED = {"uint8": 2**8 - 1, "uint16": 2**16 - 1, "uint32": 2**32 - 1, "uint64": 2**64 - 1}
UNITS = ("s", "ms", "us", "ns")
ANY = "any"
#: Metadata key under which a field keeps its declared spelling.
DECLARED = "declared_type"


@dataclass(frozen=True)
class Declared:
    """A declared type: its canonical spelling and its Spark type (None for ``any``)."""

    text: str
    spark: T.DataType | None

    @property
    def limit(self) -> int | None:
        return UNSIGNED.get(self.text)


def _split(body: str) -> list[str]:
    """Parts between commas outside brackets."""
    parts, depth, last = [], 0, 0
    for i, ch in enumerate(body):
        depth += ch in "<[("
        depth -= ch in ">])"
        if ch == "," and not depth:
            parts.append(body[last:i])
            last = i + 1
    return [*parts, body[last:]]


def _field(text: str) -> tuple[str, Declared]:
    name, colon, kind = text.partition(":")
    if not colon or not name.strip():
        raise PlanError(f"a field needs a name and a type: {text.strip()!r}")
    return name.strip(), parse(kind)


def parse(text: str) -> Declared:
    """Read a declared type."""
    t = text.strip()
    t = ALIASES.get(t, t)
    if t == ANY:
        return Declared(ANY, None)
    if t in SIMPLE:
        return Declared(t, SIMPLE[t])
    if m := re.fullmatch(r"timestamp\[\s*(\w+)\s*(?:,\s*tz\s*=\s*([^\]]+?)\s*)?\]", t):
        if m[1] not in UNITS:
            raise PlanError(f"unknown unit {m[1]!r} in {text!r}")
        return Declared(f"timestamp[{m[1]}, tz={m[2]}]" if m[2] else f"timestamp[{m[1]}]", T.TimestampType() if m[2] else T.TimestampNTZType())
    if m := re.fullmatch(r"decimal128\(\s*(\d+)\s*,\s*(-?\d+)\s*\)", t):
        p, s = int(m[1]), int(m[2])
        if not 1 <= p <= 38 or not 0 <= s <= p:
            raise PlanError(f"{text!r} has no Spark decimal")
        return Declared(f"decimal128({p}, {s})", T.DecimalType(p, s))
    if m := re.fullmatch(r"(list|large_list)<(.*)>", t, re.S):
        inner = m[2]
        name, kind = _field(inner) if re.match(r"\s*\w+\s*:", inner) else ("item", parse(inner))
        return Declared(f"{m[1]}<{name}: {kind.text}>", T.ArrayType(_some(kind), True))
    if m := re.fullmatch(r"struct<(.*)>", t, re.S):
        fields = [_field(x) for x in _split(m[1])] if m[1].strip() else []
        return Declared("struct<" + ", ".join(f"{n}: {k.text}" for n, k in fields) + ">", T.StructType([T.StructField(n, _some(k), True) for n, k in fields]))
    raise PlanError(f"unknown type {text!r}")


def _some(kind: Declared) -> T.DataType:
    if kind.spark is None:
        raise PlanError("any can't be nested")
    return kind.spark


NAMES = {T.NullType: "null", T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BinaryType: "binary", T.DateType: "date32[day]", T.TimestampNTZType: "timestamp[us]", T.TimestampType: "timestamp[us, tz=UTC]"}


def spell(kind: T.DataType) -> str:
    """The grammar's spelling of a Spark type; others as Spark prints them."""
    if type(kind) in NAMES:
        return NAMES[type(kind)]
    if isinstance(kind, T.DecimalType):
        return f"decimal128({kind.precision}, {kind.scale})"
    if isinstance(kind, T.ArrayType):
        return f"list<item: {spell(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"{f.name}: {spell(f.dataType)}" for f in kind) + ">"
    return kind.simpleString()


def same(a: T.DataType, b: T.DataType) -> bool:
    """Equal but for nullability."""
    return spell(a) == spell(b)

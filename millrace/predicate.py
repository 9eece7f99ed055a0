"""The filter language: comparisons, null tests, and / or / not with three-valued logic, checked against a schema."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import PlanError
from .schema import field_of
from .session import column
from .types import same, spell

TOKEN = re.compile(r"\s*(?:(?P<op>==|!=|<=|>=|<|>|\(|\))|`(?P<quoted>[^`]+)`|'(?P<single>[^']*)'|\"(?P<double>[^\"]*)\"|(?P<number>-?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w.]*))")
COMPARE = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
LEVELS = ("or", "and")


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Compare:
    op: str
    left: Name | Literal
    right: Name | Literal


@dataclass(frozen=True)
class NullTest:
    name: str
    null: bool


@dataclass(frozen=True)
class Logic:
    op: str
    parts: tuple


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise PlanError(f"filter: can't read {text[at:].strip()[:20]!r}; a comparison is ==, !=, <, <=, > or >=")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.all, self.at = tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.all[self.at] if self.at < len(self.all) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        got = self.peek()
        if value is not None and got != ("op", value):
            raise PlanError(f"filter: {value!r} expected, not {got[1] or 'the end'!r}")
        self.at += 1
        return got

    def level(self, k: int = 0):
        if k == len(LEVELS):
            return self.negation()
        parts = [self.level(k + 1)]
        while self.peek() == ("word", LEVELS[k]):
            self.at += 1
            parts.append(self.level(k + 1))
        return parts[0] if len(parts) == 1 else Logic(LEVELS[k], tuple(parts))

    def negation(self):
        if self.peek() == ("word", "not"):
            self.at += 1
            return Logic("not", (self.negation(),))
        return self.atom()

    def atom(self):
        kind, value = self.peek()
        if (kind, value) == ("op", "("):
            self.at += 1
            inner = self.level()
            self.take(")")
            return inner
        if kind == "word" and value in ("is_null", "is_not_null") and self.all[self.at + 1 : self.at + 2] == [("op", "(")]:
            self.at += 2
            name = self.operand()
            self.take(")")
            if not isinstance(name, Name):
                raise PlanError(f"filter: {value} takes a column")
            return NullTest(name.name, value == "is_null")
        left = self.operand()
        kind, op = self.take()
        if kind != "op" or op not in COMPARE:
            raise PlanError(f"filter: a comparison expected, not {op or 'the end'!r}")
        right = self.operand()
        if isinstance(left, Literal) and isinstance(right, Literal):
            raise PlanError("filter: a comparison of two literals")
        return Compare(op, left, right)

    def operand(self) -> Name | Literal:
        kind, value = self.take()
        if kind in ("single", "double"):
            return Literal(value)
        if kind == "number":
            try:
                n = int(value)
            except ValueError:
                return Literal(float(value))
            return Literal(n if -(2**63) <= n < 2**63 else float(value))
        if kind == "quoted":
            return Name(value)
        if kind == "word" and value in ("true", "false"):
            return Literal(value == "true")
        if kind == "word" and value not in ("and", "or", "not"):
            return Name(value)
        raise PlanError(f"filter: a column or literal expected, not {value or 'the end'!r}")


def parse(text: str):
    if not isinstance(text, str) or not text.strip():
        raise PlanError("filter: expr is empty")
    p = _Parser(text)
    tree = p.level()
    if p.peek()[0] != "end":
        raise PlanError(f"filter: {p.peek()[1]!r} is left over")
    return tree


RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def strict(value, kind: T.DataType, what: str):
    """The literal as a value of the column's type, or PlanError."""

    def no() -> PlanError:
        return PlanError(f"{what}: {value!r} is not a {spell(kind)}")

    text, number = isinstance(value, str), isinstance(value, (int, float)) and not isinstance(value, bool)
    try:
        if isinstance(kind, T.StringType):
            if not text:
                raise PlanError(f"{what}: a text column and {value!r}; quote it")
            return value
        if isinstance(kind, T.BooleanType):
            if isinstance(value, bool):
                return value
            if text and value.lower() in ("true", "false"):
                return value.lower() == "true"
            if number:
                return bool(value)
            raise no()
        if type(kind) in RANGES:
            n = int(value)
            if not -(2 ** RANGES[type(kind)]) <= n < 2 ** RANGES[type(kind)]:
                raise no()
            return n
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return float(value)
        if isinstance(kind, T.DecimalType):
            d = Decimal(str(value)).quantize(Decimal(1).scaleb(-kind.scale))
            if len(d.as_tuple().digits) > kind.precision:
                raise no()
            return d
        if isinstance(kind, T.BinaryType) and text:
            return bytearray(value.encode())
        if isinstance(kind, T.DateType) and text:
            return dt.date.fromisoformat(value)
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType)) and text:
            at = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
            if isinstance(kind, T.TimestampType):
                return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
            return at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    except (ValueError, OverflowError, InvalidOperation):
        raise no() from None
    raise no()


def lower(tree, schema: T.StructType, env: dict[str, Column] | None = None) -> Column:
    """The predicate as a Column; names are resolved exactly, in ``env`` if given."""
    col = lambda n: env[n] if env else column(n)
    if isinstance(tree, Logic):
        parts = [lower(p, schema, env) for p in tree.parts]
        if tree.op == "not":
            return ~parts[0]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree.op == "and" else out | p
        return out
    if isinstance(tree, NullTest):
        field_of(schema, tree.name, "filter")
        return col(tree.name).isNull() if tree.null else col(tree.name).isNotNull()
    kinds = [field_of(schema, x.name, "filter").dataType if isinstance(x, Name) else None for x in (tree.left, tree.right)]
    if None not in kinds and not same(*kinds):
        raise PlanError(f"filter: {tree.left.name} is {spell(kinds[0])}, {tree.right.name} is {spell(kinds[1])}")
    sides = [col(x.name) if isinstance(x, Name) else F.lit(strict(x.value, other, "filter")).cast(other) for x, other in ((tree.left, kinds[1]), (tree.right, kinds[0]))]
    return getattr(sides[0], COMPARE[tree.op])(sides[1])


def evaluate(tree, row: dict):
    """The same logic on plain Python values (None is unknown); tests hold ``lower`` against it."""
    if isinstance(tree, Logic):
        parts = [evaluate(p, row) for p in tree.parts]
        if tree.op == "not":
            return None if parts[0] is None else not parts[0]
        if tree.op == "and":
            return False if False in parts else None if None in parts else True
        return True if True in parts else None if None in parts else False
    if isinstance(tree, NullTest):
        return (row[tree.name] is None) == tree.null
    a, b = (row[x.name] if isinstance(x, Name) else x.value for x in (tree.left, tree.right))
    return None if a is None or b is None else getattr(a, COMPARE[tree.op])(b)

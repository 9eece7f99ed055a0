"""Schema declarations and how a schema differs from one. Nullability is never compared."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import PlanError
from .types import Declared, parse, same, spell


@dataclass(frozen=True)
class Difference:
    """code is type, missing, undeclared or position."""

    code: str
    column: str
    detail: str = ""

    def __str__(self) -> str:
        return f"{self.code}: {self.column}" + f" ({self.detail})" * bool(self.detail)


def _declared(columns: dict) -> dict[str, Declared]:
    return {n: k if isinstance(k, Declared) else Declared(spell(k), k) if isinstance(k, T.DataType) else parse(k) for n, k in columns.items()}


@dataclass
class Exact:
    """Exactly these columns in this order."""

    columns: dict

    def differences(self, got: T.StructType, given: T.StructType | None = None) -> list[Difference]:
        want, names = _declared(self.columns), got.names
        out = [Difference("missing", n) for n in want if n not in names]
        out += [Difference("undeclared", n) for n in names if n not in want]
        out += _types(want, got)
        if not out and list(want) != names:
            out += [Difference("position", n, f"is {names.index(n)}, declared {i}") for i, n in enumerate(want) if names.index(n) != i]
        return out


@dataclass
class Subset:
    """These columns at least, anywhere."""

    columns: dict

    def differences(self, got: T.StructType, given: T.StructType | None = None) -> list[Difference]:
        want = _declared(self.columns)
        return [Difference("missing", n) for n in want if n not in got.names] + _types(want, got)


@dataclass
class Relative:
    """What a function adds, drops and changes of its input."""

    adds: dict = field(default_factory=dict)
    drops: list = field(default_factory=list)
    changes: dict = field(default_factory=dict)

    def resolve(self, given: T.StructType) -> T.StructType:
        for n in [*self.drops, *self.changes]:
            if n not in given.names:
                raise PlanError(f"declared to drop or change {n!r}, which the input lacks")
        for n in self.adds:
            if n in given.names and n not in self.drops:
                raise PlanError(f"declared to add {n!r}, which the input has")
        changes, adds = _declared(self.changes), _declared(self.adds)
        kept = [T.StructField(f.name, changes[f.name].spark if f.name in changes else f.dataType) for f in given if f.name not in self.drops]
        return T.StructType(kept + [T.StructField(n, k.spark) for n, k in adds.items()])

    def differences(self, got: T.StructType, given: T.StructType | None = None) -> list[Difference]:
        if given is None:
            raise PlanError("a relative declaration needs an input schema")
        return Exact({f.name: f.dataType for f in self.resolve(given)}).differences(got)


def _types(want: dict[str, Declared], got: T.StructType) -> list[Difference]:
    return [Difference("type", n, f"is {spell(got[n].dataType)}, declared {k.text}") for n, k in want.items() if n in got.names and k.spark is not None and not same(k.spark, got[n].dataType)]


def declaration(x) -> Exact | Subset | Relative | None:
    """From a declaration, a schema, a dict of columns, or a dict of adds, drops and changes."""
    if x is None or isinstance(x, (Exact, Subset, Relative)):
        return x
    if isinstance(x, T.StructType):
        return Exact({f.name: f.dataType for f in x})
    if isinstance(x, dict) and x and set(x) <= {"adds", "drops", "changes"} and all(isinstance(v, (dict, list)) for v in x.values()):
        return Relative(**x)
    if isinstance(x, dict):
        return Exact(x)
    raise PlanError(f"not a schema declaration: {x!r}")


def require(x, got: T.StructType, what: str, given: T.StructType | None = None) -> None:
    """Raise PlanError if ``got`` isn't as declared."""
    if (d := declaration(x)) and (found := d.differences(got, given)):
        raise PlanError(f"{what}: " + "; ".join(map(str, found)))


def field_of(schema: T.StructType, name: str, what: str) -> T.StructField:
    if name not in schema.names:
        raise PlanError(f"{what}: no column {name!r}; there are {', '.join(schema.names) or 'none'}")
    return schema[name]

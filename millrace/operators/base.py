"""What every standard transformation has: checked arguments, a planned schema, a fingerprint, and a lazy application."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..arguments import Deferred
from ..errors import PlanError
from ..session import column, prepare

VERSION = 1
Env = dict[str, Column]


class Operator(Deferred):
    """One transformation. ``plan`` gives the output schema without running; ``apply`` builds the DataFrame."""

    name = ""
    #: Whether each input row gives one output row from its own columns: such operators are pure projections.
    row_wise = False
    inputs = (1, 1)

    def arguments(self) -> dict:
        return {k: v for k, v in vars(self).items() if not k.startswith("_")}

    def fingerprint(self) -> str:
        """SHA-256 over name, canonical arguments and version; the order of keys doesn't matter."""
        text = json.dumps(self.arguments(), sort_keys=True, separators=(",", ":"), default=str)
        return hashlib.sha256(f"millrace\0{self.name}\0{text}\0{VERSION}".encode()).hexdigest()

    def plan(self, *schemas: T.StructType) -> T.StructType:
        raise NotImplementedError

    def project(self, env: Env, schema: T.StructType) -> Env:
        """For row-wise operators: the output columns from those of the input."""
        raise NotImplementedError

    def check_inputs(self, n: int) -> None:
        low, high = self.inputs
        if n < low or high is not None and n > high:
            raise PlanError(f"{self.name}: takes {low if low == high else f'{low} or more'} inputs, not {n}")

    def apply(self, *dfs: DataFrame) -> DataFrame:
        self.check_inputs(len(dfs))
        prepare(dfs[0].sparkSession)
        self.plan(*(d.schema for d in dfs))
        return self._build(*dfs)

    def _build(self, df: DataFrame) -> DataFrame:
        env = self.project({n: column(n) for n in df.columns}, df.schema)
        return df.select(*as_columns(env))

    def __repr__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.arguments().items())})"


class Pairs(list):
    """Output columns in order; a name may occur twice (as ``select`` allows)."""


def as_columns(env: Env | Pairs) -> list[Column]:
    return [c.alias(n) for n, c in (env if isinstance(env, Pairs) else env.items())]


def chain(df: DataFrame, operators: list[Operator]) -> DataFrame:
    """Apply operators one after another; Catalyst fuses runs of projections."""
    return reduce(lambda d, o: o.apply(d), operators, df)


def names(x, what: str) -> list[str]:
    """A list of column names; a bare string is one name."""
    x = [x] if isinstance(x, str) else x
    if not isinstance(x, (list, tuple)) or not x or not all(isinstance(n, str) and n for n in x):
        raise PlanError(f"{what} must be one or more column names")
    return list(x)


def mapping(x, what: str) -> dict:
    if not isinstance(x, dict) or not x or not all(isinstance(k, str) and k for k in x):
        raise PlanError(f"{what} must map column names")
    return {k: x[k] for k in sorted(x)}


def text(x, what: str) -> str:
    if not isinstance(x, str):
        raise PlanError(f"{what} must be text")
    return x


def new_name(schema: T.StructType, name: str, what: str) -> None:
    if name in schema.names:
        raise PlanError(f"{what}: the input has a column {name!r}")


def make(name: str, args: dict | None = None) -> Operator:
    """A standard transformation by name; unknown, missing and misshapen arguments are errors here."""
    from . import STANDARD

    if name not in STANDARD:
        raise PlanError(f"no function {name!r}; there are {', '.join(STANDARD)}")
    try:
        return STANDARD[name](**(args or {}))
    except TypeError as e:
        raise PlanError(f"{name}: {str(e).replace('__init__() ', '')}") from None

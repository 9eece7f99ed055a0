"""filter, dedupe and explode: these change the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..predicate import lower, parse
from ..schema import field_of
from ..session import column
from .base import Operator, as_columns, names

#: Hidden columns that carry the source order: file, then row in the file.
ORDER = ("__source_file", "__source_row")


class Filter(Operator):
    """filter(expr): rows for which the predicate is true; unknown drops a row."""

    name = "filter"

    def __init__(self, expr: str):
        self.expr = expr
        self._tree = parse(expr)

    def plan(self, schema):
        lower(self._tree, schema)
        return schema

    def _build(self, df):
        return df.where(lower(self._tree, df.schema))


def _groupable(kind: T.DataType) -> bool:
    if isinstance(kind, (T.MapType, T.VariantType)):
        return False
    if isinstance(kind, T.ArrayType):
        return _groupable(kind.elementType)
    return not isinstance(kind, T.StructType) or all(_groupable(f.dataType) for f in kind)


class Dedupe(Operator):
    """dedupe(keys): the first row of each key in source order; nulls are equal.

    The order is that of ``order`` columns if given, else of the hidden source-order columns if they are there; else any
    row of a key may stay. First rows are found by a partial aggregation before the shuffle, so a hot key moves one row a task.
    """

    name = "dedupe"

    def __init__(self, keys, order=None):
        self.keys = names(keys, "dedupe: keys")
        self._order = names(order, "dedupe: order") if order else None

    def plan(self, schema):
        for n in self.keys:
            if not _groupable(field_of(schema, n, "dedupe").dataType):
                raise PlanError(f"dedupe: {n!r} can't be a key")
        for n in self._order or ():
            field_of(schema, n, "dedupe")
        return schema

    def _build(self, df: DataFrame) -> DataFrame:
        order = self._order or [n for n in ORDER if n in df.columns]
        if not order or set(self.keys) >= set(df.columns):
            return df.dropDuplicates(self.keys)
        first = F.min_by(F.struct(*[column(n) for n in df.columns]), F.struct(*[column(n) for n in order]))
        return df.groupBy(*[column(n) for n in self.keys]).agg(first.alias("first")).select("first.*")


class Explode(Operator):
    """explode(column): a row for each element; a null or empty list gives one row with null."""

    name = "explode"

    def __init__(self, column: str):
        if not isinstance(column, str) or not column:
            raise PlanError("explode: column must be a column name")
        self.column = column

    def plan(self, schema):
        f = field_of(schema, self.column, "explode")
        if not isinstance(f.dataType, T.ArrayType):
            raise PlanError(f"explode: {self.column!r} is not a list")
        return T.StructType([T.StructField(g.name, g.dataType.elementType, True) if g.name == self.column else g for g in schema])

    def _build(self, df):
        return df.select(*as_columns({n: F.explode_outer(column(n)) if n == self.column else column(n) for n in df.columns}))

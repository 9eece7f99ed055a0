"""union and the positional join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import PlanError
from ..session import column
from ..types import same, spell
from .base import Env, Operator, Pairs, as_columns

#: Hidden column that numbers the rows of a common upstream for branches that aren't pure projections.
ROW = "__row_id"


class Union(Operator):
    """union(): all rows of all inputs; names, types and their order must agree."""

    name, inputs = "union", (1, None)

    def plan(self, *schemas):
        first = schemas[0]
        for i, s in enumerate(schemas[1:], 1):
            if s.names != first.names:
                raise PlanError(f"union: input {i} has columns {s.names}, input 0 {first.names}")
            for a, b in zip(first, s):
                if not same(a.dataType, b.dataType):
                    raise PlanError(f"union: {a.name!r} is {spell(a.dataType)} in input 0, {spell(b.dataType)} in input {i}")
        return T.StructType([T.StructField(f.name, f.dataType, any(s[i].nullable for s in schemas)) for i, f in enumerate(first)])

    def _build(self, *dfs):
        return reduce(DataFrame.union, dfs)


class Join(Operator):
    """join(): columns side by side, row by row, of branches of one upstream; not a relational join.

    Branches that are pure projections fold into one select (``fold``). Others must carry ROW, the row number of the
    upstream; a row that one branch has and another lacks is an error.
    """

    name, inputs = "join", (1, None)

    def plan(self, *schemas):
        fields: list[T.StructField] = []
        for i, s in enumerate(schemas):
            for f in s:
                if f.name == ROW:
                    continue
                if f.name in [g.name for g in fields]:
                    raise PlanError(f"join: input {i} has {f.name!r} too")
                fields.append(f)
        return T.StructType(fields)

    @staticmethod
    def fold(upstream: DataFrame, branches: list[list[Operator]]) -> DataFrame:
        """Chains of row-wise operators over one upstream, as one projection."""
        merged: Env = {}
        for i, operators in enumerate(branches):
            env, schema = {n: column(n) for n in upstream.columns}, upstream.schema
            for o in operators:
                if not o.row_wise:
                    raise PlanError(f"join: {o.name} in branch {i} changes rows")
                planned = o.plan(schema)
                env, schema = o.project(env, schema), planned
            for n, c in env if isinstance(env, Pairs) else env.items():
                if n in merged:
                    raise PlanError(f"join: branch {i} has {n!r} too")
                merged[n] = c
        return upstream.select(*as_columns(merged))

    def _build(self, *dfs):
        if len(dfs) == 1:
            return dfs[0]
        for i, d in enumerate(dfs):
            if ROW not in d.columns:
                raise PlanError(f"join: input {i} has no row numbers; number the upstream, or fold branches that are projections")
        out = dfs[0].withColumn("__in0", F.lit(True))
        for i, d in enumerate(dfs[1:], 1):
            out = out.join(d.withColumn(f"__in{i}", F.lit(True)), ROW, "full")
        ok = reduce(lambda a, b: a & b, [F.col(f"__in{i}").isNotNull() for i in range(len(dfs))])
        wrong = F.concat(F.lit("join: row "), F.col(ROW).cast("string"), F.lit(" is missing in an input"))
        checked = out.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(wrong).cast("boolean")))
        return checked.select(*[column(n) for d in dfs for n in d.columns if n != ROW])


def numbered(df: DataFrame) -> DataFrame:
    """The upstream with ROW; deterministic as long as its partitions are (a scan, or a stored table)."""
    return df.withColumn(ROW, F.monotonically_increasing_id())

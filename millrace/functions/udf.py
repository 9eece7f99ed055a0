"""Batch functions: RecordBatch to RecordBatch, with declared schemas, per-run state and an error policy.

A function may be plain, or have ``setup(context)``, ``__call__(state, batch)`` and ``finish(state)``. It runs inside
``mapInArrow``: state lives for one instance, which is one partition; ``instances=n`` bounds their number. Frame functions
(annotated with pandas, or Polars where importable) get and return frames.
"""

from __future__ import annotations

import copy
import hashlib
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..errors import BudgetError, FunctionError, PlanError
from ..operators.base import Operator
from ..schema import Exact, Relative, Subset, declaration, require
from ..types import parse


def _spark_schema(x) -> T.StructType:
    return T.StructType([T.StructField(n, k if isinstance(k, T.DataType) else parse(k).spark) for n, k in x.columns.items()])


class Skip:
    """Error policy: up to ``most`` failing batches of an instance are skipped (None: any number)."""

    def __init__(self, most: int | None = None):
        self.most = most


class Function(Operator):
    """A user function as a task of a job.

    takes: declaration of the input; gives: of the output (Relative resolves on the input). Without ``gives`` the output
    schema is that of a trial on an empty batch. on_error: "terminate", "skip", ("budget", n) or Skip.
    """

    name = "function"

    def __init__(self, call: Callable | None = None, takes=None, gives=None, instances: int | None = None, on_error="terminate", ports: dict | None = None, name: str | None = None):
        self._call, self._args = call or self, {}
        self.takes, self.gives = declaration(takes if takes is not None else getattr(self, "takes", None)), declaration(gives if gives is not None else getattr(self, "gives", None))
        self.instances, self.ports = instances, ports or {}
        if isinstance(on_error, tuple):
            on_error = Skip(on_error[1])
        self._policy = Skip(None) if on_error == "skip" else on_error
        if not (self._policy == "terminate" or isinstance(self._policy, Skip)):
            raise PlanError("on_error must be terminate, skip or ('budget', n)")
        if instances is not None and instances < 1:
            raise PlanError("instances must be 1 or more")
        self.label = name or getattr(self._call, "__name__", type(self._call).__name__)
        self._stateful = any(hasattr(self._call, m) for m in ("setup", "finish"))
        self._frame = self._annotated()

    def bind(self, given: dict, origin: Function) -> None:
        """Run arguments for this copy of ``origin``: ``args`` of the context, and ``self.args`` of a class."""
        self._args = dict(given)
        self._call = self if origin._call is origin else origin._call if inspect.isfunction(origin._call) else copy.copy(origin._call)
        if not inspect.isroutine(self._call) and not inspect.isclass(self._call):
            try:
                self._call.args = self._args
            except AttributeError:  # a built-in callable takes no attributes
                pass

    def _annotated(self) -> str:
        target = self._call if inspect.isfunction(self._call) else type(self._call).__call__
        kinds = [str(v) for v in getattr(target, "__annotations__", {}).values()]
        return "polars" if any("polars" in k or "LazyFrame" in k for k in kinds) else "pandas" if any("pandas" in k or "pd.DataFrame" in k for k in kinds) else ""

    def arguments(self) -> dict:
        return {"name": self.label, "instances": self.instances, "code": _code(self._call)}

    def _once(self, state, batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        args = (state,) if self._stateful else ()
        if self._frame == "pandas":
            out = self._call(*args, batch.to_pandas())
            return pa.Table.from_pandas(out, preserve_index=False).to_batches() if out is not None else []
        if self._frame == "polars":
            import polars

            out = self._call(*args, polars.from_arrow(pa.Table.from_batches([batch])))
            return (out.collect() if hasattr(out, "collect") else out).to_arrow().to_batches()
        return _batches(self._call(*args, batch))

    def _state(self):
        return self._call.setup({"ports": self.ports, "args": self._args}) if hasattr(self._call, "setup") else None

    def plan(self, schema):
        if self.takes is not None:
            require(self.takes, schema, f"{self.label} takes", schema)
        if isinstance(self.gives, Relative):
            return self.gives.resolve(schema)
        if isinstance(self.gives, Exact):
            return _spark_schema(self.gives)
        try:
            empty = pa.RecordBatch.from_pylist([], schema=to_arrow_schema(schema))
            state = self._state()
            out = self._once(state, empty) + (_batches(self._call.finish(state)) if hasattr(self._call, "finish") else [])
        except Exception as e:
            raise PlanError(f"{self.label}: the trial on an empty batch failed ({e}); declare what it gives") from e
        if not out:
            raise PlanError(f"{self.label}: the trial gave no batch; declare what it gives")
        found = from_arrow_schema(out[0].schema)
        if isinstance(self.gives, Subset):
            require(self.gives, found, f"{self.label} gives")
        return found

    def _build(self, df: DataFrame) -> DataFrame:
        given = self.plan(df.schema)
        want, policy, label = to_arrow_schema(given), self._policy, self.label

        def conform(batch: pa.RecordBatch) -> pa.RecordBatch:
            if batch.schema.names != want.names:
                raise FunctionError(f"{label}: gave columns {batch.schema.names}, declared {want.names}")
            try:
                return pa.RecordBatch.from_arrays([batch.column(i).cast(f.type) for i, f in enumerate(want)], schema=want)
            except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as e:
                raise FunctionError(f"{label}: {e}") from e

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state, failed = self._state(), 0
            for batch in batches:
                try:
                    out = [conform(b) for b in self._once(state, batch)]
                except Exception as e:
                    if policy == "terminate":
                        raise FunctionError(f"{label}: {e}") from e
                    failed += 1
                    if policy.most is not None and failed > policy.most:
                        raise BudgetError(f"{label}: more than {policy.most} batches failed; the last: {e}") from e
                    continue
                yield from out
            if hasattr(self._call, "finish"):
                yield from map(conform, _batches(self._call.finish(state)))

        bounded = df if self.instances is None else df.coalesce(self.instances) if self.instances > 1 else df.repartition(1)
        return bounded.mapInArrow(run, given)


def _code(call) -> str:
    """A digest of the code of a function, or of a class's methods; what it reads elsewhere is not in it."""
    seen = hashlib.sha256()

    def add(code) -> None:
        seen.update(code.co_code + repr((code.co_names, code.co_varnames, [c for c in code.co_consts if not hasattr(c, "co_code")])).encode())
        for c in code.co_consts:
            if hasattr(c, "co_code"):
                add(c)

    target = call if inspect.isfunction(call) else type(call)
    for _, f in [("", target)] if inspect.isfunction(target) else sorted(inspect.getmembers(target, inspect.isfunction)):
        add(f.__code__)
    return seen.hexdigest()[:16]


def _batches(out) -> list[pa.RecordBatch]:
    if out is None:
        return []
    if isinstance(out, pa.RecordBatch):
        return [out]
    return out.to_batches() if isinstance(out, pa.Table) else list(out)


def function(call=None, **options):
    """Decorator: a plain function or a class with ``__call__`` becomes a Function."""
    if call is None:
        return lambda c: function(c, **options)
    return Function(call() if inspect.isclass(call) else call, **options)


def register_scalar(spark: SparkSession, name: str, call: Callable[[pa.RecordBatch], pa.RecordBatch], returns: str) -> None:
    """A batch function as a SQL scalar: takes columns c0, c1, ...; the first column of its result is the value."""
    kind = parse(returns).spark

    @F.arrow_udf(kind)
    def scalar(*columns: pa.Array) -> pa.Array:
        out = call(pa.RecordBatch.from_arrays(list(columns), [f"c{i}" for i in range(len(columns))]))
        first = out.column(0)
        if len(first) != len(columns[0]):
            raise FunctionError(f"{name}: a scalar gives one value a row")
        return first

    spark.udf.register(name, scalar)

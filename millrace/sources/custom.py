"""Sources written by users: a list of splits, each read on an executor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..errors import IoError, PlanError
from ..functions.udf import _batches, _spark_schema
from ..operators.rows import ORDER
from ..schema import declaration
from .base import Input


@dataclass(frozen=True)
class Split:
    """An independently readable part with its exact number of rows."""

    id: int
    rows: int
    bytes: int = 0


class Source:
    """Subclass with ``plan() -> [Split]``, ``read(split_id, start, end) -> batch`` and optionally ``schema()``."""

    repeatable = True

    def plan(self) -> list[Split]:
        raise NotImplementedError

    def read(self, split_id: int, start: int, end: int):
        raise NotImplementedError

    def schema(self):
        return None


class UserSource(Input):
    """A user's Source as a task: unique split ids, exact row counts, the same columns in every batch."""

    name, SAMPLE = "user", 1024

    def __init__(self, source: Source):
        for m in ("plan", "read"):
            if not callable(getattr(source, m, None)):
                raise TypeError(f"{type(source).__name__} lacks {m}()")
        self._source, self.repeatable = source, getattr(source, "repeatable", True)

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        source, splits = self._source, list(self._source.plan())
        if len({s.id for s in splits}) < len(splits):
            raise PlanError("two splits have one id")
        declared = declaration(source.schema()) if hasattr(source, "schema") and source.schema() is not None else None
        if declared is not None:
            kind = _spark_schema(declared)
        elif splits:
            some = next((s for s in splits if s.rows), splits[0])
            kind = from_arrow_schema(_batches(source.read(some.id, 0, min(some.rows, self.SAMPLE)))[0].schema)
        else:
            raise PlanError("a source without splits needs a schema")
        arrow = to_arrow_schema(kind)
        full = kind.add(ORDER[0], "long").add(ORDER[1], "long") if order else kind
        if not splits:
            return spark.createDataFrame([], full)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for place, split, rows in zip(*(c.to_pylist() for c in b.columns)):
                    seen = 0
                    for out in _batches(source.read(split, 0, rows)):
                        if out.schema.names != arrow.names:
                            raise IoError(f"split {split}: columns {out.schema.names}, not {arrow.names}")
                        arrays = [out.column(i).cast(f.type) for i, f in enumerate(arrow)]
                        if order:
                            arrays += [pa.array([place] * len(out), pa.int64()), pa.array(range(seen, seen + len(out)), pa.int64())]
                        seen += len(out)
                        yield pa.RecordBatch.from_arrays(arrays, [*arrow.names, *(ORDER if order else ())])
                    if seen != rows:
                        raise IoError(f"split {split}: {seen} rows, planned {rows}")

        plan = spark.createDataFrame([(i, s.id, s.rows) for i, s in enumerate(splits)], "place long, id long, rows long").repartition(min(len(splits), 10_000), F.col("place"))
        return plan.mapInArrow(run, full)

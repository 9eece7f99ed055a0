"""Arrow IPC files, Arrow streams, and iterators of batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from ..errors import IoError, PlanError
from ..operators.rows import ORDER
from ..schema import declaration
from .base import Input, as_list, files, in_file_order


def _plain(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Dictionary columns unpacked, types as Spark has them."""
    arrays = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in batch.columns]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def _unpacked(schema: pa.Schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema])


class ArrowFileSource(Input):
    """ArrowFileSource(urls, columns=None): Arrow IPC files (``.arrow``); a stream is refused. Columns come in file order.

    Files are read through Spark's binary reader, one task for some files, so any store that Spark reads will do.
    """

    name = "arrow_ipc"

    def __init__(self, urls, columns: list[str] | None = None):
        self.urls, self.columns = as_list(urls), columns

    def places(self):
        return self.urls

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        found = files(spark, self.urls, ".arrow")
        raw = spark.read.format("binaryFile").load(found).select("path", "content")

        def head(path: str) -> pa.Schema:
            body = bytes(raw.where(F.col("path").endswith(path.rsplit("/", 1)[-1])).limit(1).first().content)
            try:
                return _unpacked(pa.ipc.open_file(body).schema)
            except pa.ArrowInvalid as e:
                raise IoError(f"{path} is not an Arrow file: {e}") from e

        spark_schema = from_arrow_schema(head(found[0]))
        schema = to_arrow_schema(spark_schema)
        full = spark_schema.add(ORDER[0], "string").add(ORDER[1], "long") if order else spark_schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, body in zip(b.column(0).to_pylist(), b.column(1)):
                    reader, row = pa.ipc.open_file(body.as_buffer()), 0
                    if _unpacked(reader.schema).names != schema.names:
                        raise IoError(f"{path} has other columns")
                    for i in range(reader.num_record_batches):
                        out = _plain(reader.get_batch(i), schema)
                        if order:
                            out = pa.RecordBatch.from_arrays([*out.columns, pa.array([path] * len(out), pa.string()), pa.array(range(row, row + len(out)), pa.int64())], [*out.schema.names, *ORDER])
                        row += len(out)
                        yield out

        return in_file_order(raw.mapInArrow(run, full), self.columns, "columns", ORDER)


class IteratorSource(Input):
    """IteratorSource(iterable, schema): batches of this process, read once to their end; an empty batch is data."""

    name, repeatable = "iterator", False

    def __init__(self, iterable: Iterable, schema):
        self._it, self.schema = iter(iterable), declaration(schema)
        if self.schema is None:
            raise PlanError("an iterator needs a schema")

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        from ..functions.udf import _spark_schema

        kind = _spark_schema(self.schema)
        arrow, out = to_arrow_schema(kind), []
        for i, b in enumerate(self._it):
            for x in b.to_batches() if isinstance(b, pa.Table) else [b]:
                if x.schema.names != arrow.names:
                    raise IoError(f"batch {i} has columns {x.schema.names}, declared {arrow.names}")
                out.append(_plain(x, arrow))
        df = spark.createDataFrame(pa.Table.from_batches(out, schema=arrow), schema=kind)
        return df.withColumns({ORDER[0]: F.lit(0), ORDER[1]: F.monotonically_increasing_id()}) if order else df


class ArrowStreamSource(IteratorSource):
    """ArrowStreamSource(file): one Arrow IPC stream from a file object or path of this process."""

    name = "arrow_stream"

    def __init__(self, file):
        reader = pa.ipc.open_stream(file)
        kind = from_arrow_schema(_unpacked(reader.schema))
        super().__init__((_plain(b, to_arrow_schema(kind)) for b in reader), kind)

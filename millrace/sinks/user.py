"""Sinks that live in the driver: a user's object, or one Arrow stream. Rows arrive one batch at a time."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IoError
from .base import Output, in_order

ROWS = 10_000


def _local_batches(df: DataFrame):
    """Batches of up to ROWS rows, one partition in the driver at a time."""
    schema, held = to_arrow_schema(df.schema), []
    for row in df.toLocalIterator():
        held.append(row.asDict(recursive=True))
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class Sink:
    """Subclass with ``write(batch)`` and optionally ``finish()``, and both or none of ``checkpoint()`` and ``restore(bytes)``."""

    def write(self, batch: pa.RecordBatch) -> None:
        raise NotImplementedError


class UserSink(Output):
    """A user's Sink: written serially; ``finish`` once, only if all went well."""

    name = "user"

    def __init__(self, sink):
        if not callable(getattr(sink, "write", None)):
            raise TypeError(f"{type(sink).__name__} lacks write()")
        if callable(getattr(sink, "checkpoint", None)) != callable(getattr(sink, "restore", None)):
            raise TypeError(f"{type(sink).__name__} has one of checkpoint() and restore() only")
        self._sink = sink

    def save(self, df, ordered=False):
        try:
            for b in _local_batches(in_order(df, ordered)):
                self._sink.write(b)
            if callable(getattr(self._sink, "finish", None)):
                self._sink.finish()
        except Exception as e:
            raise IoError(f"{type(self._sink).__name__}: {e}") from e


class ArrowStreamSink(Output):
    """One Arrow IPC stream to a file object of this process."""

    name = "arrow_stream"

    def __init__(self, file):
        self._file = file

    def save(self, df, ordered=False):
        df = in_order(df, ordered)
        with pa.ipc.new_stream(self._file, to_arrow_schema(df.schema)) as w:
            for b in _local_batches(df):
                w.write_batch(b)

"""Parquet, Arrow and tensor files.

Parquet is Spark's own writer: part files become visible on commit, with ``_SUCCESS``. Arrow and tensor files go through the
same committer as binary rows: each task packs its rows into file bodies, and one writer per file puts them in place under
a temporary name that a rename makes visible.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import PlanError
from ..sources.tensor import NUMPY
from .base import Output, in_order


class ParquetSink(Output):
    """ParquetSink(url, row_group_bytes=128 MiB, file_bytes=1 GiB, compression="zstd", mode="errorifexists").

    ``file_bytes`` is kept by rows: a sample of the plan's estimated row size sets maxRecordsPerFile.
    """

    name, CODECS = "parquet", {"zstd": "zstd", "snappy": "snappy", "gzip": "gzip", "lz4": "lz4", "none": "none"}

    def __init__(self, url: str, row_group_bytes: int = 128 << 20, file_bytes: int = 1 << 30, compression: str = "zstd", mode: str = "errorifexists"):
        if compression not in self.CODECS:
            raise PlanError(f"compression is one of {', '.join(self.CODECS)}")
        self.url, self.row_group_bytes, self.file_bytes, self.compression, self.mode = url, row_group_bytes, file_bytes, compression, mode

    def places(self):
        return [self.url]

    def save(self, df, ordered=False):
        df = in_order(df, ordered)
        if any(isinstance(f.dataType, T.NullType) for f in df.schema):
            raise PlanError("a column of type null can't be written to Parquet; cast it")
        width = max(8, sum({"string": 64, "binary": 64}.get(f.dataType.typeName(), 8) for f in df.schema))
        w = df.write.mode(self.mode).option("compression", self.CODECS[self.compression]).option("parquet.block.size", self.row_group_bytes)
        w.option("maxRecordsPerFile", max(1, self.file_bytes // width)).parquet(self.url)


def _write_files(df: DataFrame, bodies, url: str, suffix: str, ordered: bool) -> None:
    """Run ``bodies`` (batches to file bodies) in every partition; each body becomes one file, visible when complete."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(url)
    fs = path.getFileSystem(conf)
    if fs.exists(path) and fs.listStatus(path):
        raise PlanError(f"{url} is not empty")
    fs.mkdirs(path)
    packed = in_order(df, ordered).mapInArrow(bodies, "place int, body binary")
    staged = f"{url.rstrip('/')}/_staged"
    packed.withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(staged)
    rows = spark.read.parquet(staged)
    n = 0
    for key in rows.select("part", "place").orderBy("part", "place").collect():  # names only
        body = rows.where((F.col("part") == key.part) & (F.col("place") == key.place)).select("body").first().body
        temporary, final = jvm.org.apache.hadoop.fs.Path(path, f"_part-{n:05d}.tmp"), jvm.org.apache.hadoop.fs.Path(path, f"part-{n:05d}{suffix}")
        stream = fs.create(temporary, True)
        stream.write(bytearray(body))
        stream.close()
        fs.rename(temporary, final)
        n += 1
    fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
    fs.create(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"), True).close()


class ArrowFileSink(Output):
    """ArrowFileSink(url, file_bytes=256 MiB, compression="none", level=None): ``part-NNNNN.arrow`` files; level is for zstd."""

    name = "arrow_ipc"

    def __init__(self, url: str, file_bytes: int = 256 << 20, compression: str = "none", level: int | None = None):
        if compression not in ("none", "zstd", "lz4"):
            raise PlanError("compression is none, zstd or lz4")
        if level is not None and compression != "zstd":
            raise PlanError("level is for zstd only")
        self.url, self.file_bytes, self.compression, self.level = url, file_bytes, compression, 3 if level is None and compression == "zstd" else level

    def places(self):
        return [self.url]

    def save(self, df, ordered=False):
        schema = to_arrow_schema(in_order(df, False).schema)
        most, codec, level = self.file_bytes, self.compression, self.level

        def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, place = [], 0, 0
            options = pa.ipc.IpcWriteOptions(compression=None if codec == "none" else pa.Codec(codec, level) if level else pa.Codec(codec))  # codecs don't travel

            def pack() -> pa.RecordBatch:
                out = io.BytesIO()
                with pa.ipc.new_file(out, schema, options=options) as w:
                    for b in held:
                        w.write_batch(b)
                return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "body": pa.array([out.getvalue()], pa.binary())})

            for b in batches:
                held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema))
                size += b.nbytes
                if size >= most:
                    yield pack()
                    held, size, place = [], 0, place + 1
            if held:
                yield pack()

        _write_files(df, bodies, self.url, ".arrow", ordered)


class TensorSink(Output):
    """TensorSink(url, format="safetensors"|"mrb1", name="part"): each task's rows as tensors; nulls and text are refused."""

    name = "tensor"

    def __init__(self, url: str, format: str = "mrb1", name: str = "part"):
        if format not in ("mrb1", "safetensors"):
            raise PlanError("format is mrb1 or safetensors")
        self.url, self.format, self.file_name = url, format, name

    def places(self):
        return [self.url]

    def save(self, df, ordered=False):
        for f in in_order(df, False).schema:
            kind = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
            if not isinstance(kind, (T.NumericType, T.BooleanType)) or isinstance(kind, T.DecimalType):
                raise PlanError(f"{f.name!r} is not numeric")
        form = self.format

        def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if len(b)]
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                arrays = {}
                for n, c in zip(table.column_names, table.columns):
                    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                    flat = c.flatten() if pa.types.is_list(c.type) else c
                    if c.null_count or flat.null_count:
                        raise ValueError(f"{n} has nulls")
                    x = flat.to_numpy(zero_copy_only=False)
                    if pa.types.is_list(c.type):
                        if len(pa.compute.unique(pa.compute.list_value_length(c))) > 1:
                            raise ValueError(f"{n} has lists of different lengths")
                        x = x.reshape(len(c), -1)
                    arrays[n] = np.ascontiguousarray(x)
                yield pa.RecordBatch.from_pydict({"place": pa.array([0], pa.int32()), "body": pa.array([pack_tensors(arrays, form)], pa.binary())})

        _write_files(df, bodies, self.url, ".safetensors" if form == "safetensors" else ".mrb", ordered)


def pack_tensors(arrays: dict[str, np.ndarray], form: str) -> bytes:
    """Arrays as the content of one tensor file."""
    raw = {n: x.tobytes() for n, x in arrays.items()}
    kinds = {n: NUMPY[x.dtype.newbyteorder("=")] for n, x in arrays.items()}
    if form == "safetensors":
        at, head = 0, {}
        for n, x in arrays.items():
            head[n] = {"dtype": kinds[n], "shape": list(x.shape), "data_offsets": [at, at + len(raw[n])]}
            at += len(raw[n])
        text = json.dumps(head).encode()
        text += b" " * (-len(text) % 8)
        return struct.pack("<Q", len(text)) + text + b"".join(raw.values())
    size = 4096
    while True:
        at, head = size, []
        for n, x in arrays.items():
            head.append({"name": n, "dtype": kinds[n], "shape": list(x.shape), "offset": at, "bytes": len(raw[n])})
            at += -(-len(raw[n]) // 64) * 64
        text = json.dumps(head).encode()
        if len(text) + 8 <= size:
            break
        size *= 2
    out = bytearray(b"MRB1" + struct.pack("<I", len(text)) + text)
    for t, n in zip(head, arrays):
        out += b"\0" * (t["offset"] - len(out)) + raw[n]
    return bytes(out)

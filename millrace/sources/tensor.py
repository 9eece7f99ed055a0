"""Tensor files: safetensors, ``.npy`` and the aligned binary form MRB1.

A tensor of rank 1 is a scalar column, rank 2 a list column of fixed width, higher ranks flattened lists; field metadata
keep dtype and shape. All tensors of a source have one number of rows. BF16 widens to float, unsigned types as elsewhere.

MRB1: the magic ``MRB1``, a little-endian u32 length of a JSON header [{name, dtype, shape, offset, bytes}], the header, and the
tensors at 64-byte aligned offsets from the start of the file. It is this package's own reading of that name.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import IoError, PlanError
from ..operators.rows import ORDER
from .base import Input, as_list, files, name_of

# Dtype names of the public safetensors format.
DTYPES = {"I8": "<i1", "I16": "<i2", "I32": "<i4", "I64": "<i8", "U8": "<u1", "U16": "<u2", "U32": "<u4", "U64": "<u8", "F16": "<f2", "F32": "<f4", "F64": "<f8", "BOOL": "?", "BF16": "<u2"}
SPARK = {"I8": T.ByteType(), "I16": T.ShortType(), "I32": T.IntegerType(), "I64": T.LongType(), "U8": T.ShortType(), "U16": T.IntegerType(), "U32": T.LongType(), "U64": T.DecimalType(20, 0), "F16": T.FloatType(), "F32": T.FloatType(), "F64": T.DoubleType(), "BOOL": T.BooleanType(), "BF16": T.FloatType()}
NUMPY = {np.dtype(v).newbyteorder("="): k for k, v in DTYPES.items() if k != "BF16"}


def array_of(dtype: str, shape: list[int], body: bytes) -> np.ndarray:
    x = np.frombuffer(body, DTYPES[dtype]).reshape(shape)
    return (x.astype(np.uint32) << 16).view(np.float32) if dtype == "BF16" else x


def read_tensors(path: str, body: bytes) -> dict[str, tuple[str, np.ndarray]]:
    """Name to dtype and array of one file's content."""
    try:
        if path.endswith(".npy"):
            x = np.load(io.BytesIO(body), allow_pickle=False)
            x = np.ascontiguousarray(x)
            return {name_of(path)[:-4]: (NUMPY[x.dtype.newbyteorder("=")], x)}
        if body[:4] == b"MRB1":
            n = struct.unpack("<I", body[4:8])[0]
            return {t["name"]: (t["dtype"], array_of(t["dtype"], t["shape"], body[t["offset"] : t["offset"] + t["bytes"]])) for t in json.loads(body[8 : 8 + n])}
        n = struct.unpack("<Q", body[:8])[0]
        head, base = json.loads(body[8 : 8 + n]), 8 + n
        return {k: (t["dtype"], array_of(t["dtype"], t["shape"], body[base + t["data_offsets"][0] : base + t["data_offsets"][1]])) for k, t in head.items() if k != "__metadata__"}
    except (KeyError, ValueError, struct.error) as e:
        raise IoError(f"{path}: not a tensor file ({e})") from e


def as_arrow(dtype: str, x: np.ndarray) -> pa.Array:
    kind = to_arrow_schema(T.StructType([T.StructField("x", SPARK[dtype])])).field(0).type
    if dtype == "U64":
        flat = pa.array(x.reshape(-1).tolist(), pa.decimal128(20, 0))
    else:
        flat = pa.array(x.reshape(-1)).cast(kind)
    if x.ndim <= 1:
        return flat
    width = int(np.prod(x.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, max(1, width), dtype=np.int32)[: len(x) + 1] if width else np.zeros(len(x) + 1, np.int32)), flat)


class TensorSource(Input):
    """TensorSource(paths, tensors=None): files only; ``tensors`` names those to read."""

    name = "tensor"

    def __init__(self, paths, tensors: list[str] | None = None):
        self.paths, self.tensors = as_list(paths), tensors

    def places(self):
        return self.paths

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        found = files(spark, self.paths, "", directories=False)
        raw = spark.read.format("binaryFile").load(found).select("path", "content")
        first = raw.where(F.col("path").endswith(name_of(found[0]))).first()
        have = read_tensors(first.path, bytes(first.content))
        wanted = self.tensors or list(have)
        if missing := [n for n in wanted if n not in have]:
            raise PlanError(f"{found[0]} has no tensor {missing[0]!r}; there are {', '.join(have)}")
        fields = []
        for n in wanted:
            dtype, x = have[n]
            kind = SPARK[dtype] if x.ndim <= 1 else T.ArrayType(SPARK[dtype], False)
            fields.append(T.StructField(n, kind, True, {"dtype": dtype, "shape": [-1, *map(int, x.shape[1:])]}))
        schema = T.StructType(fields)
        full = T.StructType([*fields, T.StructField(ORDER[0], T.StringType()), T.StructField(ORDER[1], T.LongType())]) if order else schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, body in zip(b.column(0).to_pylist(), b.column(1)):
                    all_ = read_tensors(path, body.as_py())
                    arrays = [as_arrow(*all_[n]) for n in wanted]
                    if len({len(a) for a in arrays}) > 1:
                        raise IoError(f"{path}: tensors of different lengths")
                    if order:
                        arrays += [pa.array([path] * len(arrays[0]), pa.string()), pa.array(range(len(arrays[0])), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, full.names)

        return raw.mapInArrow(run, full)

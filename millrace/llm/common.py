"""Helpers shared by the corpus operators: shared storage, stable row keys, bounded samples and crc32 splits."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship

#: Characters of text that one vectorised step of a Python stage works on at most (a longer single text goes alone).
STEP_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; the session's Python workers get this package."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, default: str | None = None) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset (tests), under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or default or f"{spark.conf.get('spark.sql.warehouse.dir')}/_work"
    return f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}"


def store(df: DataFrame, root: str, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again, so that lost executors cost no recomputation."""
    path = f"{root}/{name}"
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")  # what has been written needs its shuffle files no more
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII texts take the fast path."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of the value as text, mod n (null: remainder 0 of the empty text)."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def stratified(df: DataFrame, stratum: str, key: Column, per_stratum: int, text: Column) -> DataFrame:
    """About ``per_stratum`` rows of each stratum (all, if fewer), drawn by a hash of ``key`` and ``text``.

    The counts cover every row; only the bounded sample itself carries texts. At most 256 strata are drawn.
    """
    counts = {r[0]: r[1] for r in df.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(256).collect()}
    if not counts:
        return df.limit(0)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(min(1.0, per_stratum / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(key, text), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.where(draw < share)


_caches: dict[str, dict] = {}


def cache(name: str) -> dict:
    """What a worker keeps from task to task, as long as they name it to ``lean``."""
    return _caches.setdefault(name, {})


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keep: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; when a task ends, its worker, which waits for the next one, gives back freed memory and all caches but one."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back(keep)

    return kept


def give_back(keep: str = "") -> None:
    for name in _caches.keys() - {keep}:
        _caches[name].clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def steps(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in ``column`` together stay near STEP_CHARS."""
    sizes = batch.column(column).cast(pa.large_binary()) if not pa.types.is_binary(batch.schema.field(column).type) else batch.column(column)
    start = total = 0
    for i, n in enumerate(pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()):
        if total and total + n > STEP_CHARS:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores until no column (whatever its case) is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names (whatever their case): an output replaces a column that is called so."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])


def with_field(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])

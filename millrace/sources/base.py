"""Shared by sources: listing files in name order, and choosing columns in file order."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from ..arguments import Deferred
from ..errors import IoError, PlanError
from ..session import column


class Input(Deferred):
    """A source task: ``load`` gives a lazy DataFrame; ``places`` are the locations it reads."""

    name = "source"
    repeatable = True

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        raise NotImplementedError

    def places(self) -> list[str]:
        return []


def files(spark: SparkSession, paths: list[str], suffix: str, directories: bool = True) -> list[str]:
    """Files of paths and (one level of) directories through Spark's file systems: given order, names in order within a directory."""
    jvm, out = spark.sparkContext._jvm, []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise IoError(f"{p} does not exist")
        if not fs.getFileStatus(path).isDirectory():
            out.append(p)
        elif directories:
            found = sorted(str(s.getPath()) for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().endswith(suffix) and not s.getPath().getName().startswith(("_", ".")))
            out += found
        else:
            raise PlanError(f"{p} is a directory")
    if not out:
        raise IoError(f"no {suffix} files in {', '.join(paths)}")
    return out


def uri(spark: SparkSession, path: str) -> str:
    """The path with its scheme, escaped as Spark's file metadata has it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else [str(p) for p in x]


def in_file_order(df: DataFrame, columns: list[str] | None, what: str, keep: tuple = ()) -> DataFrame:
    """These columns, in the order of the file; an unknown one is a plan error."""
    if columns is None:
        return df
    for n in columns:
        if n not in df.columns:
            raise PlanError(f"{what}: no column {n!r}; there are {', '.join(c for c in df.columns if c not in keep)}")
    return df.select(*[column(n) for n in df.columns if n in columns or n in keep])


def name_of(path: str) -> str:
    return PurePosixPath(path).name

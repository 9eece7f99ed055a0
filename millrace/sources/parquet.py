"""Parquet files, with projection, pruning of row groups, and the source order when asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import PlanError
from ..operators.rows import ORDER
from ..schema import Exact
from ..session import column
from .base import Input, as_list, files, in_file_order, uri

OPS = {">": "__gt__", "<": "__lt__", "==": "__eq__"}


class ParquetSource(Input):
    """ParquetSource(urls, columns=None, filters=None, exact=True).

    ``urls``: files, directories (``*.parquet`` in name order) or lists of them; all must have one schema. ``columns`` come
    in file order. ``filters`` (column, op, value) with >, < or ==: row groups that can't match are pruned by the scan's
    pushed filters, and with ``exact`` the rows of the others are filtered as well. Without it, filters only select
    files whose footers may match, and rows that don't match may come through.
    """

    name = "parquet"

    def __init__(self, urls, columns: list[str] | None = None, filters: list[tuple] | None = None, exact: bool = True):
        self.urls, self.columns, self.filters, self.exact = as_list(urls), columns, filters or [], exact
        for f in self.filters:
            if len(f) != 3 or f[1] not in OPS:
                raise PlanError(f"a filter is (column, op, value) with {', '.join(OPS)}, not {f!r}")

    def places(self):
        return self.urls

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        found = files(spark, self.urls, ".parquet")
        first = spark.read.parquet(found[0]).schema
        for f in found[1:]:
            if diff := Exact({c.name: c.dataType for c in first}).differences(spark.read.parquet(f).schema):
                raise PlanError(f"{f} differs from {found[0]}: " + "; ".join(map(str, diff)))
        df = spark.read.schema(first).parquet(*found)
        for name, op, value in self.filters:
            if name not in df.columns:
                raise PlanError(f"filters: no column {name!r}")
            number = df.schema[name].dataType.typeName()
            if self.exact:
                df = df.where(getattr(column(name), OPS[op])(F.lit(value)))
            elif isinstance(value, float) and number in ("byte", "short", "integer", "long") or isinstance(value, int) and not isinstance(value, bool) and number in ("float", "double"):
                continue  # an integer and a float don't compare in footers: nothing is pruned
            else:
                found = self._may_match(df, found, name, op, value)
        if not self.exact and self.filters:
            df = spark.read.schema(first).parquet(*found) if found else spark.createDataFrame([], first)
        if order:
            df = df.withColumns({"__path": _plain(F.col("_metadata.file_path")), ORDER[1]: F.col("_metadata.row_index")})
            ranks = spark.createDataFrame([(i, uri(spark, f)) for i, f in enumerate(found)], f"{ORDER[0]} int, __path string").withColumn("__path", _plain(F.col("__path")))
            df = df.join(F.broadcast(ranks), "__path").select(*map(column, first.names), *ORDER)  # a row for each file that the driver lists
        return in_file_order(df, self.columns, "columns", ORDER)

    @staticmethod
    def _may_match(df: DataFrame, found: list[str], name: str, op: str, value) -> list[str]:
        """Files that hold a row that matches (one distributed pass over that column's statistics and values)."""
        hit = df.where(getattr(column(name), OPS[op])(F.lit(value))).select(_plain(F.col("_metadata.file_path")).alias("f")).distinct()
        names = {r[0] for r in hit.collect()}
        plain = df.sparkSession.createDataFrame([(i, uri(df.sparkSession, f)) for i, f in enumerate(found)], "i int, f string").select("i", _plain(F.col("f")).alias("f"))
        return [found[r["i"]] for r in plain.orderBy("i").collect() if r["f"] in names]


def _plain(path: Column) -> Column:
    """One spelling of a file's URI: one slash after the scheme, escapes undone."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/{2,}(?=/)", "$1:"), r"\+", "%2B"))

"""SQL over named views: the full Spark SQL surface for joins, aggregates, windows and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException, ParseException

from ..errors import PlanError
from ..session import prepare
from .base import Input


def sql(spark: SparkSession, query: str, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """``query`` over ``views``; names such as "demo/readings" are quoted with back-quotes or double quotes."""
    prepare(spark)
    for k, (name, df) in enumerate((views or {}).items()):
        plain = name if name.isidentifier() else f"view_{k}"
        df.createOrReplaceTempView(plain)
        if plain != name:
            query = query.replace(f'"{name}"', plain).replace(f"`{name}`", plain)
    try:
        return spark.sql(query)
    except (AnalysisException, ParseException) as e:
        raise PlanError(str(e).splitlines()[0]) from e


class SqlSource(Input):
    """SqlSource(query, views): views may be DataFrames or sources."""

    name = "sql"

    def __init__(self, query: str, views: dict | None = None):
        self.query, self._views = query, views or {}
        self.repeatable = False

    def places(self):
        return [p for v in self._views.values() if isinstance(v, Input) for p in v.places()]

    def load(self, spark: SparkSession, order: bool = False) -> DataFrame:
        return sql(spark, self.query, {n: v.load(spark) if isinstance(v, Input) else v for n, v in self._views.items()})

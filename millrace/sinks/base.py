"""Shared by sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..arguments import Deferred
from ..operators.rows import ORDER


class Output(Deferred):
    """A sink task: ``save`` writes all rows or none."""

    name = "sink"

    def save(self, df: DataFrame, ordered: bool = False) -> None:
        raise NotImplementedError

    def places(self) -> list[str]:
        return []


def in_order(df: DataFrame, ordered: bool) -> DataFrame:
    """Rows in source order if asked for, without the hidden order columns."""
    hidden = [n for n in ORDER if n in df.columns]
    return (df.orderBy(*hidden) if ordered and hidden else df).drop(*hidden)

"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.caseSensitive": "true"}


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on: UTC, ANSI errors, case-sensitive names."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def local(cores: int = 8, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine; on a cluster, build your own and pass it to ``prepare``."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", partitions or cores).config("spark.driver.memory", memory)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
    return prepare(b.getOrCreate())


def column(name: str) -> Column:
    """A top-level column by its exact name; dots and back-quotes are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")

"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of every node move to its smallest neighbour. Small: the node and its smaller neighbours do."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(lowest, "u")
    if large:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.where(F.col("v") <= F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(links: DataFrame, root: str, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) for every node of ``links`` (columns u and v, of one type).

    Nodes without links are absent; links to itself and repeated links do no harm. Every round writes its links to the
    shared folder, so that lost executors cost at most one round. A stable edge set of stars ends the rounds.
    """
    edges = store(links.where("u <> v").select("u", "v").distinct(), root, f"{name}_0")
    state = None
    for k in range(1, most_rounds + 1):
        seen = Observation(f"{name}-{k}-{uuid.uuid4().hex}")
        made = _star(_star(edges, True), False).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        edges = store(made, root, f"{name}_{k}")
        now = (seen.get["n"], seen.get["sum"])
        if now == state or not now[0]:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())

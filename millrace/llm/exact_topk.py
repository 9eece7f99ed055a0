"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Vectors become segments of bounded size. A segment keeps, for every dimension, the list of its vectors sorted by that
component. A query reads every list from the end where its products are largest, one slice of each after the other. It goes
deeper in the lists that matter to it: a level stops all lists where a component's product falls to one multiple of the
squared weight. What a vector has been read to give, and that multiple for the lists it was not yet met in, bound its score
from above. The leaders by this bound are scored, which bounds the k-th best score from below; so does the k-th best of
the segments that the task has met before. Reading stops once scoring all vectors whose upper bound reaches that costs less
than the next slices; the others cannot qualify. What is left is scored exactly, in integers.

Queries are sent to the rows in blocks of bounded size, one pass over the rows for each block; every task returns its k best
for each query. ``reads`` tells how deep the queries read.

Vectors that are null, empty, or hold a null or non-finite component take no part. Only vectors of equal length are
compared. Scores must fit 64 bits: larger ones raise ValueError. Ties go to the smaller id. Rows with the query's own id are
its own row; a query row repeated with the same vector counts once, one repeated with another vector raises its own result
under the same id.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors of a segment, and components of a block of queries (8 bytes each, sent to every task of a pass).
SEGMENT, BLOCK = 8192, 1 << 21
#: Levels: products are read down to minus this multiple of the squared weight, scaled by the vectors' size. Reading begins
#: at the first level that opens this share of the lists.
LEVELS, OPENING = (-1.0, 0.0, 0.25, 0.5, 1.0, 2.0, 4.0), 0.3


class Segment:
    """Vectors (rows of integers) with, for every dimension, the list of their components in order."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        n, dim = x.shape
        self.order = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T)
        self.values = np.take_along_axis(x.T, self.order, 1).astype(np.float64)
        self.most = np.abs(x).max(0, initial=0).astype(np.float64)
        self.scale = math.sqrt(float((x.astype(np.float64) ** 2).mean())) or 1.0
        # All lists behind one another, each above the one before: one search finds a place in every list.
        self.above = np.arange(dim) * (4 * self.most.max(initial=0) + 4)
        self.flat = (self.values + self.above[:, None]).ravel()
        self.first = np.arange(dim) * n
        self.at, self.products = np.empty(n * dim, np.intp), np.empty(n * dim)  # what one query has just read

    def _depths(self, q: np.ndarray, multiple: float) -> np.ndarray:
        """For every list how many entries have a product over minus ``multiple`` times the squared weight."""
        n = len(self.ids)
        limit = np.clip(-multiple * q, -2 * self.most - 1, 2 * self.most + 1)
        below, upto = (np.searchsorted(self.flat, limit + self.above, side=s) - self.first for s in ("left", "right"))
        return np.where(q > 0, n - upto, np.where(q < 0, below, 0))

    def top(self, query_id: int, q: np.ndarray, k: int, floor: float = -math.inf) -> tuple[np.ndarray, np.ndarray, float]:
        """Ids and scores of the k best (ties to smaller ids) other than the query's own, and the share of the lists that was read.

        Scores below ``floor`` may be left out.
        """
        (n, dim), w = self.x.shape, q.astype(np.float64)
        weights, size = w * w, math.sqrt(float((w * w).mean()))
        if float(np.abs(w) @ self.most) >= 2.0**62:
            raise ValueError("scores do not fit 64 bits")
        others = np.flatnonzero(self.ids != query_id)
        room, unit = 1e-9 * float(np.abs(w) @ self.most), self.scale / size if size else 1.0
        able, done = others, np.zeros(dim, np.int64)
        levels = LEVELS if size and len(others) > 4 * k else ()
        depth = None
        got, seen, unseen = np.zeros(n), np.zeros(n), []
        for i, level in enumerate(levels):
            depth = self._depths(w, level * unit) if depth is None else depth
            deeper = self._depths(w, levels[i + 1] * unit) if i + 1 < len(levels) else np.full(dim, n)
            if not done.any() and depth.sum() < OPENING * n * dim:  # nothing to tell yet
                depth = deeper
                continue
            if depth.sum() > done.sum():
                start = 0
                for j, (a, b) in enumerate(zip(done.tolist(), depth.tolist())):
                    if b > a:
                        cut = slice(n - b, n - a) if w[j] > 0 else slice(a, b)
                        self.at[start : start + b - a] = self.order[j, cut]
                        np.multiply(self.values[j, cut], w[j], out=self.products[start : start + b - a])
                        start += b - a
                got += np.bincount(self.at[:start], self.products[:start], n)
                unseen.append((done, depth))
                done = depth
            upper = got + room
            if level:
                for before, after in unseen:
                    for j in np.flatnonzero(after > before):
                        seen[self.order[j, slice(n - after[j], n - before[j]) if w[j] > 0 else slice(before[j], after[j])]] += weights[j]
                unseen.clear()
                upper -= level * unit * (weights.sum() - seen)
            leaders = others[np.argpartition(upper[others], len(others) - 2 * k)[len(others) - 2 * k :]]
            scores = self.x[leaders] @ q
            bar = max(floor, float(np.partition(scores, len(scores) - k)[len(scores) - k]))
            able = others[upper[others] >= bar]
            if len(able) * dim <= (deeper - done).sum():
                break
            depth = deeper
        ids, final = self.ids[able], self.x[able] @ q
        if len(final) > 4 * k:
            keep = final >= np.partition(final, len(final) - k)[len(final) - k]
            ids, final = ids[keep], final[keep]
        best = np.lexsort((ids, -final))[:k]
        return ids[best], final[best], float(done.sum()) / max(1, n * dim)


def _scaled(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every length of vectors in a batch (id, vector): the length, the ids and the integer components."""
    vec, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    dims = pa.compute.list_value_length(vec).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(dims) - dims
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        x = np.floor(256.0 * flat[begin[rows][:, None] + np.arange(dim)])
        if np.abs(x).max(initial=0) >= 2**62:
            raise ValueError("scores do not fit 64 bits")
        yield int(dim), ids[rows], x.astype(np.int64)


def _clean(df: DataFrame, id_: str, vector: str) -> DataFrame:
    odd = F.exists(F.col(vector).cast("array<double>"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(id_).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~odd).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _pass(rows: DataFrame, block: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """The k best of every task for every query of a block: query_id, print (of its vector), vec_id, score, read."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held, best = sent.value, {}, {}

        def meet(dim: int) -> None:
            segment = Segment(*(np.concatenate(z) for z in zip(*held.pop(dim))))
            q_ids, q_x, _ = queries[dim]
            for i, (q_id, q) in enumerate(zip(q_ids.tolist(), q_x)):
                ids, scores, read = best.get((dim, i), (np.zeros(0, np.int64), np.zeros(0, np.int64), 0.0))
                new_ids, new, share = segment.top(q_id, q, k, float(scores[-1]) if len(scores) == k else -math.inf)
                ids, scores = np.concatenate([ids, new_ids]), np.concatenate([scores, new])
                order = np.lexsort((ids, -scores))[:k]
                best[dim, i] = ids[order], scores[order], max(read, share)

        for batch in batches:
            for dim, ids, x in _scaled(batch):
                if dim in queries:
                    for i in range(0, len(ids), SEGMENT):
                        held.setdefault(dim, []).append((ids[i : i + SEGMENT], x[i : i + SEGMENT]))
                        if sum(len(z[0]) for z in held[dim]) >= SEGMENT:
                            meet(dim)
        for dim in list(held):
            meet(dim)
        for some in [list(best.items())[i : i + 4096] for i in range(0, len(best), 4096)]:
            n = [len(b[1][0]) for b in some]
            column = lambda f, kind: np.repeat(np.array([f(*b) for b in some], kind), n)
            yield pa.RecordBatch.from_arrays([
                pa.array(column(lambda key, _: queries[key[0]][0][key[1]], np.int64)), pa.array(column(lambda key, _: queries[key[0]][2][key[1]], np.int64)),
                pa.array(np.concatenate([b[1][0] for b in some])), pa.array(np.concatenate([b[1][1] for b in some])), pa.array(column(lambda _, b: b[2], np.float64)),
            ], ["query_id", "print", "vec_id", "score", "read"])

    return rows.mapInArrow(run, "query_id long, print long, vec_id long, score long, read double")


def _met(rows: DataFrame, queries: DataFrame, k: int, id_: str, vector: str) -> DataFrame:
    rows, asked = _clean(rows, id_, vector), _clean(queries, id_, vector).distinct()
    n_rows, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(max(cores, math.ceil(n_rows / SEGMENT)))  # many small files: fuller segments
    total = asked.agg(F.sum(F.size("v"))).first()[0] or 0
    n_blocks, out = max(1, math.ceil(total / BLOCK)), None
    for b in range(n_blocks):
        of_block = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == b)
        got: dict[int, list] = {}
        for dim, ids, x in (z for batch in of_block.toArrow().to_batches() for z in _scaled(batch)):
            got.setdefault(dim, []).append((ids, x))
        block = {}
        for dim, parts in got.items():
            ids, x = (np.concatenate(z) for z in zip(*parts))
            block[dim] = ids, x, np.array([hash_of(v.tobytes()) for v in x], np.int64)
        found = _pass(rows, block, k)
        out = found if out is None else out.union(found)
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows for every query: query_id, rank, vec_id, score."""
    order = Window.partitionBy("query_id", "print").orderBy(F.desc("score"), "vec_id")
    return _met(rows, queries, k, id_, vector).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def reads(rows: DataFrame, queries: DataFrame, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every query the largest share of a segment's lists that it read: query_id, read (0 to 1)."""
    return _met(rows, queries, k, id_, vector).groupBy("query_id").agg(F.max("read").alias("read"))


def hash_of(raw: bytes) -> int:
    """A stable 63-bit fingerprint."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 1


def divisible(c: Column, n: int) -> Column:
    return F.pmod(c, F.lit(n)) == 0


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where(divisible(F.col("vec_id"), 50)))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

"""Exact n-gram Jaccard self-join by a size-aware heavy-light scheme, and the classes it links.

Texts become sets of word shingles (64-bit fingerprints). Equal sets form one class, and only classes are joined.

* Light sets (size up to a boundary): two light sets of sizes n and m that reach the similarity share at least
  c = ceil(t (n + m) / (1 + t)) shingles, so each enumerates its subsets of every such size c and meets its partners there.
* Heavy sets: inverted lists over the rarest shingles of every set (of those of one set, one of the first
  n - ceil(t n) + 1 is common to any pair that reaches t). Light sets that can reach a heavy one are in these lists too.

The boundary is the one of least cost, measured on the lists that the small sets themselves make. Corpus-wide counts put
frequent shingles last in the order, so that common passages open no lists. Every posting carries how many shingles of its
set are left from it on: at the first shingle that two sets share, what both have left bounds what they share, so a meeting
whose bound is too low is no candidate there. Lists of the same members count as one (a shared passage opens as many as it
has shingles). Before sets are fetched, bit sketches of both bound what a pair can share from above, so that only pairs near the
similarity are verified.

``links`` scans the lists in rounds that find enough links to connect all classes that are linked. First the members of a list
meet a few hubs, every class is compared with the hub it meets most often, and verified links join classes into components; lists
that hold a single component are done. When a round finds next to nothing, or that costs no more than a few rounds (lists of a few
members that only share a passage find nothing in any), every member outside a list's largest component meets all members of other components. Of these pairs a few for any two components are verified first, those with most meetings; then
all that still lie in different components. Every link between sets whose components are not known to be one is verified,
and none is guessed, so a group of near copies costs about as many meetings as it has postings and not its square. ``all_links`` verifies every candidate pair; its output is quadratic in such a group.

Null texts and texts without words have empty sets and no links. Texts of fewer words than a shingle has are one shingle.
Repeated rows fall into one class. Null ids take part but never name a component, unless all ids of it are null.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import POWER, POWER_INVERSE, powers
from .common import free_name, lean, release, shared_dir, steps, store, table
from .components import components

SHINGLE = 5
#: Similarity as a fraction: 75 / 100.
PART, WHOLE = 75, 100
#: Sets of up to so many shingles are kept at hand for enumeration (8 bytes each); one of them has over 10^11 subsets.
SMALL = 64
#: Shingles that a task counts together, the least count it reports, and how many frequent ones the order knows (the order
#: never changes results, only the length of lists).
COUNTED, REPORTED, FREQUENT = 1_000_000, 3, 1 << 18
#: Postings of a frequent shingle that are sorted together; longer lists are cut by class.
SPLIT = 50_000
#: Members of a list that all others are compared with in a round.
HUBS = 8
#: Hubs that a class is compared with in a round after the first, by their sketches.
TRIES = 4
#: Rounds of hubs end when one finds at most this share of all links found, or when comparing all that is left takes at most so
#: many rounds' comparisons (HUBS for each posting; a round also writes all postings anew). No link is lost by either.
FEW_LINKS, ROUNDS_WORTH = 0.01, 4
#: Pairs of any two components that are verified in each round before all are.
TRIED = (1, 16)
#: Subsets for each posting up to which enumeration is measured.
DEARER = 2
#: Links between components that the driver joins by itself (16 bytes each); more are joined by star steps.
LOCAL_LINKS = 1 << 17
#: Classes whose sets are fetched by broadcasting their ids (8 bytes and a document's id each); more are shuffled.
BROADCAST_CLASSES = 200_000

#: Columns of a folded sketch.
FOLDED = ["f0", "f1", "f2", "f3"]

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For every text the sorted fingerprints (int64) of its distinct shingles."""
    raw = b"\n".join((t or "").encode().translate(LOWER) for t in texts) + b"\n"
    b = np.frombuffer(raw, np.uint8)
    ends_of_text = np.cumsum(np.array([len((t or "").encode()) + 1 for t in texts], np.int64))
    blank = BLANK[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(POWER, len(b)), dtype=np.uint64)])
    word = mix((total[stop] - total[start]) * powers(POWER_INVERSE, len(b))[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, np.concatenate([[0], ends_of_text]))
    salts = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if len(word) >= size:
        rolled = sum((word[j : len(word) - size + 1 + j] * salts[j] for j in range(size)), np.uint64(0))
        rolled = mix(rolled + np.uint64(size)).view(np.int64)
    out = []
    for i in range(len(texts)):
        a, z = first[i], first[i + 1]
        if z - a >= size:
            out.append(np.unique(rolled[a : z - size + 1]))
        elif z > a:
            out.append(mix(np.array([(word[a:z] * salts[: z - a]).sum(dtype=np.uint64) + np.uint64(z - a)], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def prints(found: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    d = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(found: np.ndarray) -> bytes:
    """One bit, whether an odd number of shingles fall there, for each of 2 n to 4 n places (a power of two, 256 at least)."""
    places = 1 << max(8, (2 * len(found) - 1).bit_length())
    return np.packbits((np.bincount(found & (places - 1), minlength=places) & 1).astype(np.uint8)).tobytes()


def apart_by_sketch(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of two sets only: places where their sketches differ, the longer folded to the shorter."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def folded(a: bytes) -> np.ndarray:
    """A sketch folded to its least length, in four words."""
    return np.bitwise_xor.reduce(np.frombuffer(a, np.int64).reshape(-1, 4), axis=0)


def needed(n: int, m: int) -> int:
    """Shingles that sets of n and m must share at least."""
    return -(-PART * (n + m) // (PART + WHOLE))


def prefix_length(n: int) -> int:
    return n - -(-PART * n // WHOLE) + 1


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a set of n enumerates, one for each size of its light partners."""
    return sorted({needed(n, m) for m in range(1, boundary + 1) if WHOLE * min(n, m) >= PART * max(n, m)})


def subset_keys(found: np.ndarray, sizes: list[int]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(bytes([c]) + np.array(s, np.int64).tobytes(), digest_size=8).digest(), "little", signed=True) for c in sizes for s in itertools.combinations(found.tolist(), c)]


def _sets(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: a document's id, its text's print, set size, prints, sketch (also folded) and, if small, its set. Rows of kind 1: a frequent shingle and a count of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "doc_id", "print", "n", "p1", "p2", "small", "sketch", *FOLDED]
        held, amount, seen = [], 0, set()

        def frequent() -> pa.RecordBatch:
            h, k = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            h, k = h[k >= REPORTED], k[k >= REPORTED]
            none = pa.nulls(len(h), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), none, none, pa.array(k.astype(np.int32)), pa.array(h), none, pa.nulls(len(h), pa.binary()), pa.nulls(len(h), pa.binary()), none, none, none, none], names)

        for batch in batches:
            for part in steps(batch, 1):
                sets = shingle_sets(part.column(1).to_pylist())
                both = [prints(s) for s in sets]
                sketches = [sketch(s) for s in sets]
                fold = np.array([folded(x) for x in sketches]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int32()), pa.array([p for p, _ in both], pa.int64()), pa.array([p for _, p in both], pa.int64()), pa.array([s.tobytes() if len(s) <= SMALL else None for s in sets], pa.binary()), pa.array(sketches, pa.binary()), *[pa.array(fold[:, j]) for j in range(4)]], names)
                for s, p in zip(sets, both):
                    if p not in seen:
                        seen.add(p)
                        held.append(s)
                        amount += len(s)
                if amount > COUNTED:
                    yield frequent()
                    held, amount, seen = [], 0, set()
        yield frequent()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print")).mapInArrow(lean(run), "kind int, doc_id long, print long, n int, p1 long, p2 long, small binary, sketch binary, f0 long, f1 long, f2 long, f3 long")


def prefix(s: np.ndarray, hot: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order (unknown ones by hash, then the frequent ones by count), and their counts (0: unknown)."""
    k = prefix_length(len(s))
    if not len(hot):
        return s[:k], np.zeros(k, np.int64)
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    common = hot[at] == s
    rare = s[~common][:k]
    known = np.flatnonzero(common)
    known = known[np.lexsort((s[known], count[at[known]]))][: k - len(rare)]
    return np.concatenate([rare, s[known]]), np.concatenate([np.zeros(len(rare), np.int64), count[at[known]]])


def _postings(docs: DataFrame, order: Broadcast, boundary: int, collisions: set[int]) -> DataFrame:
    """t (a shingle of a prefix), c (class), n (its size), r (its shingles from t on, in order) and part (0, or from 1 on of a long list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = order.value
        seen: set[int] = set()
        for batch in batches:
            for step in steps(batch, 0):
                t, c, n, r, part = [], [], [], [], []
                for s in shingle_sets(step.column(0).to_pylist()):
                    size = len(s)
                    if WHOLE * size < PART * (boundary + 1):
                        continue
                    p1, p2 = prints(s)
                    p = p2 if p1 in collisions else p1
                    if p in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(p)
                    rare, often = prefix(s, hot, count)
                    k = len(rare)
                    t.append(rare)
                    c.append(np.full(k, p, np.int64))
                    n.append(np.full(k, size, np.int32))
                    r.append(np.arange(size, size - k, -1, dtype=np.int32))
                    parts = often // SPLIT + 1
                    part.append(np.where(parts > 1, 1 + (np.uint64(p & (2**64 - 1)) % parts.astype(np.uint64)).astype(np.int32), 0).astype(np.int32))
                flat = lambda x, kind: pa.array(np.concatenate([np.zeros(0, kind), *x]))
                yield pa.RecordBatch.from_arrays([flat(t, np.int64), flat(c, np.int64), flat(n, np.int32), flat(r, np.int32), flat(part, np.int32)], ["t", "c", "n", "r", "part"])

    return docs.select("text").mapInArrow(lean(run), "t long, c long, n int, r int, part int")


def _enumerated(small: DataFrame, boundary: int) -> DataFrame:
    """t (a subset's key) with the columns of ``small`` (c, n, small) but the set, for sets up to the boundary; way is the subset's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in [batch.slice(i, 64) for i in range(0, batch.num_rows, 64)]:
                t, c, n, way = [], [], [], []
                for class_, size, raw in zip(*(x.to_pylist() for x in step.columns)):
                    s = np.frombuffer(raw, np.int64)
                    for w in subset_sizes(size, boundary):
                        keys = subset_keys(s, [w])
                        t += keys
                        c += [class_] * len(keys)
                        n += [size] * len(keys)
                        way += [w] * len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(way, pa.int32())], ["t", "c", "n", "way"])

    return small.where(F.col("n") <= boundary).select("c", "n", "small").mapInArrow(lean(run), "t long, c long, n int, way int")


def boundary_by_cost(small: DataFrame, order: Broadcast) -> int:
    """The largest set to enumerate, by the cost measured on the small sets (columns c, n and small, one row for a class).

    Cost of a way: the rows it writes plus the lengths of the lists that they read. Enumeration is measured up to the size
    at which its subsets alone are DEARER times the postings of the small sets (all shuffled, so it could not pay by then).
    Of equal costs the larger boundary wins.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, count = order.value
        for batch in batches:
            kept = [(len(s), prefix(s, hot, count)[0]) for s in (np.frombuffer(raw, np.int64) for raw in batch.column(1).to_pylist())]
            n = np.repeat([n for n, _ in kept], [len(t) for _, t in kept]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.concatenate([np.zeros(0, np.int64), *[t for _, t in kept]]))], ["n", "t"])

    def costs(keys: DataFrame, *by: str) -> dict:
        """Rows and cost by set size and ``by``: a key's rows are counted once by size and once in all, so that no row meets another."""
        lists = keys.groupBy("t", "n", *by).agg(F.count("*").alias("k")).groupBy("t").agg(F.sum("k").alias("length"), F.collect_list(F.struct("n", *by, "k")).alias("sizes"))
        rows = lists.select("length", F.explode("sizes").alias("s")).groupBy("s.n", *[f"s.{b}" for b in by]).agg(F.sum("s.k").alias("rows"), F.sum(F.col("s.k") * (1 + F.col("length"))).alias("cost"))
        return {tuple(r)[:-2]: (int(r["rows"]), int(r["cost"])) for r in rows.collect()}

    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    by_list = {k[0]: v for k, v in costs(small.select("n", "small").mapInArrow(lean(prefixes), "n int, t long")).items()}
    most, bound = 0, DEARER * sum(rows for rows, _ in by_list.values())
    while most < SMALL and sum(sizes.get(n, 0) * math.comb(n, w) for n in range(1, most + 2) for w in subset_sizes(n, most + 1)) <= bound:
        most += 1
    by_subset = costs(_enumerated(small, most), "way") if most else {}

    def total(b: int) -> int:
        light = sum(by_subset.get((n, w), (0, 0))[1] for n in range(1, b + 1) for w in subset_sizes(n, b))
        return light + sum(cost for n, (_, cost) in by_list.items() if WHOLE * n >= PART * (b + 1))

    return min(range(most + 1), key=lambda b: (total(b), -b))


def _lists(docs: DataFrame, small: DataFrame, frequent: DataFrame, collisions: set[int], root: str) -> DataFrame:
    """The inverted lists with more than one class: t, c, n, r and k (how many lists of the same members it stands for)."""
    known = frequent.toArrow().sort_by("h")  # 16 bytes for each of FREQUENT at most
    order = docs.sparkSession.sparkContext.broadcast((known["h"].to_numpy(), known["k"].to_numpy()))
    boundary = boundary_by_cost(small, order)
    heavy = _postings(docs, order, boundary, collisions).repartition("t", "part").distinct()  # one shuffle serves the lists as well
    w = Window.partitionBy("t", "part")
    heavy = heavy.withColumn("lo", F.min("c").over(w)).withColumn("hi", F.max("c").over(w)).withColumn("parts", F.max("part").over(w))
    # Lists of the same members become one at its first shingle, where most is left of each; uncut ones only, as no other shows all its members.
    members = F.when(F.col("parts") > 0, F.col("t")).otherwise(F.bit_xor(F.xxhash64("c")).over(w))
    heavy = heavy.withColumn("t", members).where("lo <> hi or parts > 0").groupBy("t", "c").agg(F.min("n").alias("n"), F.max("r").alias("r"), F.count("*").alias("k"))
    if not boundary:
        return _alive(store(heavy, root, "met"), root)
    keys = store(_enumerated(small, boundary).drop("way"), root, "subsets")
    shared = keys.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select(F.col("t").alias("key"))
    light = keys.join(shared, F.col("t") == F.col("key")).select("t", "c", "n", F.col("n").alias("r"), F.lit(1).cast("long").alias("k"))
    return _alive(store(heavy.union(light), root, "met"), root)


def _alive(lists: DataFrame, root: str) -> DataFrame:
    """Postings that some other member of their list may reach (most lists of two or three hold none), and lists that have the same members then as one."""
    other = lists.select(F.col("t").alias("at"), F.struct("c", "n", "r").alias("b"))
    one = lists.select("t", F.struct("c", "n", "r", "k").alias("a")).join(other, F.expr(f"t = at and a.c <> b.c and {_able('a', 'b')}"), "left_semi")
    alive = store(one.select("t", "a.*"), root, "alive")
    members = alive.groupBy("t").agg(F.bit_xor(F.xxhash64("c")).alias("members")).withColumnRenamed("t", "at")
    merged = alive.join(members, F.col("t") == F.col("at")).groupBy(F.col("members").alias("t"), "c").agg(F.min("n").alias("n"), F.max("r").alias("r"), F.sum("k").alias("k"))
    out = store(merged, root, "lists")
    for done in ("met", "alive"):
        release(lists.sparkSession, f"{root}/{done}")
    return out


def _able(x: str, y: str) -> str:
    """Members of sizes n that may reach the similarity by what they have left (r) from the shingle on that they meet at."""
    n, m = f"{x}.n", f"{y}.n"
    return f"{WHOLE} * least({n}, {m}) >= {PART} * greatest({n}, {m}) and {PART + WHOLE} * least({x}.r, {y}.r) >= {PART} * ({n} + {m})"


def _alike(x: str, y: str) -> str:
    """Members that may reach the similarity by their folded sketches."""
    both = f"({x}.n + {y}.n)"
    return f"{PART + WHOLE} * ({both} - {' - '.join(f'bit_count({x}.{f} ^ {y}.{f})' for f in FOLDED)}) >= {2 * PART} * {both}"


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (u < v) of met classes (x, y)."""
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of classes whose sets reach the similarity."""
    one = pairs.join(sets.select(F.col("c").alias("u"), F.col("s").alias("s_u")), "u")
    two = one.join(sets.select(F.col("c").alias("v"), F.col("s").alias("s_v")), "v")
    common = two.select("u", "v", F.size(F.array_intersect("s_u", "s_v")).alias("x"), (F.size("s_u") + F.size("s_v")).alias("both"))
    return common.where(f"{WHOLE} * x >= {PART} * (both - x)").select("u", "v").distinct()


def _mains(now: DataFrame, k: int) -> DataFrame:
    """For every list that holds several components: the largest (main; of equals another in every round k), up to HUBS members of it, and the sizes of the list and of main.

    In round 0, where every class is a component, there is no main and the hubs are any members.
    """
    draw = lambda c: F.xxhash64(c, F.lit(k))
    g = F.col("g") if k else F.lit(None).cast("long")
    some = now.groupBy("t", g.alias("g"), F.pmod(draw("c"), F.lit(HUBS)).alias("b")).agg(F.count("*").alias("k"), F.min(F.struct(draw("c").alias("draw"), "c", "n", "r")).alias("m"))
    parts = some.groupBy("t", "g").agg(F.sum("k").alias("k"), F.array_sort(F.collect_list("m")).alias("hubs"))  # HUBS of them at most
    lists = parts.groupBy("t").agg(F.max(F.struct("k", draw("g").alias("draw"), "g", "hubs")).alias("top"), F.count("*").alias("parts"), F.sum("k").alias("members"))
    return lists.where("parts > 1" if k else "top.k > 1").select(F.col("t").alias("list"), F.col("top.g").alias("main"), F.col("top.hubs").alias("hubs"), "members", F.col("top.k").alias("inside"))


def _worth_all(mains: DataFrame) -> bool:
    """Whether comparing the members outside the main components with their whole lists costs no more than ROUNDS_WORTH rounds of hubs."""
    every, round_ = mains.agg(F.sum(F.expr("members * (members - inside)")), F.sum("members")).first()
    return not every or every <= ROUNDS_WORTH * HUBS * round_


def _hubs(now: DataFrame, mains: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Every member outside the main component of a list with hubs: those that it meets in the most lists, of those not tested with it; one in the first round, TRIES later."""
    each = mains.select("list", "main", F.explode("hubs").alias("hub"))
    met = now.alias("a").join(each.alias("b"), F.expr(f"a.t = b.list and not a.g <=> b.main and a.c <> b.hub.c and {_able('a', 'b.hub')}"))
    often = met.groupBy(F.col("a.c").alias("x"), F.col("b.hub.c").alias("y")).agg(F.sum("a.k").alias("k"))
    often = _untested(often.select("x", "y", "k", F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")), tested)
    if tested is None:
        return _pairs(often.groupBy("x").agg(F.max(F.struct("k", "y")).alias("b")).select("x", F.col("b.y").alias("y")))
    best = often.groupBy("x").agg(F.slice(F.sort_array(F.collect_list(F.struct("k", "y")), asc=False), 1, TRIES).alias("b"))  # HUBS of each of its lists at most
    return _pairs(best.select("x", F.explode("b.y").alias("y")))


def _untested(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    return pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")


def _rest(now: DataFrame, mains: DataFrame, rows: DataFrame) -> DataFrame:
    """Members outside the main component of a list with all members of other components that they may reach: u < v and k, their meetings."""
    folded = rows.where("n > 0").groupBy("c").agg(*[F.min(f).alias(f) for f in FOLDED])
    now = now.join(folded, "c")
    outside = now.join(mains.select("list", "main"), F.expr("t = list and g <> main")).select(F.col("t").alias("at"), "c", "n", "r", "k", "g", "main", *FOLDED)
    met = outside.alias("a").join(now.alias("b"), F.expr(f"a.at = b.t and a.g <> b.g and (b.g = a.main or a.c < b.c) and {_able('a', 'b')} and {_alike('a', 'b')}"))
    return met.groupBy(F.least("a.c", "b.c").alias("u"), F.greatest("a.c", "b.c").alias("v")).agg(F.sum("a.k").alias("k"))


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose components (g < h) differ."""
    one = pairs.join(label.toDF("x", "lx"), F.col("u") == F.col("x"), "left").select("u", "v", "k", F.coalesce("lx", "u").alias("a"))
    two = one.join(label.toDF("y", "ly"), F.col("v") == F.col("y"), "left").select("u", "v", "k", "a", F.coalesce("ly", "v").alias("b"))
    return two.where("a <> b").select("u", "v", "k", F.least("a", "b").alias("g"), F.greatest("a", "b").alias("h"))


def _fetched(docs: DataFrame, wanted: DataFrame, collisions: set[int]) -> DataFrame:
    """c and s (its shingles) for the wanted classes (c, and first: a document of each); again where several rows have that id and text."""
    wanted = wanted.select(F.col("c").alias("wanted"), "first")
    if wanted.count() <= BROADCAST_CLASSES:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    chosen = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("first"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in steps(batch, 0):
                keep, out = [], []
                for want, s in zip(part.column(1).to_pylist(), shingle_sets(part.column(0).to_pylist())):
                    p1, p2 = prints(s)
                    if (p2 if p1 in collisions else p1) == want and want not in seen:
                        seen.add(want)
                        keep.append(want)
                        out.append(s)
                offsets = np.cumsum([0, *map(len, out)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *out])))], ["c", "s"])

    return chosen.mapInArrow(lean(run), "c long, s array<long>")


def _prepared(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame, set[int]]:
    """Rows (doc_id, print, n, c, sketch and FOLDED), classes (c, first: its smallest id), lists (t, c, n, r, k) and colliding prints."""
    made = store(_sets(docs), root, "sets")
    known = made.where("kind = 0")
    twice = known.where("n > 0").groupBy("p1").agg(F.min("p2").alias("a"), F.max("p2").alias("b")).where("a <> b").select("p1").limit(10_001).collect()
    if len(twice) > 10_000:  # 10^11 different sets give 300
        raise ValueError("too many hash collisions")
    collisions = {r[0] for r in twice}
    c = F.when(F.col("p1").isin(list(collisions)), F.col("p2")).otherwise(F.col("p1")) if collisions else F.col("p1")
    rows = known.select("doc_id", "print", "n", c.alias("c"), "small", "sketch", *FOLDED)
    frequent = made.where("kind = 1").groupBy(F.col("p1").alias("h")).agg(F.sum("n").alias("k")).orderBy(F.desc("k"), "h").limit(FREQUENT)
    classes = store(rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first")), root, "ids")
    small = rows.where(F.col("small").isNotNull() & (F.col("n") > 0)).groupBy("c").agg(F.min("n").alias("n"), F.min("small").alias("small"))
    lists = _lists(docs, store(small, root, "small"), frequent, collisions, root)
    return rows.drop("small"), classes, lists, collisions


def _of(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the classes (or their rows) that are in one of the (stored) pairs (u, v)."""
    wanted = pairs.select(F.col("u").alias("c")).union(pairs.select("v")).distinct()
    return classes.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted, "c")


def _possible(pairs: DataFrame, rows: DataFrame, root: str, name: str) -> DataFrame:
    """Those of the (stored) pairs that may reach the similarity by their sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *_, n, m, a, b = (x.to_pylist() for x in batch.columns)
            keep = [apart_by_sketch(x, y) <= i + j - 2 * needed(i, j) for i, j, x, y in zip(n, m, a, b)]
            yield batch.select(pairs_columns).filter(pa.array(keep, pa.bool_()))

    pairs_columns = pairs.columns
    known = store(_of(rows, pairs).groupBy("c").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")), root, f"sketches_{name}")
    one = pairs.join(known.toDF("u", "n_u", "sketch_u"), "u").join(known.toDF("v", "n_v", "sketch_v"), "v")
    out = store(one.select(*pairs_columns, "n_u", "n_v", "sketch_u", "sketch_v").mapInArrow(lean(run), pairs.schema), root, f"possible_{name}")
    release(pairs.sparkSession, f"{root}/sketches_{name}")
    return out


def _links_of(pairs: DataFrame, docs: DataFrame, classes: DataFrame, collisions: set[int], root: str, name: str) -> DataFrame:
    """Those of the (stored) pairs (u, v) that reach the similarity; the sets of the classes in them are made anew from their texts."""
    sets = store(_fetched(docs, store(_of(classes, pairs).select("c", "first"), root, f"wanted_{name}"), collisions), root, f"sets_{name}")
    out = store(_verified(pairs, sets), root, f"links_{name}")
    for done in (f"wanted_{name}", f"sets_{name}"):
        release(docs.sparkSession, f"{root}/{done}")
    return out


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), and for each the smallest that it reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        np.minimum.at(least, least[x], low)
        np.minimum.at(least, least[y], low)
        while (least[least] != least).any():
            least = least[least]
    return nodes, nodes[least]


def _joined(fresh: DataFrame, label: DataFrame | None, root: str, name: str) -> DataFrame:
    """Components (node, label) after new links, which join those there were."""
    if label is not None:
        fresh = _apart(fresh.withColumn("k", F.lit(0)), label).select(F.col("g").alias("u"), F.col("h").alias("v")).distinct()
    between = store(fresh.select("u", "v"), root, f"between_{name}")
    n = between.count()
    if label is not None and not n:
        return label
    if n <= LOCAL_LINKS:
        found = between.toArrow()
        node, least = least_reachable(found["u"].to_numpy(), found["v"].to_numpy())
        star = between.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "label": pa.array(least, pa.int64())}))
    else:
        star = components(between, root, f"star_{name}")
    if label is not None:
        moved = label.join(star.toDF("from", "to"), F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
        star = moved.union(star.join(label.select("node"), "node", "left_anti"))
    return store(star, root, f"label_{name}")


def links(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, print, n, c), classes (c, first) and the components (node, label) of all classes that are linked."""
    spark = docs.sparkSession
    rows, classes, lists, collisions = _prepared(docs, root)
    now, label, tested, new, n_found, k = lists.withColumn("g", F.col("c")), None, None, 0, 0, 0
    while True:
        mains = store(_mains(now, k), root, f"mains_{k}")
        if k and (new <= FEW_LINKS * n_found or _worth_all(mains)):
            break
        pairs = store(_hubs(now, mains, tested), root, f"pairs_{k}")
        fresh = _links_of(_possible(pairs, rows, root, f"hubs_{k}"), docs, classes, collisions, root, f"hubs_{k}")
        new = fresh.count()
        n_found += new
        tested = pairs if tested is None else tested.union(pairs)
        label = _joined(fresh, label, root, f"hubs_{k}")
        # Only lists that still hold several components go on.
        now = now.drop("g").join(mains.select("list"), F.col("t") == F.col("list"), "left_semi").join(label, F.col("c") == F.col("node"), "left")
        now = store(now.select("t", "c", "n", "r", "k", F.coalesce("label", "c").alias("g")), root, f"now_{k + 1}")
        for done in (f"now_{k}" if k else "lists", f"mains_{k}"):
            release(spark, f"{root}/{done}")
        k += 1
    left = _possible(store(_untested(_rest(now, mains, rows), tested), root, "left"), rows, root, "left")
    for done in (f"now_{k}", f"mains_{k}", *(f"pairs_{j}" for j in range(k))):
        release(spark, f"{root}/{done}")
    for j, tried in enumerate((*TRIED, None)):
        apart = store(_apart(left, label), root, f"apart_{j}")
        if apart.isEmpty():
            break
        some = apart
        if tried:
            few = apart.groupBy("g", "h", F.pmod(F.xxhash64("u", "v"), F.lit(tried))).agg(F.max(F.struct("k", "u", "v")).alias("p"))
            some = store(few.select("p.u", "p.v"), root, f"tried_{j}")
            left = _untested(apart, some).select("u", "v", "k")
        label = _joined(_links_of(some.select("u", "v"), docs, classes, collisions, root, f"rest_{j}"), label, root, f"rest_{j}")
    return rows.drop("sketch", *FOLDED), classes, label


def all_links(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``links``, but every link (u, v) between different sets, once each, in place of the components."""
    rows, classes, lists, collisions = _prepared(docs, root)
    met = lists.alias("a").join(lists.alias("b"), F.expr(f"a.t = b.t and a.c < b.c and {_able('a', 'b')}"))
    pairs = store(_pairs(met.select(F.col("a.c").alias("x"), F.col("b.c").alias("y"))), root, "pairs")
    return rows.drop("sketch", *FOLDED), classes, _links_of(_possible(pairs, rows, root, "all"), docs, classes, collisions, root, "all")


def _named(rows: DataFrame, classes: DataFrame, label: DataFrame, root: str) -> DataFrame:
    named = classes.join(label, classes.c == label.node, "left").select("c", "first", F.coalesce("label", "c").alias("g"))
    named = store(named, root, "classes")
    lowest = named.groupBy("g").agg(F.min("first").alias("component_id"))
    by_class = store(named.join(lowest, "g").select(F.col("c").alias("class"), "component_id"), root, "named")
    some = rows.where("n > 0").join(by_class, F.col("c") == F.col("class")).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "print", "c")
    none = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "print", F.lit(None).cast("long").alias("c"))
    return some.union(none)


def join_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and print (fingerprint of the text) for every row of ``docs`` (columns doc_id and text)."""
    root = shared_dir(docs.sparkSession)
    return _named(*links(docs, root), root).drop("c")


def join_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``join_classes`` with class_id (equal sets) and n_links (other rows that reach the similarity), and all links (u, v) between class ids."""
    root = shared_dir(docs.sparkSession)
    rows, classes, found = all_links(docs, root)
    size = store(rows.where("n > 0").groupBy("c").agg(F.count("*").alias("members")), root, "sizes")
    both = found.union(found.select("v", "u")).toDF("class", "other")
    linked = both.join(size, F.col("other") == F.col("c")).groupBy("class").agg(F.sum("members").alias("linked"))
    counted = size.join(linked, F.col("c") == F.col("class"), "left").select(F.col("c").alias("class_id"), (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    out = _named(rows, classes, components(found, root), root).withColumnRenamed("c", "class_id").join(counted, "class_id", "left")
    return out.select("doc_id", "n_shingles", "component_id", "print", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links")), found


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (ties: the smallest print of the text). Rows without words all stay."""
    kept_id, kept_print = free_name(docs, "kept_id"), free_name(docs, "kept_print")
    spoken = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    first = join_classes(docs.select("doc_id", "text")).where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", "print")).alias("k")).select(F.col("k.doc_id").alias(kept_id), F.col("k.print").alias(kept_print))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.xxhash64("text") == F.col(kept_print))
    kept = docs.where(spoken).join(first.distinct(), on, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.union(docs.where(~spoken))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("print")


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
), r AS (
  SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u) m USING (doc_id)
"""

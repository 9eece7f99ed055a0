"""Benchmark decontamination on the stored word sequences of the corpus, in DataFrame functions only.

The corpus is tokenised once into the shared folder: a forward table, for every row its words in order. No list keyed by term
is stored; the words of all rows are opened in overlapping segments. Corpus counts of the benchmark's terms give, for every
window of an item, its rarest term; only these are joined. A word at position p of a term that is the a-th of its item proposes
the alignment p - a; the neighbouring words in the segment are compared with it outwards from the rarest term, and runs of a whole window at least are exact phrase matches. ``gap`` over 0 also gives proximity
matches: all terms of a window in any order within window + gap words.

A window is ``window`` consecutive words of an item, or the whole item if it has fewer (but some). Null texts have no
words. Items without id take no part; items that share an id are one. Rows that repeat an id and a text share one
result each; extra columns stay out. Benchmark terms and anchors are broadcast in blocks of bounded size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, release, shared_dir, store, table

DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of a row that are opened together; an exploded row carries these and a window's words around them, never the row's all.
SEGMENT = 48
#: Rows that one broadcast block holds on average (an anchor has at most 2 * window - 1 words, a term one).
BLOCK_ROWS = 200_000


def words(c: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(c), DELIMITERS), ""), F.array().cast("array<string>"))


def _blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """Parts of about BLOCK_ROWS rows at most, by a hash of ``key``."""
    n = max(1, math.ceil(df.count() / BLOCK_ROWS))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == i) for i in range(n)] if n > 1 else [df]


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, its words, and its window's size."""
    w = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("words"))
    return w.where(F.size("words") > 0).withColumn("w", F.least(F.lit(window), F.size("words"))).distinct()


def _anchors(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """For every item the places of the rarest terms of its windows, with the words around that those windows hold.

    Columns: term, ctx (words), a (place of the term in ctx, from 0), w, items (their ids).
    """
    each = items.select("item", "words", "w", F.posexplode("words").alias("pos", "term"))
    known = each.join(counts, "term", "left").groupBy("item", "words", "w").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.coalesce("n", F.lit(0)).alias("n")))).alias("by_pos")
    )
    start = known.select("*", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("w"))).alias("s"))
    rarest = F.array_min(F.transform(F.slice("by_pos", F.col("s") + 1, F.col("w")), lambda x: F.struct(x["n"].alias("n"), x["pos"].alias("pos"))))["pos"]
    spans = start.withColumn("pos", rarest).groupBy("item", "words", "w", "pos").agg(F.min("s").alias("first"), F.max("s").alias("last"))
    ctx = F.slice("words", F.col("first") + 1, F.col("last") - F.col("first") + F.col("w"))
    found = spans.select("item", "w", F.get("words", F.col("pos")).alias("term"), ctx.alias("ctx"), (F.col("pos") - F.col("first")).alias("a"))
    return found.groupBy("term", "ctx", "a", "w").agg(F.collect_set("item").alias("items"))


def _segments(index: DataFrame, margin: int, length: int = SEGMENT) -> DataFrame:
    """doc_id, print, base and seg: words from place ``base`` on, ``length`` of the row's own with ``margin`` words around them."""
    starts = index.where("n_words > 0").select("doc_id", "print", "words", F.sequence(F.lit(0), F.col("n_words") - 1, F.lit(length)).alias("starts"))
    cut = F.transform("starts", lambda s: F.struct(F.greatest(s - margin, F.lit(0)).alias("base"), s.alias("own"), F.slice("words", F.greatest(s - margin, F.lit(0)) + 1, length + margin + F.least(s, F.lit(margin))).alias("seg")))
    return starts.select("doc_id", "print", F.explode(cut).alias("x")).select("doc_id", "print", "x.base", "x.own", "x.seg")


def _postings(segments: DataFrame, length: int = SEGMENT) -> DataFrame:
    """Every word of a row once: its term, its place ``at`` in the segment, and the segment."""
    each = segments.select("doc_id", "print", "base", "own", "seg", F.posexplode("seg").alias("at", "term"))
    return each.where((F.col("base") + F.col("at") >= F.col("own")) & (F.col("base") + F.col("at") < F.col("own") + length))


def _runs(index: DataFrame, anchors: DataFrame, window: int) -> DataFrame:
    """Exact runs: the row's key, start and end (inclusive) in the row, and items."""
    near = lambda k: F.get("seg", F.col("at") + k).eqNullSafe(F.get("ctx", F.col("a") + k)) & (F.col("a") + k >= 0) & (F.col("a") + k < F.size("ctx"))
    found = []
    for part in _blocks(anchors, "term"):
        # Every window around the term holds two of its left neighbours or two of its right ones, if it has five words.
        close = (F.col("w") < 5) | (near(-1) & near(-2)) | (near(1) & near(2))
        met = _postings(_segments(index, window - 1)).join(F.broadcast(part), "term").where(close)
        # How far the intersection goes to each side before the first difference.
        side = lambda sign, most: F.when(most > 0, F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), most), lambda k: ~F.get("seg", F.col("at") + k * sign).eqNullSafe(F.get("ctx", F.col("a") + k * sign)))) - 1, most)).otherwise(0)
        ends = met.select("doc_id", "print", (F.col("base") + F.col("at")).alias("pos"), "w", "items", side(-1, F.col("a")).alias("left"), side(1, F.size("ctx") - 1 - F.col("a")).alias("right"))
        found.append(ends.where(F.col("left") + F.col("right") + 1 >= F.col("w")).select("doc_id", "print", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"), "items"))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["doc_id", "print", "start", "end", "items"])


def _near(index: DataFrame, anchors: DataFrame, items: DataFrame, window: int, gap: int) -> DataFrame:
    """Proximity matches: places whose surrounding ``window + gap`` words hold every word of a window, in any order."""
    grams = items.select("item", "w", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - F.col("w")), lambda s: F.slice("words", s + 1, F.col("w")))).alias("gram"))
    terms = anchors.select("term").distinct()
    each = grams.select("item", "w", "gram", F.explode(F.array_distinct("gram")).alias("term")).join(terms, "term", "left_semi")
    one = each.groupBy("w", "gram").agg(F.min("term").alias("term"), F.collect_set("item").alias("items"))
    found, reach = [], window + gap - 1
    for part in _blocks(one, "term"):
        met = _postings(_segments(index, reach)).join(F.broadcast(part), "term")
        spot = met.select("doc_id", "print", "base", "seg", "gram", "items", "w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("w") - gap + 1), F.col("at"))).alias("start"))
        inside = F.slice("seg", F.col("start") + 1, F.col("w") + gap)
        all_in = F.forall("gram", lambda g: F.size(F.filter(inside, lambda x: x == g)) >= F.size(F.filter(F.col("gram"), lambda x: x == g)))
        whole = F.least(F.size("seg") - 1, F.col("start") + F.col("w") + gap - 1)
        found.append(spot.where(all_in).select("doc_id", "print", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + whole).alias("end"), "items"))
    return reduce(DataFrame.unionByName, found).dropDuplicates(["doc_id", "print", "start", "end", "items"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gap: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, print (fingerprint of the text), n_words, runs of matched words, items."""
    spark = docs.sparkSession
    root = shared_dir(spark)
    made = docs.select("doc_id", F.xxhash64("text").alias("print"), words(F.col("text")).alias("words"))
    index = store(made.select("doc_id", "print", F.size("words").alias("n_words"), "words"), root, "postings")
    items = _items(benchmark, window)
    vocabulary = items.select(F.explode("words").alias("term")).distinct()
    counts = [index.select(F.explode("words").alias("term")).join(F.broadcast(v), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")) for v in _blocks(vocabulary, "term")]
    anchors = store(_anchors(items, reduce(DataFrame.unionByName, counts), window), root, "anchors")
    runs = _near(index, anchors, items, window, gap) if gap else _runs(index, anchors, window)
    per_row = runs.groupBy("doc_id", "print").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    per_row = per_row.select(F.col("doc_id").alias("hit_id"), F.col("print").alias("hit_print"), "runs", "items")
    rows = index.select("doc_id", "print", "n_words")
    joined = rows.join(per_row, rows.doc_id.eqNullSafe(per_row.hit_id) & (rows["print"] == per_row.hit_print), "left")
    out = store(joined.select("doc_id", "print", "n_words", "runs", F.coalesce("items", F.array().cast("array<string>")).alias("items")), root, "matches")
    release(spark, f"{root}/postings")
    return out


def covered(runs: Column) -> Column:
    """How many words the sorted runs cover."""
    zero = F.struct(F.lit(-1).alias("until"), F.lit(0).alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["until"], r["end"]).alias("until"), (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["start"], acc["until"] + 1) + 1)).alias("n"))
    return F.coalesce(F.aggregate(runs, zero, step)["n"], F.lit(0))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row."""
    found = matches(docs, benchmark, window)
    hit = covered(F.col("runs")).cast("long")
    return found.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    hit_id, hit_print = free_name(docs, "hit_id"), free_name(docs, "hit_print")
    hit = matches(docs.select("doc_id", "text"), benchmark, window).where(F.col("runs").isNotNull()).select(F.col("doc_id").alias(hit_id), F.col("print").alias(hit_print)).distinct()
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.xxhash64("text") == F.col(hit_print)), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, hash(text) AS print, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[])) AS words,
         row_number() OVER () AS row
  FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), iw AS (
  SELECT item, least(10, len(words)) AS w, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS s FROM i WHERE len(words) > 0
), g AS (
  SELECT DISTINCT item, w, array_to_string(list_slice(words, s, s + w - 1), ' ') AS gram FROM iw
), sizes AS (SELECT DISTINCT w FROM g
), dw AS (
  SELECT row, w, words, unnest(range(1, len(words) - w + 2)) AS s FROM d, sizes WHERE len(words) >= w
), m AS (
  SELECT dw.row, dw.s, dw.w, g.item FROM dw JOIN g ON dw.w = g.w AND array_to_string(list_slice(dw.words, dw.s, dw.s + dw.w - 1), ' ') = g.gram
), hits AS (
  SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(s, s + w)) AS p FROM m) GROUP BY row
), its AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM m) GROUP BY row
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN its USING (row)
"""
